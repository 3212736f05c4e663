"""Queries of sentence boundaries learned from raw text, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.operators import sentences
from docloom.plans.catalog import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


_CORE = """regexp_replace({}, '^["''(\\[]+|["'')\\],;:]+$', '', 'g')"""
_KIND = "CASE WHEN regexp_matches(regexp_replace({0}, '[.?!]+$', ''), '^-?[0-9][0-9.,-]*$') THEN '#' ELSE lower(regexp_replace({0}, '[.?!]+$', '')) END"
_MARK = "CASE WHEN {0} LIKE '%.' THEN '.' WHEN regexp_matches({0}, '[?!]$') THEN '!' ELSE '' END"
_UPPER = "left({0}, 1) <> lower(left({0}, 1))"
_B = r"[\x20\x09-\x0D]"


def _xlog(x: str, y: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({y}) END"


def _split(k: str, m: str, p: str) -> str:
    return f"({_xlog(k, p)}) + ({_xlog(f'({m} - {k})', f'1 - {p}')})"


def _ratio(a: str, b: str, ab: str, n: str) -> str:
    alike = f"{_split(ab, a, f'{b} / {n}')} + {_split(f'({b} - {ab})', f'({n} - {a})', f'{b} / {n}')}"
    apart = f"{_split(ab, a, f'{ab} / {a}')} + {_split(f'({b} - {ab})', f'({n} - {a})', f'({b} - {ab}) / ({n} - {a})')}"
    return f"round(-2 * (({alike}) - ({apart})), 6)"


_LEARNED = rf"""toks AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_B}+'), lambda x: x <> '') AS t FROM documents),
cores AS (SELECT {_CORE.format('t[p]')} AS core, {_CORE.format('t[p - 1]')} AS back, p FROM (SELECT t, unnest(range(1, len(t) + 1)) AS p FROM toks)),
counts AS (SELECT type, mark, upper, before, CASE WHEN before = '.' THEN back END AS prev, count(*)::DOUBLE AS n FROM
  (SELECT {_KIND.format('core')} AS type, {_MARK.format('core')} AS mark, {_UPPER.format('core')} AS upper, CASE WHEN p > 1 THEN {_MARK.format('back')} END AS before, {_KIND.format('back')} AS back FROM cores) GROUP BY ALL),
sums AS (SELECT sum(n) AS total, coalesce(sum(n) FILTER (mark = '.'), 0) AS stops FROM counts),
types AS (SELECT type, sum(n) AS n, coalesce(sum(n) FILTER (mark = '.'), 0) AS w FROM counts GROUP BY 1),
sized AS (SELECT *, length(replace(type, '.', '')) AS len, length(type) - length(replace(type, '.', '')) AS inside FROM types, sums WHERE w > 0 AND regexp_matches(type, '\p{{L}}') AND total > stops),
abbr AS (SELECT type FROM sized WHERE round(2 * (w * ln(0.99 / (stops / total)) + (n - w) * ln(0.01 / (1 - stops / total))) * exp(-len) * (inside + 1) * pow(len, w - n), 6) >= {sentences.ABBREVIATION})"""

_WORDS = rf"""{_LEARNED},
owned AS (SELECT c.*, a.type IS NOT NULL AS own FROM counts c LEFT JOIN abbr a ON c.prev = a.type),
aft AS (SELECT *, CASE WHEN before IS NULL OR before = '!' THEN 'first' WHEN before = '' THEN 'inside' WHEN own OR prev IN ('#', '') OR regexp_full_match(prev, '\p{{L}}') THEN 'unknown' ELSE 'first' END AS place FROM owned),
seen AS (SELECT type, sum(n) AS n, coalesce(sum(n) FILTER (place = 'first' AND before IS NOT NULL), 0) AS began, bool_or(NOT upper) AS lower_, bool_or(upper) AS upper_,
  bool_or(upper AND place = 'inside') AS upper_inside, bool_or(NOT upper AND place = 'first') AS lower_first FROM aft GROUP BY 1),
breaks AS (SELECT sum(n) AS total, coalesce(sum(n) FILTER (place = 'first' AND before IS NOT NULL), 0) AS breaks FROM aft),
words AS (SELECT type, lower_, upper_, upper_inside, lower_first, CASE WHEN regexp_matches(type, '\p{{L}}') AND began > 0 AND total > breaks AND total * began > breaks * n
  THEN {_ratio('breaks', 'n', 'began', 'total')} >= {sentences.STARTER} ELSE false END AS starter FROM seen, breaks),
met AS (SELECT prev, type, sum(n) AS met FROM aft WHERE regexp_full_match(prev, '#|\p{{L}}') AND NOT own AND regexp_matches(type, '\p{{L}}|^#$') GROUP BY 1, 2),
coll AS (SELECT prev, m.type FROM met m JOIN types t ON t.type = m.type JOIN types e ON e.type = m.prev, sums
  WHERE met > 1 AND total > e.n AND total * met > e.n * t.n AND {_ratio('e.n', 't.n', 'met', 'total')} >= {sentences.COLLOCATION})"""

_SENTENCES = rf"""WITH {_WORDS},
marked AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.?!]["'')\]]{{0,3}})({_B})', '\1' || chr(1) || '\2', 'g'), '(\n[\x20\x09]*\n)', chr(1) || '\1', 'g'), chr(1)) AS t FROM documents),
each_ AS (SELECT doc_id, p AS i, t[p] AS x, t[p + 1] AS y FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS p FROM marked)),
ends AS (SELECT doc_id, i, x, length(x) AS size, length(regexp_extract(x, '^{_B}*')) AS lead, length(x) - length(regexp_replace(x, '{_B}+$', '')) AS tail,
  {_CORE.format(f"regexp_extract(x, '([^\\x20\\x09-\\x0D]+){_B}*$', 1)")} AS core,
  CASE WHEN y IS NOT NULL AND y <> '' AND NOT regexp_matches(y, '^\n[\x20\x09]*(\n|$)') THEN {_CORE.format(f"regexp_extract(y, '^{_B}*([^\\x20\\x09-\\x0D]+)', 1)")} END AS ahead FROM each_),
asked AS (SELECT *, {_MARK.format('core')} AS mark, {_KIND.format('core')} AS kind, CASE WHEN ahead IS NOT NULL THEN {_KIND.format('ahead')} END AS next, {_UPPER.format('ahead')} AS up FROM ends),
looks AS (SELECT k.*, a.type IS NOT NULL AS own, regexp_full_match(kind, '\p{{L}}') AS single, l.type IS NOT NULL AS paired, regexp_matches(k.next, '\p{{L}}') AS word, coalesce(starter, false) AS starter,
  coalesce(lower_, false) AS lo, coalesce(upper_, false) AS hi, coalesce(upper_inside, false) AS hi_in, coalesce(lower_first, false) AS lo_first
  FROM asked k LEFT JOIN abbr a ON a.type = kind LEFT JOIN words w ON w.type = k.next LEFT JOIN coll l ON l.prev = kind AND l.type = k.next),
judged AS (SELECT *, CASE WHEN mark <> '.' OR next IS NULL OR NOT (own OR single OR kind IN ('#', '')) THEN true WHEN paired THEN false
  WHEN (own OR kind = '') AND NOT single THEN (word AND up AND lo AND NOT hi_in) OR (up AND starter)
  WHEN single AND up AND word AND NOT lo THEN false
  ELSE word AND (up OR (NOT hi AND lo_first)) END AS parts FROM looks),
placed AS (SELECT *, coalesce(sum(size) OVER b, 0) AS begun, coalesce(sum(parts::INT) OVER b, 0) AS s FROM judged WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
whole AS (SELECT doc_id, s, min(begun + lead) AS f, max(begun + size - tail) AS e, bool_or(regexp_matches(x, '\p{{L}}{{3}}|[0-9]')) AS sense FROM placed WHERE size > lead GROUP BY 1, 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS nth, f::INT AS start, e::INT AS "end" FROM whole WHERE sense"""


def _model(spark: SparkSession, d: str) -> tuple[sentences.SentenceModel, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sentences.fit(docs), docs


@query("trained_sentences", _SENTENCES)
def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(*_model(spark, d))


@query("learned_abbreviations", f"WITH {_LEARNED} SELECT type FROM abbr")
def _abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d)[0].abbreviations


@query("learned_sentence_starters", f"WITH {_WORDS} SELECT type FROM words WHERE starter")
def _starters(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d)[0].words.filter("starter").select("type")
