"""Queries of the record extractors and of references to law, with their DuckDB SQL.

The driver's texts hold few such strings, so each query reads all documents and a few literal texts with negative ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import legal, records
from docloom.plans.catalog import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TEXTS = (
    "Call (212) 555-1234 or 212-555 9876; SSN 123-45-6789, not 000-12-3456 or 123004567.",
    "CUSIP 037833100 and 38259P508, wrong 037833101, private 9128@#AB7 internal 123991AB5.",
    "Section 7 of the Clean Air Act of 1970, sections 2(a), 3 and 4 of the Data Protection Act applies. The National Labor Relations Act, too.",
    "Rates of 5.5% and -2 percent, 25 basis points or 30 bps; odds 3:4 or 10 to 1, at 10:30 AM, zero 5/0.",
    "It is 12 km away, or 1,200.5 miles; notice of 30 days, a 12-month term, 2.5 years or 90 minutes.",
    "Paid $1,250.50 and € 3 million, then 500 dollars, 2 billion USD and 75 INR.",
    "Under 15 USC 78 and 17 CFR § 240.10b-5, Pub. L. No. 111-203, 124 Stat. 1376.",
    "Copyright (c) 2001-2005 Acme Widgets, Inc. and © 1999 Jane Doe; Best Brand(TM) with SuperClean® soap.",
    "See https://example.org/a?b=1, www.example.com/x_(y) and ftp://files.example.net.",
    "Signed on January 5, 2010 and March 31 2012; see 410 U.S. 113, 152 (1973), 12 F.3d 1011 (9th Cir. 1993) and 5 S. Ct. 7.",
    "Payment is due, provided that the buyer agrees, unless and until cancelled; if late, no later than June, at least twice or more than once.",
    "AIR 1973 SC 1461; (1973) 4 SCC 225, 1973 (4) SCC 225 and [1973] 1 SCR 1; MANU/SC/0001/2020, air 1973  S.C. 1461",
    "Section 147 of the Income Tax Act, 1961 and s. 302 IPC; article 226 of the Constitution of India. Order XXXIX Rule 1 and Sec 9 of Foreign Trade Regulation Board",
    "In 1998 scc 12 the court read section 5a and order xxi with the Indian Penal Code and the constitution of india; 2001 AIR SC 44.",
    "Intro <CITATION_1> <CITATION_2>\n1. First <CITATION_2> <CITATION_1> <CITATION_3> <CITATION_2>\n2. Second <CITATION_3> <CITATION_1>\n3. None",
    "Head of the case PETITIONER: A. B. RESPONDENT: The State. ACT: Evidence Act, section 3. HEADNOTE: The appeal fails. JUDGMENT: We dismiss it.",
    "The lessee pays twenty-five thousand three hundred and six dollars, Two Million units or one hundred; none and someone, hundred twelve.",
    "\"Lessee\" means the person named, “ Term ” shall mean two years and \"Act\" has the meaning given; \"quoted\" says nothing.",
    "",
)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return table(spark, d, "documents").select("doc_id", "text").union(own)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


T = "t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL VALUES " + ", ".join(f"({-1 - i}, {_quoted(t)})" for i, t in enumerate(TEXTS)) + ")"


def _sql(kind: str, fields: str = "", where: str = "true") -> str:
    """Matches with their places: what a split leaves before the i-th match, and the matches before it."""
    p = _quoted(records.PATTERNS[kind])
    return f"""
WITH {T},
m AS (SELECT doc_id, regexp_extract_all(text, {p}) AS v, regexp_split_to_array(text, {p}) AS between_ FROM t),
s AS (SELECT doc_id, i, v[i] AS text, between_[i] AS before,
        list_sum(list_transform(between_[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS start
      FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m)),
r AS (SELECT doc_id, i, start::INT AS start, (start + length(text))::INT AS "end", text{fields.replace('$P', p)} FROM s)
SELECT * EXCLUDE (i), (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS nth FROM r WHERE {where}"""


def _g(n: int) -> str:
    return f"regexp_extract(text, $P, {n})"


def _case(key: str, values: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_quoted(k)} THEN {v if not isinstance(v, str) else _quoted(v)}" for k, v in values.items()) + " END"


_num = lambda x: f"CAST(nullif(replace({x}, ',', ''), '') AS DOUBLE)"
_CUSIP_SUM = "list_sum(list_transform(range(1, 9), lambda k: ((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#', text[k]) - 1) * (CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)) // 10 + ((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#', text[k]) - 1) * (CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)) % 10))"
_WORTH = f"""list_reduce(list_prepend({{'t': 0::DOUBLE, 'c': 0::DOUBLE, 'm': 0::DOUBLE}}, list_transform(regexp_split_to_array(lower(text), '[ -]+'),
    lambda w: {{'t': 0::DOUBLE, 'c': coalesce({_case('w', records.NUMBER_WORDS)}, 0)::DOUBLE, 'm': coalesce({_case('w', records.SCALE_WORDS)}, 0)::DOUBLE}})),
  lambda a, w: {{'t': CASE WHEN w.m >= 1000 THEN a.t + greatest(a.c, 1) * w.m ELSE a.t END, 'c': CASE WHEN w.m >= 1000 THEN 0 WHEN w.m = 100 THEN greatest(a.c, 1) * 100 ELSE a.c + w.c END, 'm': 0::DOUBLE}})"""
_SQL = {
    "number_words": (f", {_WORTH}.t + {_WORTH}.c AS value", "true"),
    "definition": (f", trim({_g(1)}) AS term, {_g(2)} AS verb", "true"),
    "ssn": (f", {_g(1)} || '-' || {_g(2)} || '-' || {_g(3)} AS value", "NOT regexp_matches(value, '^000|-00-|0000$')"),
    "phone": (f", {_g(1)} AS area, {_g(2)} AS exchange, {_g(3)} AS last4", "true"),
    "cusip": (f", {_g(1)} AS issuer, {_g(2)} AS issue, {_g(3)}::INT AS checksum, (10 - {_CUSIP_SUM} % 10) % 10 = {_g(3)}::INT AS valid, regexp_matches({_g(1)}, '^(?:[0-9]{{3}}99[0-9A-Z]|99[0-9]{{3}}[0-9A-Z])$') AS internal, regexp_matches(text, '[@#*]') AS private", "true"),
    "act": (f", nullif({_g(1)}, '') AS section, {_g(2)} AS act_name, nullif({_g(3)}, '')::INT AS year", "true"),
    "percent": (f", {_num(_g(2))} * CASE WHEN {_g(1)} = '-' THEN -1 ELSE 1 END AS amount, {_g(3)} AS unit, round({_num(_g(2))} * CASE WHEN {_g(1)} = '-' THEN -1 ELSE 1 END * CASE WHEN regexp_matches({_g(3)}, 'bps|basis') THEN 0.0001 ELSE 0.01 END, 4) AS fraction", "true"),
    "ratio": (f", {_g(1)}::DOUBLE AS \"left\", {_g(2)}::DOUBLE AS \"right\", round({_g(1)}::DOUBLE / nullif({_g(2)}::DOUBLE, 0), 4) AS ratio, {_g(3)} <> '' AS is_time", "NOT is_time"),
    "distance": (f", {_num(_g(1))} AS amount, CASE WHEN {_g(2)} LIKE 'k%' THEN 'kilometer' ELSE 'mile' END AS unit", "true"),
    "duration": (f", {_num(_g(1))} AS amount, {_g(2)} AS unit, round({_num(_g(1))} * CASE {_g(2)} WHEN 'second' THEN 1 / 86400 WHEN 'minute' THEN 1 / 1440 WHEN 'hour' THEN 1 / 24 WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'quarter' THEN 90 WHEN 'year' THEN 365 END, 4) AS days", "true"),
    "money": (f", round({_num(f'({_g(2)} || {_g(4)})')} * {_case(f'({_g(3)} || {_g(5)})', records.FACTORS)}, 4) AS amount, coalesce({_case(f'({_g(1)} || {_g(6)})', records.CURRENCIES)}, {_g(1)} || {_g(6)}) AS currency", "true"),
    "regulation": (f", CASE WHEN {_g(4)} <> '' THEN 'Public Law' WHEN {_g(5)} <> '' THEN 'Stat.' ELSE replace({_g(2)}, '.', '') END AS source, {_g(3)} || {_g(4)} || {_g(6)} AS name, nullif({_g(1)} || {_g(5)}, '') AS volume", "true"),
    "copyright": (f", {_g(1)} AS sign, {_g(2)} AS date, rtrim(trim(regexp_replace({_g(3)}, '[ \t\n]+', ' ', 'g')), ',') AS name", "true"),
    "trademark": ("", "true"),
    "url": ("", "true"),
    "date": (f", try_strptime({_g(1)} || ' ' || {_g(2)} || ' ' || {_g(3)}, '%B %-d %Y')::DATE AS date", "true"),
    "reporter_page": (f", {_g(1)}::INT AS volume, replace({_g(2)}, ' ', '') AS reporter, {_g(3)}::INT AS page, nullif({_g(4)}, '')::INT AS page2, nullif(trim({_g(5)}), '') AS court, nullif({_g(6)}, '')::INT AS year", "true"),
    "public_law": (f", {_g(1)}::INT AS congress, {_g(2)}::INT AS number", "true"),
    "section_mention": (f", {_g(1)} AS section", "true"),
    "condition": (f", lower(regexp_replace({_g(1)}, '[ \t\n]+', ' ', 'g')) AS phrase, before", "true"),
    "constraint": (f", lower(regexp_replace({_g(1)}, '[ \t\n]+', ' ', 'g')) AS phrase, before", "true"),
}


def _records(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _texts(spark, d).select("doc_id", F.posexplode(records.records(kind, F.col("text"))).alias("nth", "r")).select("doc_id", "nth", "r.*")

    return run


for _kind, (_fields, _where) in _SQL.items():
    QUERIES[f"records_{_kind}"] = _records(_kind)
    ORACLES[f"records_{_kind}"] = _sql(_kind, _fields, _where)


def _listed(column):
    return lambda spark, d: _texts(spark, d).select("doc_id", F.explode(column(F.col("text"))).alias("value"))


QUERIES["legal_reporter_citations"] = _listed(legal.reporter_citations)
ORACLES["legal_reporter_citations"] = f"""
WITH {T}, x AS ({' UNION ALL '.join(f"SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(p)})) AS v FROM t" for p in legal.REPORTERS)})
SELECT DISTINCT doc_id, regexp_replace(upper(trim(v)), '\\s+', '_', 'g') AS value FROM x"""

_ACT_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(b)), {_quoted(p)}) THEN {_quoted(n)}" for p, n in legal.ACTS)


def statutes_sql(words: int, texts: str = T) -> str:
    """Statutes of the table t that ``texts`` defines."""
    pairs = lambda p: f"SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(p)}, 1)) AS a, unnest(regexp_extract_all(text, {_quoted(p)}, 2)) AS b FROM bare"
    return f"""
WITH {texts}, bare AS (SELECT doc_id, regexp_replace(text, '<[^>]+>', ' ', 'g') AS text FROM t),
named AS ({pairs(legal.SECTION_OF)} UNION ALL {pairs(legal.ARTICLE_OF)}),
capital AS (SELECT doc_id, a, b, list_filter(regexp_split_to_array(b, '\\s+'), lambda w: regexp_matches(w, '^[A-Z]'))[1:{words}] AS c FROM named WHERE a <> '' AND length(trim(b)) > 3)
SELECT DISTINCT doc_id, 'S' || upper(regexp_replace(a, '\\s+', '', 'g')) || '_' || {_ACT_CASE} ELSE CASE WHEN len(c) > 0 THEN array_to_string(c, '_') ELSE 'UnknownAct' END END AS value FROM capital
UNION SELECT doc_id, 'O' || upper(a) || '_R' || b || '_CPC' FROM ({pairs(legal.ORDER_RULE)})
UNION SELECT doc_id, 'S' || upper(a) || '_' || upper(b) FROM ({pairs(legal.SECTION_SHORT)})"""


QUERIES["legal_statutes"] = _listed(legal.statutes)
ORACLES["legal_statutes"] = statutes_sql(3)
QUERIES["legal_statutes_two_words"] = _listed(lambda t: legal.statutes(t, 2))
ORACLES["legal_statutes_two_words"] = statutes_sql(2)
for _name, _patterns in (("concepts", legal.CONCEPTS), ("entities", legal.ENTITIES)):
    QUERIES[f"legal_{_name}"] = lambda spark, d, p=_patterns: _texts(spark, d).select("doc_id", F.explode(legal.concepts(F.col("text"), p)).alias("value")).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))
    ORACLES[f"legal_{_name}"] = f"""
WITH {T}, x AS ({' UNION ALL '.join(f"SELECT doc_id, unnest(regexp_extract_all(lower(text), {_quoted(p)})) AS v FROM t" for p in _patterns)})
SELECT doc_id, replace(v, ' ', '_') AS value, count(*) AS n FROM x GROUP BY ALL"""

QUERIES["legal_co_cited_pairs"] = lambda spark, d: _texts(spark, d).select("doc_id", F.explode(legal.co_cited_pairs(F.col("text"))).alias("p")).groupBy("doc_id", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
ORACLES["legal_co_cited_pairs"] = f"""
WITH {T}, p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[0-9]+\\.\\s+')) AS para, generate_subscripts(regexp_split_to_array(text, '\\n[0-9]+\\.\\s+'), 1) AS k FROM t),
c AS (SELECT DISTINCT doc_id, k, unnest(regexp_extract_all(para, '<CITATION_([0-9]+)>', 1)) AS e FROM p)
SELECT x.doc_id, x.e AS a, y.e AS b, count(*) AS n FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.k = y.k AND x.e < y.e GROUP BY ALL"""
QUERIES["legal_citation_counts"] = lambda spark, d: _texts(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("<CITATION_([0-9]+)>"), F.lit(1))).alias("cited")).groupBy("doc_id", "cited").agg(F.count(F.lit(1)).alias("n"))
ORACLES["legal_citation_counts"] = f"WITH {T}, c AS (SELECT doc_id, unnest(regexp_extract_all(text, '<CITATION_([0-9]+)>', 1)) AS cited FROM t) SELECT doc_id, cited, count(*) AS n FROM c GROUP BY ALL"

QUERIES["legal_sections"] = lambda spark, d: _texts(spark, d).select("doc_id", F.explode(legal.sections(F.col("text"))).alias("section", "body"))
ORACLES["legal_sections"] = f"""
WITH {T}, m AS (SELECT doc_id, ['PREAMBLE'] || list_transform(regexp_extract_all(text, {_quoted(legal.SECTION_HEAD)}, 1), lambda x: upper(x)) AS h, regexp_split_to_array(text, {_quoted(legal.SECTION_HEAD)}) AS p FROM t),
x AS (SELECT doc_id, i, h[i] AS section, CASE WHEN i = 1 THEN p[i] ELSE trim(regexp_replace(p[i], '^\\s+|\\s+$', '', 'g')) END AS body FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m))
SELECT doc_id, section, body FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY i DESC) = 1"""
QUERIES["legal_fact_and_issue"] = lambda spark, d: _texts(spark, d).select("doc_id", legal.fact_and_issue(F.col("text")).alias("x")).select("doc_id", F.length("x.fact").alias("fact_chars"), F.length("x.issue").alias("issue_chars"), F.md5("x.fact").alias("fact_md5"), F.md5("x.issue").alias("issue_md5"))
ORACLES["legal_fact_and_issue"] = f"""
WITH s AS ({ORACLES['legal_sections'].strip()}),
x AS (SELECT doc_id, coalesce(max(body) FILTER (section = 'JUDGMENT'), '') AS f, trim(concat_ws(' ', max(body) FILTER (section = 'HEADNOTE'), max(body) FILTER (section = 'ACT'))) AS i FROM s GROUP BY 1),
y AS (SELECT doc_id, text, f, i FROM x JOIN (WITH {T} SELECT * FROM t) USING (doc_id)),
z AS (SELECT doc_id, CASE WHEN f = '' AND i = '' THEN text[1:length(text) // 2] WHEN f = '' THEN i ELSE f END AS fact, CASE WHEN f = '' AND i = '' THEN text[length(text) // 2 + 1:] WHEN i = '' THEN f ELSE i END AS issue FROM y)
SELECT doc_id, length(fact)::INT AS fact_chars, length(issue)::INT AS issue_chars, md5(fact) AS fact_md5, md5(issue) AS issue_md5 FROM z"""
