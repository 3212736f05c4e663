"""Queries of amounts, dates, dictionary entities and sequence labels, with their DuckDB SQL.

Sentences are written from the rows of the given tables in several forms, so the values that the extractors must find
are the tables' own; dictionary and labels work on the texts as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import amounts, dates
from docloom.operators import dictionary, sequence
from docloom.plans.catalog import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _array(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _in_words(n: str) -> str:
    """SQL of a number from 1 to 99 in words."""
    ones, tens = _array(amounts.ONES), _array(["", "", *amounts.TENS])
    return f"IF({n} < 20, element_at({ones}, cast({n} + 1 AS int)), concat(element_at({tens}, cast(floor({n} / 10) + 1 AS int)), IF({n} % 10 = 0, '', concat('-', element_at({ones}, cast({n} % 10 + 1 AS int))))))"


def _cases(key: str, forms: list[str]) -> str:
    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


def _found(df: DataFrame, key: str, records, *fields: str) -> DataFrame:
    return df.select(key, F.explode(records).alias("r")).select(key, *(F.col(f"r.{f}").alias(f) for f in fields))


def _dealt(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    """Columns of a table for all cores: a small file is one task else, however long its rows take."""
    return table(spark, d, name).select(*cols).repartition(4 * spark.sparkContext.defaultParallelism)


_W = _in_words("p_size")
AMOUNT_FORMS = [
    ("{w}", "n"), ("concat(p_size, ' million')", "n * 1e6"), ("concat({w}, ' hundred')", "n * 100"), ("concat(p_size, ' and a half')", "n + 0.5"), ("concat({w}, ' thousand and 5/100')", "n * 1000 + 0.05"),
    ("concat(p_size, '½')", "n + 0.5"), ("concat({w}, ' dozen')", "n * 12"), ("concat('one hundred and ', {w})", "n + 100"), ("concat(p_size, ' and three tenths')", "n + 0.3"), ("concat(p_size, 'k')", "n * 1000"),
]


@query("amount_forms", "SELECT p_partkey, 7 AS start, round(" + _cases("p_partkey", [v for _, v in AMOUNT_FORMS]) + ", 6) AS value FROM (SELECT p_partkey, p_size::DOUBLE AS n FROM part)")
def amount_forms(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(f"concat('Units: ', {_cases('p_partkey', [f.format(w=_W) for f, _ in AMOUNT_FORMS])}, ' in stock')")
    out = _found(table(spark, d, "part"), "p_partkey", amounts.records("amount", text), "start", "value")
    return out.withColumn("value", F.round("value", 6))


MONEY_FORMS = [
    ("concat('$', format_number(p, 2))", "'USD'"), ("concat(cast(cast(p AS decimal(18,2)) AS string), ' dollars')", "'USD'"), ("concat('USD ', cast(cast(p AS decimal(18,2)) AS string))", "'USD'"),
    ("concat(format_number(p, 2), ' U.S. dollars')", "'USD'"), ("concat('€ ', cast(cast(p AS decimal(18,2)) AS string))", "'EUR'"), ("concat(cast(cast(p AS decimal(18,2)) AS string), ' pounds')", "'GBP'"),
]


@query("money_forms", f"SELECT o_orderkey, o_totalprice AS amount, {_cases('o_orderkey', [c for _, c in MONEY_FORMS])} AS currency FROM orders")
def money_forms(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").withColumn("p", F.col("o_totalprice"))
    text = F.expr(f"concat('The buyer pays ', {_cases('o_orderkey', [f for f, _ in MONEY_FORMS])}, ' on order ', o_orderkey, '.')")
    return _found(df, "o_orderkey", amounts.records("money", text), "amount", "currency")


@query("percent_forms", """SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 3 WHEN 1 THEN l_tax * 10000 WHEN 2 THEN l_tax * 100 ELSE l_tax * 100 END, 4) AS amount,
CASE l_linenumber % 3 WHEN 1 THEN 'basis points' WHEN 2 THEN '%' ELSE 'percent' END AS unit, round(l_tax, 4) AS fraction FROM lineitem""")
def percent_forms(spark: SparkSession, d: str) -> DataFrame:
    number = "cast(cast(l_tax * 100 AS decimal(9,2)) AS string)"
    text = F.expr(f"concat('a tax of ', CASE l_linenumber % 3 WHEN 1 THEN concat(cast(cast(round(l_tax * 10000) AS int) AS string), ' basis points') WHEN 2 THEN concat({number}, '%') ELSE concat({number}, ' percent') END, ' is due')")
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(amounts.records("percent", text)).alias("r"))
    return df.select("l_orderkey", "l_linenumber", F.round("r.amount", 4).alias("amount"), F.col("r.unit").alias("unit"), F.round("r.fraction", 4).alias("fraction"))


@query("duration_forms", """SELECT p_partkey, unit, round(days, 4) AS days FROM (SELECT p_partkey, unnest(CASE p_partkey % 3
  WHEN 0 THEN [{'unit': 'day', 'days': p_size * 365.0 + 7 * 30 + 10}] WHEN 1 THEN [{'unit': 'month', 'days': p_size * 30.0}] ELSE [{'unit': 'day', 'days': p_size * 1.0}, {'unit': 'week', 'days': 21.0}] END, recursive := true) FROM part)""")
def duration_forms(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(f"concat('within ', CASE p_partkey % 3 WHEN 0 THEN concat({_W}, ' years, 7 months and ten days') WHEN 1 THEN concat('a ', p_size, '-month term') ELSE concat({_W}, ' business days, three weeks') END, ' of notice')")
    return _found(table(spark, d, "part"), "p_partkey", amounts.records("duration", text), "unit", "days")


@query("ratio_and_distance_forms", "SELECT p_partkey, p_size::DOUBLE AS left_side, round(p_size / 4.0, 6) AS ratio, p_size + 0.5 AS miles FROM part WHERE p_size > 0")
def ratio_and_distance_forms(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(f"concat('odds of ', IF(p_partkey % 2 = 0, concat(p_size, ':4'), concat({_W}, ' to four')), '. A way of ', {_W}, ' and a half miles at 10:30 am')")
    both = F.struct(F.get(amounts.records("ratio", text), F.lit(0)).alias("r"), F.get(amounts.records("distance", text), F.lit(0)).alias("m"))
    # behind a generator the filter doesn't read the texts again
    return _dealt(spark, d, "part", "p_partkey", "p_size").select("p_partkey", F.inline(F.array(both))).select("p_partkey", F.col("r.left").alias("left_side"), F.col("r.ratio").alias("ratio"), F.col("m.amount").alias("miles")).filter("ratio IS NOT NULL")


@query("amounts_in_documents", "SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '" + amounts.PATTERNS["amount"].replace("'", "''") + r"'), lambda x: NOT regexp_matches(x, '^[0-9]+([./][0-9]+){2,}\.?$')))::BIGINT AS n FROM documents")
def amounts_in_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(amounts.records("amount", F.col("text"))).cast("long").alias("n"))


DATE_FORMS = [
    "date_format(o_orderdate, 'MMMM d, yyyy')", "date_format(o_orderdate, 'yyyy-MM-dd')", "date_format(o_orderdate, 'd MMMM yyyy')", "date_format(o_orderdate, 'MM/dd/yyyy')", "date_format(o_orderdate, 'MMM. d, yyyy')",
    "concat('the ', date_format(o_orderdate, 'd'), 'th day of ', date_format(o_orderdate, 'MMMM, yyyy'))", "date_format(o_orderdate, 'dd-MMM-yyyy')", "date_format(o_orderdate, 'M-d-yyyy')",
]


@query("date_forms", "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders")
def date_forms(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(f"concat('Order ', o_orderkey, ' was made as of ', {_cases('o_orderkey', DATE_FORMS)}, ', by the clerk')")
    return _found(_dealt(spark, d, "orders", "o_orderkey", "o_orderdate"), "o_orderkey", dates.dates(text), "date")


@query("date_range_forms", """SELECT o_orderkey, o_orderdate::DATE AS date, least(o_orderdate::DATE + 9, last_day(o_orderdate::DATE)) AS until FROM orders""")
def date_range_forms(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").withColumn("u", F.least(F.date_add(F.to_date("o_orderdate"), 9), F.last_day(F.to_date("o_orderdate"))))
    text = F.expr("concat('open ', date_format(o_orderdate, 'MMMM d'), IF(o_orderkey % 2 = 0, concat('-', date_format(u, 'd, yyyy')), concat(' to ', date_format(u, 'MMMM d, yyyy'))))")
    return _found(df, "o_orderkey", dates.dates(text), "date", "until")


_WORDS = r"regexp_extract_all(text, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+')"
_DICTIONARY = """SELECT item_id * 4 + k AS entity_id, alias, k = 3 AS strict, CASE WHEN k = 2 THEN 5 ELSE 0 END AS priority"""
_SQL_TOKENS = "regexp_extract_all(coalesce(text, ''), '" + dictionary.TOKEN + "')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Names from the benchmark's items: two and three opening words, two later ones of higher weight, one capitalised word."""
    w = table(spark, d, "benchmark").withColumn("w", F.expr(r"regexp_extract_all(text, '[0-9A-Za-z_\\x{80}-\\x{10FFFF}]+', 0)")).filter("size(w) >= 4")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.concat_ws(" ", F.slice("w", a, n)).alias("alias")) for k, (a, n) in enumerate([(1, 2), (1, 3), (2, 2), (1, 1)]))))
    return w.select("item_id", each.alias("e")).select((F.col("item_id") * 4 + F.col("e.k")).alias("entity_id"), "e.alias", (F.col("e.k") == 3).alias("strict"), F.when(F.col("e.k") == 2, 5).otherwise(0).alias("priority"))


_MATCHES = f"""
w AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
a AS (SELECT item_id * 4 + k AS entity_id, array_to_string(w[s:e], ' ') AS alias, k = 3 AS strict, CASE WHEN k = 2 THEN 5 ELSE 0 END AS priority FROM w, (VALUES (0, 1, 2), (1, 1, 3), (2, 2, 3), (3, 1, 1)) v(k, s, e) WHERE len(w) >= 4),
l AS (SELECT {_LOW.format('alias')} AS key, CASE WHEN strict THEN alias END AS exact, len(string_split(alias, ' ')) AS n, first(entity_id ORDER BY priority DESC, entity_id) AS entity_id, max(priority) AS priority FROM a GROUP BY ALL),
t AS (SELECT doc_id, {_SQL_TOKENS} AS t, regexp_split_to_array(coalesce(text, ''), '{dictionary.TOKEN}') AS g, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, i - 1 AS token, n, array_to_string(t[i:i + n - 1], ' ') AS word FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t), range(1, 4) r(n) WHERE i + n - 1 <= len(t)),
m AS (SELECT doc_id, token, n, entity_id, priority FROM o JOIN l USING (n) WHERE {_LOW.format('word')} = key AND (exact IS NULL OR exact = word))"""


@query("dictionary_all_matches", f"WITH {_MATCHES} SELECT doc_id, token::INT AS token, n::INT AS n, entity_id FROM m")
def dictionary_all_matches(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.entities(table(spark, d, "documents"), _dictionary(spark, d), "strict", "priority", overlaps=True).select("doc_id", "token", "n", "entity_id")


@query("dictionary_entities", f"""WITH RECURSIVE {_MATCHES},
b AS (SELECT doc_id, token, n, entity_id, token + n AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY token) AS r FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, token ORDER BY n DESC, priority DESC, entity_id) = 1),
x AS (SELECT b.*, c.token AS next FROM b ASOF LEFT JOIN b c ON b.doc_id = c.doc_id AND b.stop <= c.token),
p AS (SELECT doc_id, token, n, entity_id, next FROM x WHERE (doc_id, token) IN (SELECT (doc_id, min(token)) FROM b GROUP BY doc_id) UNION ALL SELECT x.doc_id, x.token, x.n, x.entity_id, x.next FROM p JOIN x ON x.doc_id = p.doc_id AND x.token = p.next),
s AS (SELECT p.*, t, text, (list_sum(list_transform(g[1:token + 1], lambda v: length(v))) + coalesce(list_sum(list_transform(t[1:token], lambda v: length(v))), 0))::INT AS start, g FROM p JOIN t USING (doc_id))
SELECT doc_id, start, (start + length(array_to_string(list_transform(range(1, n + 1), lambda k: CASE WHEN k > 1 THEN g[token + k] ELSE '' END || t[token + k]), '')))::INT AS "end",
  array_to_string(list_transform(range(1, n + 1), lambda k: CASE WHEN k > 1 THEN g[token + k] ELSE '' END || t[token + k]), '') AS text, entity_id FROM s""")
def dictionary_entities(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.entities(table(spark, d, "documents"), _dictionary(spark, d), "strict", "priority").select("doc_id", "start", "end", "text", "entity_id")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with what can be seen of them: a question mark, a line break, the length by powers of two."""
    seen = F.concat(F.when(F.col("text").contains("?"), "q").otherwise("-"), F.when(F.col("text").contains("\n"), "n").otherwise("-"), F.floor(F.log2(F.length(F.coalesce("text", F.lit(""))) + 1)).cast("int").cast("string"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.coalesce(seen, F.lit("")).alias("obs"), "role")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    return sequence.viterbi(turns.select("seq", "pos", "obs"), *sequence.estimated(turns, "role"))


@query("sequence_roles")
def sequence_roles(spark: SparkSession, d: str) -> DataFrame:
    """The most likely roles of all turns, from what their texts look like; ``tests/test_grammar.py`` holds it against a plain decoder."""
    return _labelled(spark, d).select(F.col("seq").alias("conv_id"), F.col("pos").alias("turn"), "obs", "state")


@query("sequence_model", r"""
WITH t AS (SELECT conv_id AS seq, turn AS pos, role AS state, (CASE WHEN contains(text, '?') THEN 'q' ELSE '-' END) || (CASE WHEN contains(text, chr(10)) THEN 'n' ELSE '-' END) || floor(log2(length(coalesce(text, '')) + 1))::INT AS obs FROM conversations),
s AS (SELECT DISTINCT state FROM t WHERE state IS NOT NULL), o AS (SELECT DISTINCT obs FROM t WHERE state IS NOT NULL),
e AS (SELECT s.state, o.obs AS seen, count(t.seq) + 1 AS c FROM s CROSS JOIN o LEFT JOIN t ON t.state = s.state AND t.obs = o.obs GROUP BY ALL),
m AS (SELECT a.state, b.state AS seen FROM t a JOIN t b ON a.seq = b.seq AND a.pos + 1 = b.pos),
g AS (SELECT x.state, y.state AS seen, count(m.state) + 1 AS c FROM s x CROSS JOIN s y LEFT JOIN m ON m.state = x.state AND m.seen = y.state GROUP BY ALL),
f AS (SELECT s.state, count(t.seq) + 1 AS c FROM s LEFT JOIN (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.seq = t.seq AND b.pos + 1 = t.pos)) t USING (state) GROUP BY ALL)
SELECT 'emission' AS kind, state, seen, round(ln(c / sum(c) OVER (PARTITION BY state)), 6) AS logp FROM e
UNION ALL SELECT 'transition', state, seen, round(ln(c / sum(c) OVER (PARTITION BY state)), 6) FROM g
UNION ALL SELECT 'start', state, '', round(ln(c / sum(c) OVER ()), 6) FROM f""")
def sequence_model(spark: SparkSession, d: str) -> DataFrame:
    e, t, s = sequence.estimated(_turns(spark, d), "role")
    rows = lambda df, kind, seen: df.select(F.lit(kind).alias("kind"), "state", seen.alias("seen"), F.round("logp", 6).alias("logp"))
    return rows(e, "emission", F.col("obs")).union(rows(t, "transition", F.col("next"))).union(rows(s, "start", F.lit("")))
