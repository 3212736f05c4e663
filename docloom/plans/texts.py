"""Queries of text functions, distributions, word ids and summed similarities, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import dense, rank, vocabulary
from docloom.plans.catalog import _TOP, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


_TOK = "t AS (SELECT item_id AS doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '[a-z]{2,}') AS t FROM benchmark)"
_WORDS = lambda: X.clean_tokens(F.col("text"))
query("distribution_tokens", f"WITH {_TOK} SELECT doc_id, item, count(*) AS n FROM (SELECT doc_id, unnest(t) AS item FROM t) GROUP BY ALL")(lambda s, d: vocabulary.distribution(_items(s, d), _WORDS()))
query("distribution_bigrams", f"WITH {_TOK}, b AS (SELECT doc_id, t, unnest(range(1, len(t))) AS p FROM t) SELECT doc_id, t[p] || '_' || t[p + 1] AS item, count(*) AS n FROM b GROUP BY ALL")(lambda s, d: vocabulary.distribution(_items(s, d), X.ngrams(_WORDS(), 2)))
query("distribution_skipgrams", f"""WITH {_TOK}, b AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS p FROM t), g AS (SELECT doc_id, t, p, unnest([1, 2]) AS k FROM b)
SELECT doc_id, t[p] || ' ' || t[p + k] AS item, count(*) AS n FROM g WHERE p + k <= len(t) GROUP BY ALL""")(lambda s, d: vocabulary.distribution(_items(s, d), X.skipgrams(_WORDS(), 1)))
for _n in (1, 2):
    query(f"distribution_char_{_n}grams", f"""WITH b AS (SELECT doc_id, text, unnest(range(1, length(text) - {_n} + 2)) AS p FROM (SELECT item_id AS doc_id, text FROM benchmark))
SELECT doc_id, substr(text, p, {_n}) AS item, count(*) AS n FROM b GROUP BY ALL""")(lambda s, d, n=_n: vocabulary.distribution(_items(s, d), X.char_ngrams(F.col("text"), n)))


@query("word_ids", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '[a-z]{2,}') AS t FROM documents),
v AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) + 1 AS id FROM (SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM w) GROUP BY 1 HAVING count(*) >= 2) ORDER BY n DESC, term LIMIT 2000),
x AS (SELECT doc_id, p, coalesce(id, 1) AS id FROM (SELECT doc_id, t[p] AS term, p FROM (SELECT doc_id, t, unnest(range(1, least(len(t), 64) + 1)) AS p FROM w)) LEFT JOIN v USING (term)),
r AS (SELECT doc_id, list(id ORDER BY p) AS ids FROM x GROUP BY 1)
SELECT doc_id, array_to_string(list_resize(coalesce(ids, []), 64, 0), ',') AS ids FROM documents LEFT JOIN r USING (doc_id)""")
def _word_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    terms = vocabulary.vocabulary(docs, _WORDS(), 2, 2000)
    return vocabulary.ids(docs, _WORDS(), terms, 64, "doc_id").select("doc_id", F.array_join("ids", ",").alias("ids"))


@query("text_forms", """SELECT doc_id, md5(regexp_replace(text, '\\r?\\n', '', 'g')) AS glued,
  md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[^a-zA-Z<>.\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 OR w IN ('a', 'i', 'A', 'I')), ' ')) AS letters,
  len(list_filter(list_transform(string_split(text, '. '), lambda s: trim(s)), lambda s: length(s) > 10))::INT AS n_long, len(regexp_extract_all(text, '[.!?]+'))::INT AS n_marks, len(regexp_extract_all(text, '[一-鿿㐀-䶿]'))::INT AS n_han FROM documents""")
def _forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    md5 = lambda c: F.md5(c.cast("binary"))
    return table(spark, d, "documents").select("doc_id", md5(X.glued_lines(t)).alias("glued"), md5(X.without_special_characters(t)).alias("letters"), F.size(X.long_sentences(t)).alias("n_long"), X.sentence_number(t).alias("n_marks"), F.size(X.han_characters(t)).alias("n_han"))


_HALF = lambda a, b: f"(list_dot_product(q.{a}, d.{b}) / (sqrt(list_dot_product(q.{a}, q.{a})) * sqrt(list_dot_product(d.{b}, d.{b})) + 1e-10))"


@query("summed_parts_top10", f"""WITH v AS (SELECT vec_id, (embedding[1:32])::DOUBLE[] AS f, (embedding[33:64])::DOUBLE[] AS i FROM embeddings),
run AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(round({_HALF('f', 'f')}, 6) + round({_HALF('i', 'i')}, 6), 6) AS score FROM v q, v d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id) {_TOP.format(k=10)}""")
def _summed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("parts"))
    return rank.top(dense.best(v.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), v, 10, own=False, parts=F.col("parts")), 10)
