"""Registry of the engine's queries, each over its whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import extract
from docloom.operators import dense, evaluate, rank, score, sets
from docloom.operators.index import TermIndex
from docloom.sources.tables import stamp

FLAGSHIP = "tfidf_log_top10"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Indexes of a session: one for each state of a table and each way to build it.
_STORED: dict[tuple, TermIndex] = {}


def _index(spark: SparkSession, d: str, **how) -> TermIndex:
    """The stored index of ``documents``, built when first asked for; one with words of its own is built each time."""
    build = lambda: TermIndex.build(table(spark, d, "documents").select("doc_id", "text"), **how)
    if "tokens" in how:
        return build()
    key = (spark.sparkContext.applicationId, stamp(spark, f"{d}/documents.parquet"), *sorted(how.items()))
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _tokens(name: str, key: str, ngram: int = 1) -> str:
    grams = " UNION ALL ".join(f"SELECT {key}, array_to_string(t[p:p + {n - 1}], '_') AS term FROM (SELECT {key}, t, unnest(range(1, len(t) - {n} + 2)) AS p FROM tok_{name} WHERE len(t) >= {n})" for n in range(1, ngram + 1))
    return f"""tok_{name} AS (SELECT {key}, list_filter(string_split(regexp_replace(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '[^a-z]', ' ', 'g'), ' '), lambda x: length(x) >= 2) AS t FROM {name}),
{name}_p AS (SELECT {key}, term, count(*) AS tf FROM ({grams}) GROUP BY ALL)"""


def _base(ngram: int = 1, min_df: int = 1, max_df: float = 1.0) -> str:
    return f"""WITH {_tokens('documents', 'doc_id', ngram)}, {_tokens('benchmark', 'item_id')},
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM documents_p) / (SELECT count(*) FROM documents) AS avgdl),
l AS (SELECT doc_id, sum(tf) AS dl, max(tf) AS maxtf FROM documents_p GROUP BY 1),
t AS (SELECT term, count(*) AS df FROM documents_p GROUP BY 1 HAVING count(*) >= {min_df} AND count(*) <= floor((SELECT n FROM n) * {max_df}))"""


_TF = {"raw": "tf", "log": "1 + ln(tf)", "binary": "1.0", "augmented": "0.5 + 0.5 * tf / maxtf", "log1p": "ln(1 + tf)", "sublinear": "ln(1 + ln(1 + tf))"}
_BM = {"okapi": "tf * (k1 + 1) / (tf + k1 * norm)", "l": "(k1 + 1) * (tf / norm + 0.5) / (k1 + tf / norm + 0.5)", "plus": "((k1 + 1) * tf + 1.0) / (tf + k1 * norm)"}


def _tfidf_sql(scheme: str, **how) -> str:
    w = f"({_TF[scheme]}) * (ln((n + 1) / (df + 1)) + 1)"
    return f"""{_base(**how)},
d AS (SELECT doc_id, term, {w} AS w FROM documents_p JOIN t USING (term) JOIN l USING (doc_id), n),
q AS (SELECT item_id, term, {w} AS w FROM benchmark_p JOIN t USING (term) JOIN (SELECT item_id, max(tf) AS maxtf FROM benchmark_p GROUP BY 1) USING (item_id), n),
run AS (SELECT item_id AS query_id, doc_id, round(sum(q.w * d.w) / (any_value(nd) * any_value(nq)), 6) AS score FROM q JOIN d USING (term)
  JOIN (SELECT doc_id, sqrt(sum(w * w)) AS nd FROM d GROUP BY 1) USING (doc_id) JOIN (SELECT item_id, sqrt(sum(w * w)) AS nq FROM q GROUP BY 1) USING (item_id) GROUP BY 1, 2)"""


def _bm25_sql(kind: str, k1: float, idf: str = "ln((n - df + 0.5) / (df + 0.5) + 1)") -> str:
    return f"""{_base()}, run AS (SELECT item_id AS query_id, doc_id, round(sum({idf} * {_BM[kind]}), 6) AS score FROM
  (SELECT *, {k1} AS k1, 1 - 0.75 + 0.75 * dl / avgdl AS norm FROM (SELECT item_id, term FROM benchmark_p) JOIN t USING (term) JOIN documents_p USING (term) JOIN l USING (doc_id), n) GROUP BY 1, 2)"""


_TOP = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM run QUALIFY rank <= {k}"

for _s in _TF:
    QUERIES[f"tfidf_{_s}_top10"] = lambda spark, d, s=_s: rank.top(score.tfidf(_index(spark, d), _asked(spark, d), s), 10)
    ORACLES[f"tfidf_{_s}_top10"] = f"{_tfidf_sql(_s)} {_TOP.format(k=10)}"
QUERIES["tfidf_log_bigram_min_df_top10"] = lambda spark, d: rank.top(score.tfidf(_index(spark, d, ngram=2, min_df=2, max_df=0.95), _asked(spark, d), "log"), 10)
ORACLES["tfidf_log_bigram_min_df_top10"] = f"{_tfidf_sql('log', ngram=2, min_df=2, max_df=0.95)} {_TOP.format(k=10)}"
for _s, _k1, _delta in (("okapi", 1.2, 0.0), ("l", 1.5, 0.5), ("plus", 1.2, 1.0)):
    QUERIES[f"bm25_{_s}_top10"] = lambda spark, d, s=_s, k1=_k1, delta=_delta: rank.top(score.bm25(_index(spark, d), _asked(spark, d), s, k1, delta=delta), 10)
    ORACLES[f"bm25_{_s}_top10"] = f"{_bm25_sql(_s, _k1)} {_TOP.format(k=10)}"
QUERIES["bm25_idf_minus1_top10"] = lambda spark, d: rank.top(score.bm25(_index(spark, d), _asked(spark, d), "okapi", 1.6, idf="minus1"), 10)
ORACLES["bm25_idf_minus1_top10"] = f"{_bm25_sql('okapi', 1.6, 'ln((n + 1) / (df + 1))')} {_TOP.format(k=10)}"


def _two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    index, asked = _index(spark, d), _asked(spark, d)
    return score.tfidf(index, asked, "log"), score.bm25(index, asked)


def _both_sql(fusion: str) -> str:
    a, b = _tfidf_sql("log").replace("run AS (", "runa AS ("), _bm25_sql("okapi", 1.2)
    return f"{a}, runb AS ({b.split('run AS (', 1)[1]}, {fusion}"


QUERIES["fusion_rrf_top10"] = lambda spark, d: rank.top(rank.rrf(*_two_runs(spark, d)), 10)
_RR = "SELECT query_id, doc_id, 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)) AS s, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM run{0} QUALIFY r <= 1000"
ORACLES["fusion_rrf_top10"] = _both_sql(f"run AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM ({_RR.format('a')} UNION ALL {_RR.format('b')}) GROUP BY 1, 2) {_TOP.format(k=10)}")
QUERIES["fusion_minmax_top10"] = lambda spark, d: (lambda r: rank.top(rank.fuse(rank.minmax(r[0]), rank.minmax(r[1]), 0.7), 10))(_two_runs(spark, d))
_MM = "SELECT query_id, doc_id, {1} * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-12) AS s FROM run{0} WINDOW w AS (PARTITION BY query_id)"
ORACLES["fusion_minmax_top10"] = _both_sql(f"run AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM ({_MM.format('a', 0.7)} UNION ALL {_MM.format('b', 1 - 0.7)}) GROUP BY 1, 2) {_TOP.format(k=10)}")
QUERIES["fusion_znorm_top10"] = lambda spark, d: (lambda r: rank.top(rank.fuse(rank.znorm(r[0]), rank.znorm(r[1]), 0.7), 10))(_two_runs(spark, d))
_ZN = "SELECT query_id, doc_id, {1} * CASE WHEN stddev_pop(score) OVER w < 1e-10 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END AS s FROM run{0} WINDOW w AS (PARTITION BY query_id)"
ORACLES["fusion_znorm_top10"] = _both_sql(f"run AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM ({_ZN.format('a', 0.7)} UNION ALL {_ZN.format('b', 1 - 0.7)}) GROUP BY 1, 2) {_TOP.format(k=10)}")


def _qrels(spark: SparkSession, d: str) -> evaluate.ByLabel:
    """Dense retrieval's gold: vectors of the query's label, itself excluded."""
    v = table(spark, d, "embeddings")
    return evaluate.ByLabel(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label"), v.select(F.col("vec_id").alias("doc_id"), "label"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return rank.top(dense.best(v.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "v"), v, 20, own=False), 20)


_DENSE = f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
run AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v)) + 1e-10), 6) AS score FROM v q, v d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
top AS ({_TOP.format(k=20)}),
rel AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id FROM v q JOIN v d USING (label) WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
j AS (SELECT top.*, n, (rel.doc_id IS NOT NULL)::INT AS hit, sum((rel.doc_id IS NOT NULL)::INT) OVER (PARTITION BY top.query_id ORDER BY rank) AS hits FROM top JOIN nr USING (query_id) LEFT JOIN rel ON rel.query_id = top.query_id AND rel.doc_id = top.doc_id)"""
QUERIES["dense_cosine_top20"] = _dense
ORACLES["dense_cosine_top20"] = f"{_DENSE} SELECT * FROM top"
QUERIES["evaluate_per_query_at_10"] = lambda spark, d: evaluate.per_query(_dense(spark, d), _qrels(spark, d), 10)
ORACLES["evaluate_per_query_at_10"] = f"""{_DENSE}, g AS (SELECT query_id, sum(hit) AS h, any_value(n) AS n, sum(hit * hits / rank) AS ap, sum(hit / log2(rank + 1)) AS dcg, coalesce(max(hit / rank), 0) AS rr FROM j WHERE rank <= 10 GROUP BY 1)
SELECT query_id, round(h / 10, 6) AS p, round(h / n, 6) AS r, round(CASE WHEN h = 0 THEN 0 ELSE 2 * (h / 10) * (h / n) / (h / 10 + h / n) END, 6) AS f1, round(ap / least(n, 10), 6) AS ap,
  round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda x: 1 / log2(x + 1))), 6) AS ndcg, round(rr, 6) AS rr FROM g"""
QUERIES["evaluate_micro_f1_by_k"] = lambda spark, d: evaluate.micro_f1(_dense(spark, d), _qrels(spark, d))
ORACLES["evaluate_micro_f1_by_k"] = f"""{_DENSE}, c AS (SELECT rank AS k, sum(sum(hit)) OVER (ORDER BY rank) AS h, sum(count(*)) OVER (ORDER BY rank) AS m, (SELECT count(*) FROM rel) AS rel FROM j GROUP BY rank)
SELECT k, round(h / m, 6) AS precision, round(h / rel, 6) AS recall, round(CASE WHEN h = 0 THEN 0 ELSE 2 * (h / m) * (h / rel) / (h / m + h / rel) END, 6) AS f1 FROM c"""

# Plain relational operators: one SQL text that both engines read. A case (order) cites its parts.
_CITES = "WITH c AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS e FROM lineitem), s AS (SELECT a, count(*) AS n FROM c GROUP BY a)"
_PAIRS = f"{_CITES}, p AS (SELECT x.a AS a, y.a AS b, count(*) AS shared FROM c x JOIN c y ON x.e = y.e AND x.a < y.a GROUP BY x.a, y.a)"
_SHARED: dict[str, str] = {
    "set_similarity": f"{_PAIRS} SELECT p.a, p.b, shared, round(shared / sqrt(CAST(m.n AS DOUBLE) * k.n), 6) AS coupling, round(CAST(shared AS DOUBLE) / (m.n + k.n - shared), 6) AS jaccard, round(2.0 * CAST(shared AS DOUBLE) / (m.n + k.n), 6) AS dice, round(CAST(shared AS DOUBLE) / least(m.n, k.n), 6) AS overlap, round(CAST(shared AS DOUBLE) / m.n, 6) AS recall FROM p JOIN s m ON m.a = p.a JOIN s k ON k.a = p.b WHERE shared >= 2",
    "co_citation": f"{_CITES} SELECT x.e AS a, y.e AS b, count(*) AS n_citing FROM c x JOIN c y ON x.a = y.a AND x.e < y.e GROUP BY x.e, y.e",
    "idf_cosine": f"{_CITES}, i AS (SELECT e, ln(CAST((SELECT count(*) FROM s) + 1 AS DOUBLE) / (count(*) + 1)) + 1 AS w FROM c GROUP BY e), z AS (SELECT a, sqrt(sum(w * w)) AS z FROM c JOIN i ON c.e = i.e GROUP BY a), d AS (SELECT x.a AS a, y.a AS b, sum(w * w) AS dot, count(*) AS shared FROM c x JOIN c y ON x.e = y.e AND x.a < y.a JOIN i ON i.e = x.e GROUP BY x.a, y.a) SELECT d.a, d.b, round(dot / (m.z * k.z), 6) AS cosine FROM d JOIN z m ON m.a = d.a JOIN z k ON k.a = d.b WHERE shared >= 2",
    "event_jaccard": "WITH c AS (SELECT DISTINCT user_id AS a, concat(event_type, '|', CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR(20))) AS e FROM events), s AS (SELECT a, count(*) AS n FROM c GROUP BY a), p AS (SELECT x.a AS a, y.a AS b, count(*) AS shared FROM c x JOIN c y ON x.e = y.e AND x.a < y.a GROUP BY x.a, y.a) SELECT p.a, p.b, round(CAST(shared AS DOUBLE) / (m.n + k.n - shared), 6) AS jaccard FROM p JOIN s m ON m.a = p.a JOIN s k ON k.a = p.b",
    "graph_summary": f"{_PAIRS} SELECT (SELECT count(*) FROM s) AS n_cases, (SELECT count(DISTINCT e) FROM c) AS n_labels, (SELECT count(*) FROM c) AS n_case_label, (SELECT count(*) FROM p) AS n_case_case",
    "graph_top_labels": f"{_CITES} SELECT e AS label, count(*) AS n_cases FROM c GROUP BY e ORDER BY n_cases DESC, label LIMIT 20",
    "graph_label_distribution": f"{_CITES} SELECT n AS label_count, count(*) AS n_cases FROM s GROUP BY n",
    "graph_hub_cases": f"{_PAIRS} SELECT case_id, count(*) AS degree FROM (SELECT a AS case_id FROM p UNION ALL SELECT b AS case_id FROM p) u GROUP BY case_id ORDER BY degree DESC, case_id LIMIT 20",
    "graph_label_co_occurrence": f"{_CITES} SELECT x.e AS l1, y.e AS l2, count(*) AS n FROM c x JOIN c y ON x.a = y.a AND x.e < y.e GROUP BY x.e, y.e ORDER BY n DESC, l1, l2 LIMIT 20",
    "graph_shared_histogram": f"{_PAIRS} SELECT CASE WHEN shared = 1 THEN '1' WHEN shared = 2 THEN '2' WHEN shared <= 4 THEN '3-4' ELSE '5+' END AS bucket, count(*) AS n FROM p GROUP BY 1",
    "graph_unlabelled_cases": "SELECT count(*) AS n FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey",
    "graph_edge_weights": f"{_PAIRS} SELECT round(avg(shared), 2) AS mean, max(shared) AS largest, min(shared) AS smallest FROM p",
    "graph_strongest_pairs": f"{_PAIRS} SELECT a, b, shared FROM p ORDER BY shared DESC, a, b LIMIT 20",
    "graph_dense_clusters": f"{_PAIRS}, o AS (SELECT a, count(*) AS degree FROM p WHERE shared >= 2 GROUP BY a HAVING count(*) >= 1) SELECT degree, count(*) AS n FROM o GROUP BY degree",
    "corpus_statistics": "SELECT lang, source, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean, count(DISTINCT text) AS n_texts FROM documents GROUP BY lang, source",
    "role_distribution": "SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY role",
    "label_class_weights": "SELECT quality, toxic, count(*) AS n, round(CAST((SELECT count(*) FROM labels) AS DOUBLE) / count(*), 6) AS weight FROM labels GROUP BY quality, toxic",
    "neighbour_turns": "SELECT conv_id, turn, role, lag(role) OVER w AS role_before, lead(role) OVER w AS role_after, coalesce(length(lag(text) OVER w), 0) + length(text) + coalesce(length(lead(text) OVER w), 0) AS context_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
}


def _shared(sql: str):
    names = [t for t in ("lineitem", "orders", "events", "documents", "conversations", "labels") if t in sql]

    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in names:
            sql_view = f"docloom_{t}"
            table(spark, d, t).createOrReplaceTempView(sql_view)
        text = sql
        for t in names:
            for before in ("FROM", "JOIN"):
                text = text.replace(f"{before} {t}", f"{before} docloom_{t}")
        return spark.sql(text)

    return run


for _name, _sql in _SHARED.items():
    QUERIES[_name] = _shared(_sql)
    ORACLES[_name] = _sql.replace("LEFT ANTI JOIN", "ANTI JOIN")


def _event_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Users by the kinds and tens of values of their events."""
    kind = F.concat(F.coalesce("event_type", F.lit("")), F.lit("|"), F.coalesce(F.floor(F.col("value") / 10).cast("string"), F.lit("")))
    return sets.set_jaccard(table(spark, d, "events").select(F.col("user_id").alias("id"), kind.alias("element")))


QUERIES["event_jaccard"] = _event_jaccard


def _two_parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders that share two parts or more."""
    return sets.sharing_two(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("element")))


def _set_similarity(spark: SparkSession, d: str) -> DataFrame:
    shared, na, nb = F.col("shared"), F.col("na"), F.col("nb")
    scores = {"coupling": shared / F.sqrt(na.cast("double") * nb), "jaccard": shared / (na + nb - shared), "dice": 2.0 * shared / (na + nb), "overlap": shared / F.least(na, nb), "recall": shared / na}
    return _two_parts(spark, d).select("a", "b", "shared", *(F.round(c, 6).alias(n) for n, c in scores.items()))


QUERIES["set_similarity"] = _set_similarity


def _hub_cases(spark: SparkSession, d: str) -> DataFrame:
    """Orders that share a part with the most others."""
    held = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("element"))
    return sets.degrees(held).select(F.col("id").alias("case_id"), "degree").orderBy(F.desc("degree"), "case_id").limit(20)


QUERIES["graph_hub_cases"] = _hub_cases
QUERIES["idf_cosine"] = lambda spark, d: _two_parts(spark, d).select("a", "b", F.round(F.col("dot") / (F.col("za") * F.col("zb")), 6).alias("cosine"))


def _extracted(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = table(spark, d, "documents")
        found = extract.ssn(F.col("text")) if kind == "ssn" else extract.matches(kind, F.col("text"))
        return t.select("doc_id", F.posexplode(found).alias("nth", "value"))

    return run


for _kind in ("ssn", "phone", "percent", "ratio"):
    QUERIES[f"extract_{_kind}"] = _extracted(_kind)
    _all = f"regexp_extract_all(text, '{extract.PATTERNS[_kind]}', 0)"
    if _kind == "ssn":
        _all = f"list_transform(list_filter(list_transform({_all}, lambda x: replace(x, '-', '')), lambda d: d[1:3] <> '000' AND d[4:5] <> '00' AND d[6:9] <> '0000'), lambda d: d[1:3] || '-' || d[4:5] || '-' || d[6:9])"
    ORACLES[f"extract_{_kind}"] = f"SELECT doc_id, (p - 1)::INT AS nth, v[p] AS value FROM (SELECT doc_id, v, unnest(range(1, len(v) + 1)) AS p FROM (SELECT doc_id, {_all} AS v FROM documents))"
QUERIES["extract_url"] = lambda spark, d: table(spark, d, "pages").select("page_id", F.posexplode(extract.matches("url", F.col("url"))).alias("nth", "value"))
ORACLES["extract_url"] = f"SELECT page_id, (p - 1)::INT AS nth, v[p] AS value FROM (SELECT page_id, v, unnest(range(1, len(v) + 1)) AS p FROM (SELECT page_id, regexp_extract_all(url, '{extract.URL}', 0) AS v FROM pages))"
