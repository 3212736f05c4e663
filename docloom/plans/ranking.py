"""Queries of evaluation summaries, further term weights, completed and staged rankings, features, roles and triplets, with their DuckDB SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import STOPWORDS, clean_tokens, cumulative_ngrams
from docloom.operators import evaluate, rank, score, sets
from docloom.operators.index import TermIndex, postings
from docloom.plans.catalog import _BM, _TOP, _asked, _base, _index, _tfidf_sql, table
from docloom.plans.experiments import _EV, _judged
from docloom.plans.legal import T, _texts
from docloom.functions import legal
from docloom.sources.tables import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# Evaluation. x, h, rel and nr are the run without own documents, its hits, the gold and its sizes (``_EV``).
_PER_K = """
ks AS (SELECT unnest([5, 10, 20]) AS k),
run_ids AS (SELECT DISTINCT query_id FROM top),
cum AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM h),
per AS (SELECT r.query_id, k, coalesce(n, 0) AS g,
    coalesce(sum(hit) FILTER (rank <= k), 0) AS h, count(rank) FILTER (rank <= k) AS m,
    coalesce(sum(hit * hits / rank) FILTER (rank <= k), 0) AS ap, coalesce(sum(hit / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg,
    coalesce(sum(hit * hits / rank), 0) AS all_ap, coalesce(max(hit / rank), 0) AS rr, coalesce(sum(hit) FILTER (rank <= n), 0) AS rp
  FROM run_ids r CROSS JOIN ks LEFT JOIN nr USING (query_id) LEFT JOIN cum ON cum.query_id = r.query_id GROUP BY r.query_id, k, n)"""
_IDCG = "list_sum(list_transform(range(1, least(g, k)::BIGINT + 1), lambda x: 1 / log2(x + 1)))"


@query("eval_summary", f"""{_EV}, {_PER_K}
SELECT k, count(*) FILTER (g > 0) AS n_queries, round(avg(h / k) FILTER (g > 0), 6) AS p, round(avg(h / g) FILTER (g > 0), 6) AS r,
  round(avg(CASE WHEN h = 0 THEN 0 ELSE 2 * (h / k) * (h / g) / (h / k + h / g) END) FILTER (g > 0), 6) AS f1, round(avg(dcg / {_IDCG}) FILTER (g > 0), 6) AS ndcg,
  round(avg(ap / least(g, k)) FILTER (g > 0), 6) AS map_at_k, round(avg(all_ap / g) FILTER (g > 0), 6) AS map, round(avg(rr) FILTER (g > 0), 6) AS mrr,
  round(avg(rp / g) FILTER (g > 0), 6) AS r_precision, round(2 * sum(h) / (sum(m) + sum(g)), 6) AS micro_f1 FROM per GROUP BY k""")
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(*_judged(spark, d))


@query("eval_macro_official", f"""{_EV}, ok AS (SELECT * FROM top WHERE query_id <> doc_id AND doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 > 0)),
o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ok),
j AS (SELECT o.*, (rel.doc_id IS NOT NULL)::INT AS hit FROM o LEFT JOIN rel USING (query_id, doc_id) WHERE rank <= 7),
c AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM j),
per AS (SELECT nr.query_id, n AS g, 7 AS k, coalesce(sum(hit), 0) AS h, coalesce(sum(hit * hits / rank), 0) AS ap, coalesce(sum(hit / log2(rank + 1)), 0) AS dcg, coalesce(max(hit / rank), 0) AS rr FROM nr LEFT JOIN c USING (query_id) GROUP BY ALL)
SELECT count(*) AS n_queries, round(avg(h / 7), 6) AS prec, round(avg(h / g), 6) AS rec, round(avg(CASE WHEN h = 0 THEN 0 ELSE 2 * (h / 7) * (h / g) / (h / 7 + h / g) END), 6) AS f1,
  round(avg(ap / least(g, 7)), 6) AS ap, round(avg(rr), 6) AS rr, round(avg(dcg / {_IDCG}), 6) AS ndcg FROM per""")
def _macro_official(spark: SparkSession, d: str) -> DataFrame:
    run, rel = _judged(spark, d)
    pool = table(spark, d, "embeddings").filter("vec_id % 3 > 0").select(F.col("vec_id").alias("doc_id"))  # the candidate list
    return evaluate.macro_official(run, rel, 7, pool)


@query("eval_by_threshold", f"""{_EV}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND rel.doc_id IS NOT NULL) AS tp, count(*) FILTER (score >= threshold) AS n FROM t, top LEFT JOIN rel USING (query_id, doc_id) WHERE top.query_id <> top.doc_id GROUP BY 1),
d AS (SELECT threshold, tp, coalesce(tp / nullif(n, 0), 0) AS p, tp / (SELECT count(*) FROM rel) AS r FROM c)
SELECT threshold, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM d""")
def _by_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.by_threshold(*_judged(spark, d), (0.1, 0.2, 0.3, 0.5))


# Term weights.
def _weighted(scheme: str, formula: str) -> str:
    """TF-IDF cosine where a weight may use the document's length."""
    w = f"({formula}) * (ln((n + 1) / (df + 1)) + 1)"
    return f"""{_base()},
d AS (SELECT doc_id, term, {w} AS w FROM documents_p JOIN t USING (term) JOIN l USING (doc_id), n),
q AS (SELECT item_id, term, {w} AS w FROM benchmark_p JOIN t USING (term) JOIN (SELECT item_id, sum(tf) AS dl FROM benchmark_p GROUP BY 1) USING (item_id), n),
run AS (SELECT item_id AS query_id, doc_id, round(sum(q.w * d.w) / (any_value(nd) * any_value(nq)), 6) AS score FROM q JOIN d USING (term)
  JOIN (SELECT doc_id, sqrt(sum(w * w)) AS nd FROM d GROUP BY 1) USING (doc_id) JOIN (SELECT item_id, sqrt(sum(w * w)) AS nq FROM q GROUP BY 1) USING (item_id) GROUP BY 1, 2)
{_TOP.format(k=10)}"""


for _s, _f in (("saturation", "tf / (tf + 1.0)"), ("pivot", "(1 + ln(1 + ln(tf))) / (0.7 + 0.3 * dl / avgdl)")):
    query(f"tfidf_{_s}_top10", _weighted(_s, _f))(lambda spark, d, s=_s: rank.top(score.tfidf(_index(spark, d), _asked(spark, d), s), 10))

_CAP = "t AS (SELECT term, count(*) AS df FROM documents_p GROUP BY 1"
query("tfidf_max_features_top10", _tfidf_sql("log").replace(_CAP, "t AS (SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM documents_p GROUP BY 1 ORDER BY total DESC, term LIMIT 5000)").replace("5000) HAVING count(*) >= 1 AND count(*) <= floor((SELECT n FROM n) * 1.0)", "5000)") + " " + _TOP.format(k=10))(
    lambda spark, d: (lambda docs: rank.top(score.tfidf(TermIndex.over(written(postings(docs, "doc_id", unique=True)), docs, max_features=5000), _asked(spark, d), "log"), 10))(table(spark, d, "documents").select("doc_id", "text")))

_STOPPED = ", ".join(f"'{w}'" for w in STOPWORDS)


def _stopped(n: int):
    tokens = lambda: cumulative_ngrams(clean_tokens(F.col("text"), stopwords=STOPWORDS), n)
    return lambda spark, d: rank.top(score.tfidf(_index(spark, d, tokens=tokens()), _asked(spark, d), "log", tokens=tokens()), 10)


for _n in (1, 3):
    _sql = _tfidf_sql("log", ngram=_n).replace("lambda x: length(x) >= 2)", f"lambda x: length(x) >= 2 AND x NOT IN ({_STOPPED}))")
    _one = "benchmark_p AS (SELECT item_id, term, count(*) AS tf FROM (" + "SELECT item_id, array_to_string(t[p:p + 0], '_') AS term FROM (SELECT item_id, t, unnest(range(1, len(t) - 1 + 2)) AS p FROM tok_benchmark WHERE len(t) >= 1)"
    _more = _one + "".join(f" UNION ALL SELECT item_id, array_to_string(t[p:p + {m - 1}], '_') AS term FROM (SELECT item_id, t, unnest(range(1, len(t) - {m} + 2)) AS p FROM tok_benchmark WHERE len(t) >= {m})" for m in range(2, _n + 1))
    query(f"tfidf_stopped_{_n}gram_top10", f"{_sql.replace(_one, _more)} {_TOP.format(k=10)}")(_stopped(_n))

_BM25_RUN = "(SELECT *, {k1} AS k1, 1 - 0.75 + 0.75 * dl / avgdl AS norm FROM (SELECT item_id, term, tf AS qtf FROM benchmark_p) JOIN t USING (term) JOIN documents_p USING (term) JOIN l USING (doc_id), n)"
query("bm25_floor_top10", f"""{_base()}, i AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM t, n), a AS (SELECT avg(idf) AS mean FROM i),
run AS (SELECT item_id AS query_id, doc_id, round(sum(qtf * CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END * {_BM['okapi']}), 6) AS score FROM {_BM25_RUN.format(k1=1.5)} JOIN i USING (term), a GROUP BY 1, 2) {_TOP.format(k=10)}""")(
    lambda spark, d: rank.top(score.bm25_floor(_index(spark, d), _asked(spark, d)), 10))
_OKAPI = f"run AS (SELECT item_id AS query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * {_BM['okapi']}), 6) AS score FROM {_BM25_RUN.format(k1=1.2)} GROUP BY 1, 2)"
query("bm25_all_candidates_top10", f"""{_base()}, {_OKAPI.replace('run AS', 'hit AS')},
run AS (SELECT q.item_id AS query_id, d.doc_id, coalesce(score, 0) AS score FROM (SELECT item_id FROM benchmark UNION ALL SELECT -1) q CROSS JOIN documents d LEFT JOIN hit ON hit.query_id = q.item_id AND hit.doc_id = d.doc_id) {_TOP.format(k=10)}""")(
    lambda spark, d: (lambda asked: rank.complete_top(score.bm25(_index(spark, d), asked), asked, table(spark, d, "documents"), 10))(_asked(spark, d).union(spark.createDataFrame([(-1, "zzzzqqqq")], "query_id long, text string"))))


# Norms and stages.
_Z = "SELECT query_id, doc_id, {w} * (score - avg(score) OVER w) / (stddev_pop(score) OVER w{eps}) AS s FROM {run} WINDOW w AS (PARTITION BY query_id)"


def _both(runs: str) -> str:
    return f"{_tfidf_sql('log').replace('run AS (', 'runa AS (')}, {_OKAPI.replace('run AS', 'runb AS')}, {runs}"


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    index, asked = _index(spark, d), _asked(spark, d)
    return score.tfidf(index, asked, "log"), score.bm25(index, asked)


query("fusion_znorm_smoothed_top10", _both(f"run AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM ({_Z.format(w=0.6, eps=' + 1e-10', run='runa')} UNION ALL {_Z.format(w=0.4, eps=' + 1e-10', run='runb')}) GROUP BY 1, 2) {_TOP.format(k=10)}"))(
    lambda spark, d: (lambda a, b: rank.top(rank.fuse(rank.znorm_smoothed(a), rank.znorm_smoothed(b), 0.6), 10))(*_runs(spark, d)))
_MZ = "SELECT query_id, doc_id, {w} * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS s FROM {run} WINDOW w AS (PARTITION BY query_id)"
query("fusion_minmax_or_zero_top10", _both(f"run AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM ({_MZ.format(w=0.5, run='runa')} UNION ALL {_MZ.format(w=0.5, run='runb')}) GROUP BY 1, 2) {_TOP.format(k=10)}"))(
    lambda spark, d: (lambda a, b: rank.top(rank.fuse(rank.minmax_or_zero(a), rank.minmax_or_zero(b), 0.5), 10))(*_runs(spark, d)))
_ZZ = "SELECT query_id, doc_id, {w} * CASE WHEN stddev_pop(score) OVER w < 1e-10 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END AS s FROM {run} WINDOW w AS (PARTITION BY query_id)"
query("two_stage_top10", _both(f"""pool AS (SELECT query_id, doc_id, score FROM runb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50),
other AS (SELECT pool.query_id, pool.doc_id, coalesce(runa.score, 0) AS score FROM pool LEFT JOIN runa USING (query_id, doc_id)),
run AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM ({_ZZ.format(w=0.3, run='pool')} UNION ALL {_ZZ.format(w=0.7, run='other')}) GROUP BY 1, 2) {_TOP.format(k=10)}"""))(
    lambda spark, d: (lambda a, b: rank.top(rank.two_stage(b, a, 50, 0.3), 10))(*_runs(spark, d)))


# Features of a shortlist's pairs for learning to rank.
@query("ltr_features", _both("""short AS (SELECT query_id, doc_id, score AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM runb QUALIFY rank <= 20),
dq AS (SELECT item_id AS query_id, sum(tf) AS ql, count(*) AS qn FROM benchmark_p GROUP BY 1), dd AS (SELECT doc_id, sum(tf) AS cl, count(*) AS cn FROM documents_p GROUP BY 1),
common AS (SELECT b.item_id AS query_id, d.doc_id, count(*) AS c FROM benchmark_p b JOIN documents_p d USING (term) GROUP BY 1, 2)
SELECT s.query_id, s.doc_id, coalesce(a.score, 0) AS tfidf, bm25, 1 - rank / (SELECT count(*) FROM documents) AS rank_feature, round(ln(ql + 1) / 10, 6) AS q_len, round(ln(cl + 1) / 10, 6) AS c_len,
  round(least(ql + 1, cl + 1) / greatest(ql + 1, cl + 1), 6) AS len_ratio, round(c / (qn + cn - c), 6) AS vocab_jac
FROM short s LEFT JOIN runa a USING (query_id, doc_id) JOIN dq USING (query_id) JOIN dd USING (doc_id) JOIN common USING (query_id, doc_id)"""))
def _features(spark: SparkSession, d: str) -> DataFrame:
    index, asked = _index(spark, d), _asked(spark, d)
    return rank.features(score.tfidf(index, asked, "log"), score.bm25(index, asked), index, asked, 20)


# Roles, triplets, pairs, configurations, samples.
@query("role_power_set", "WITH r AS (SELECT DISTINCT role FROM conversations WHERE role IS NOT NULL), c AS (SELECT conv_id, turn, role, text FROM conversations), " + """
s AS (SELECT * FROM (VALUES """ + ", ".join("(" + ", ".join(("'" + "+".join(x) + "'", "[" + ", ".join(f"'{r}'" for r in x) + "]")) + ")" for n in (1, 2, 3) for x in combinations(("assistant", "system", "user"), n)) + """) v(roles, members))
SELECT roles, count(DISTINCT conv_id) AS n_conversations, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM s JOIN c ON list_contains(members, role) GROUP BY roles""")
def _role_power_set(spark: SparkSession, d: str) -> DataFrame:
    return rank.by_role_sets(table(spark, d, "conversations"), ("assistant", "system", "user"))


# Deliveries as triplets: the supplier's name in blanks, how it ships, the part's name. Half of the suppliers and one word of the parts' names are known entities.
_DELIVERED = "lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey"
_TRIPLETS = f"SELECT l_orderkey AS c, ' ' || s_name || ' ' AS a, l_returnflag AS r, p_name AS b FROM {_DELIVERED}"
_ENTITIES = f"SELECT DISTINCT l_orderkey AS c, s_name AS name, 'ORG' AS type FROM {_DELIVERED} WHERE s_suppkey % 2 = 0 UNION ALL SELECT DISTINCT l_orderkey, split_part(p_name, ' ', 2), 'THING' FROM {_DELIVERED} WHERE p_size % 3 = 0"


@query("typed_triplets", f"""WITH t AS (SELECT c, trim(a) AS a, r, trim(b) AS b FROM ({_TRIPLETS})), e AS ({_ENTITIES}),
k AS (SELECT t.*, x.type AS ka, y.type AS kb FROM t LEFT JOIN e x ON x.c = t.c AND x.name = a LEFT JOIN e y ON y.c = t.c AND y.name = b),
w AS (SELECT k.*, unnest(string_split(CASE WHEN ka IS NOT NULL THEN b ELSE a END, ' ')) AS word FROM k WHERE ka IS NOT NULL OR kb IS NOT NULL),
m AS (SELECT w.c, a, r, b, ka, kb, list(DISTINCT type) FILTER (type IS NOT NULL) AS kinds FROM w LEFT JOIN e ON e.c = w.c AND e.name = word GROUP BY ALL),
o AS (SELECT c, a, r, b, ka, kb, unnest(coalesce(kinds, ['None'])) AS kw FROM m UNION ALL SELECT c, a, r, b, ka, kb, 'None' FROM k WHERE ka IS NULL AND kb IS NULL)
SELECT DISTINCT c::BIGINT AS case_id, CASE WHEN ka IS NOT NULL THEN ka ELSE kw END AS type1, a AS entity1, r AS relation, CASE WHEN ka IS NOT NULL THEN kw ELSE coalesce(kb, 'None') END AS type2, b AS entity2 FROM o""")
def _typed_triplets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    triplets = rows.select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("entity1"), F.col("l_returnflag").alias("relation"), F.col("p_name").alias("entity2"))
    known = lambda where, name, kind: rows.filter(where).select(F.col("l_orderkey").alias("case_id"), name.alias("name"), F.lit(kind).alias("type")).distinct()
    return sets.typed_triplets(triplets, known("s_suppkey % 2 = 0", F.col("s_name"), "ORG").union(known("p_size % 3 = 0", F.split_part("p_name", F.lit(" "), F.lit(2)), "THING")))


_GRAPH = f"""t AS (SELECT c AS case_id, a AS entity1, r AS relation, b AS entity2, min(l) AS pos FROM (SELECT l_orderkey AS c, s_name AS a, l_returnflag AS r, p_name AS b, l_linenumber AS l FROM {_DELIVERED}) GROUP BY ALL),
s AS (SELECT case_id, name, min(at_) AS at_ FROM (SELECT case_id, entity1 AS name, pos * 2 AS at_ FROM t UNION ALL SELECT case_id, entity2, pos * 2 + 1 FROM t) GROUP BY ALL),
n AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY at_, name) AS node, name FROM s),
k AS (SELECT DISTINCT o_orderkey AS case_id FROM orders)"""


def _case_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    triplets = rows.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("pos"), F.col("s_name").alias("entity1"), F.col("l_returnflag").alias("relation"), F.col("p_name").alias("entity2"))
    return sets.entity_graph(triplets, table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id")))


@query("entity_graph_nodes", f"WITH {_GRAPH} SELECT case_id, node, name FROM n UNION ALL SELECT case_id, 0, NULL FROM k")
def _graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _case_graph(spark, d)[0]


@query("entity_graph_edges", f"""WITH {_GRAPH},
b AS (SELECT t.*, x.node AS e1, y.node AS e2 FROM t JOIN n x ON x.case_id = t.case_id AND x.name = entity1 JOIN n y ON y.case_id = t.case_id AND y.name = entity2)
SELECT case_id, pos * 6 + k AS seq, CASE k WHEN 0 THEN e1 WHEN 1 THEN e2 WHEN 3 THEN e1 WHEN 5 THEN e2 ELSE 0 END AS src, CASE k WHEN 0 THEN e2 WHEN 1 THEN e1 WHEN 2 THEN e1 WHEN 4 THEN e2 ELSE 0 END AS dst,
  CASE WHEN k < 2 THEN relation WHEN k < 4 THEN entity1 ELSE entity2 END AS label FROM b, range(6) r(k)
UNION ALL SELECT case_id, x - 2, 0, 0, NULL FROM k, range(2) r(x)""")
def _graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _case_graph(spark, d)[1]


@query("co_cite_cosine", """WITH c AS (SELECT DISTINCT l_suppkey AS id, l_orderkey AS o, l_partkey AS p FROM lineitem),
f AS (SELECT id, p // 10 AS a, o % 20 AS b, count(*) AS n FROM c GROUP BY ALL), z AS (SELECT id, sqrt(sum(n * n)) AS z FROM f GROUP BY 1),
d AS (SELECT x.id AS query_id, y.id AS doc_id, sum(x.n * y.n) AS dot FROM f x JOIN f y ON x.a = y.a AND x.b = y.b AND x.id <> y.id GROUP BY 1, 2)
SELECT query_id, doc_id, round(dot / (u.z * v.z), 6) AS score FROM d JOIN z u ON u.id = query_id JOIN z v ON v.id = doc_id""")
def _co_cite_cosine(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.expr("l_partkey div 10").alias("a"), F.expr("l_orderkey % 20").alias("b"), "l_orderkey", "l_partkey")
    return sets.co_cite_cosine(sets.co_cite_counts(c))


@query("legal_pairs_cosine", f"""WITH {T.replace("t AS (", "t0 AS (", 1)}, t AS (SELECT * FROM t0 UNION ALL SELECT -101, '1 <CITATION_1> <CITATION_3>' UNION ALL SELECT -102, '<CITATION_9> <CITATION_3> <CITATION_1>'),
p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[0-9]+\\.\\s+')) AS para, generate_subscripts(regexp_split_to_array(text, '\\n[0-9]+\\.\\s+'), 1) AS k FROM t),
c AS (SELECT DISTINCT doc_id, k, unnest(regexp_extract_all(para, '<CITATION_([0-9]+)>', 1)) AS e FROM p),
f AS (SELECT x.doc_id AS id, x.e AS a, y.e AS b, count(*) AS n FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.k = y.k AND x.e < y.e GROUP BY ALL), z AS (SELECT id, sqrt(sum(n * n)) AS z FROM f GROUP BY 1),
d AS (SELECT x.id AS query_id, y.id AS doc_id, sum(x.n * y.n) AS dot FROM f x JOIN f y ON x.a = y.a AND x.b = y.b AND x.id <> y.id GROUP BY 1, 2)
SELECT query_id, doc_id, round(dot / (u.z * v.z), 6) AS score FROM d JOIN z u ON u.id = query_id JOIN z v ON v.id = doc_id""")
def _legal_pairs_cosine(spark: SparkSession, d: str) -> DataFrame:
    more = spark.createDataFrame([(-101, "1 <CITATION_1> <CITATION_3>"), (-102, "<CITATION_9> <CITATION_3> <CITATION_1>")], "doc_id long, text string")
    pairs = _texts(spark, d).union(more).select(F.col("doc_id").alias("id"), F.explode(legal.co_cited_pairs(F.col("text"))).alias("p"))
    return sets.co_cite_cosine(pairs.groupBy("id", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n")))


@query("seeded_sample", "SELECT doc_id, md5('42:' || doc_id) AS draw FROM documents ORDER BY draw, doc_id LIMIT 50")
def _seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return rank.seeded_sample(table(spark, d, "documents"), "doc_id", 50, 42)


@query("report_by_config", """WITH c AS (SELECT lang, source, length(text) AS n FROM documents)
SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr, round(avg(n), 6) AS mean, max(n) AS longest FROM c GROUP BY source""")
def _report_by_config(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").withColumn("n", F.length("text"))
    counts = c.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)
    return counts.join(c.groupBy(F.col("source").alias("s")).agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("longest")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
