"""Ranking, normalisation and fusion of runs (query_id, doc_id, score). Ties fall by doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources.tables import written


def top(run: DataFrame, k: int) -> DataFrame:
    """The best k per query with their rank from 1; the limit is pushed below the shuffle."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return run.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _stats(run: DataFrame, *aggs) -> DataFrame:
    """Per-query statistics joined back: partial sums, no window over a whole query."""
    return run.join(run.groupBy("query_id").agg(*aggs), "query_id")


def znorm(run: DataFrame) -> DataFrame:
    """(score - mean) / population deviation per query; 0 where scores don't vary."""
    s = _stats(run, F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return s.select("query_id", "doc_id", F.when(F.col("s") < 1e-10, 0.0).otherwise((F.col("score") - F.col("m")) / F.col("s")).alias("score"))


def minmax(run: DataFrame) -> DataFrame:
    s = _stats(run, F.min("score").alias("lo"), F.max("score").alias("hi"))
    return s.select("query_id", "doc_id", ((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12)).alias("score"))


def fuse(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """alpha a + (1 - alpha) b; a score that is missing in one run is 0."""
    both = a.select("query_id", "doc_id", (F.col("score") * alpha).alias("s")).union(b.select("query_id", "doc_id", (F.col("score") * (1 - alpha)).alias("s")))
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def boost(a: DataFrame, c: DataFrame, beta: float) -> DataFrame:
    """s (1 + beta c). Products of six-place scores fall on halves of the last place: those are decided on the double, as SQL does, not on its shortest decimal."""
    product = F.col("score") * (1 + beta * F.coalesce("c", F.lit(0.0)))
    return a.join(c.select("query_id", "doc_id", F.col("score").alias("c")), ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.round(product * 1e6) / 1e6).alias("score"))


def rrf(*runs: DataFrame, k: int = 60, depth: int = 1000) -> DataFrame:
    """Reciprocal rank fusion of runs."""
    parts = [top(r, depth).select("query_id", "doc_id", (1.0 / (k + F.col("rank"))).alias("s")) for r in runs]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def pool_hybrid(base: DataFrame, other: DataFrame, alpha: float, depth: int) -> DataFrame:
    """Ranks (query_id, doc_id, rank): z-norm mix inside the base's top ``depth``, the rest behind it in base order.

    A pool document that ``other`` lacks has 0 there before the norm.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    b = base.withColumn("base_rank", F.row_number().over(order)).join(other.select("query_id", "doc_id", F.col("score").alias("o")), ["query_id", "doc_id"], "left")
    pool = b.filter(F.col("base_rank") <= depth).withColumn("o", F.coalesce("o", F.lit(0.0)))
    m = pool.groupBy("query_id").agg(F.avg("score").alias("m1"), F.stddev_pop("score").alias("s1"), F.avg("o").alias("m2"), F.stddev_pop("o").alias("s2"))
    z = lambda x, m, s: F.when(F.col(s) < 1e-10, 0.0).otherwise((F.col(x) - F.col(m)) / F.col(s))
    mixed = pool.join(m, "query_id").select("query_id", "doc_id", "base_rank", F.round(alpha * z("score", "m1", "s1") + (1 - alpha) * z("o", "m2", "s2"), 6).alias("mix"))
    rest = b.filter(F.col("base_rank") > depth).select("query_id", "doc_id", "base_rank", F.lit(None).cast("double").alias("mix"))
    last = W.partitionBy("query_id").orderBy(F.desc_nulls_last("mix"), "base_rank")
    return mixed.unionByName(rest).select("query_id", "doc_id", F.row_number().over(last).alias("rank"))


def fuse3(t: DataFrame, c: DataFrame, m: DataFrame, alpha: float, beta: float) -> DataFrame:
    """alpha t + beta c + max(0, 1 - alpha - beta) m over the documents of t; missing scores are 0."""
    one = lambda df, n: df.select("query_id", "doc_id", F.col("score").alias(n))
    j = t.join(one(c, "c"), ["query_id", "doc_id"], "left").join(one(m, "m"), ["query_id", "doc_id"], "left")
    return j.select("query_id", "doc_id", F.round(alpha * F.col("score") + beta * F.coalesce("c", F.lit(0.0)) + max(0.0, 1 - alpha - beta) * F.coalesce("m", F.lit(0.0)), 6).alias("score"))


def maxnorm(run: DataFrame) -> DataFrame:
    """Scores over the query's largest (1 where that isn't positive)."""
    s = _stats(run, F.max("score").alias("hi"))
    return s.select("query_id", "doc_id", F.round(F.col("score") / F.when(F.col("hi") > 0, F.col("hi")).otherwise(1.0), 6).alias("score"))


def rank_feature(run: DataFrame) -> DataFrame:
    """1 - rank / N with ranks from 0, N the query's documents."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    r = run.withColumn("r", F.row_number().over(order) - 1).join(run.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id")
    return r.select("query_id", "doc_id", F.round(1 - F.col("r") / F.col("n"), 6).alias("score"))


def hard_negatives(run: DataFrame, qrels: DataFrame, k: int = 50) -> DataFrame:
    """The best k documents per query that are neither relevant nor the query itself."""
    wrong = run.filter("query_id <> doc_id").join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return top(wrong, k)


def rerank_pool(pool: DataFrame, run: DataFrame) -> DataFrame:
    """``pool(query_id, doc_id, pos)`` by score; a document that the run lacks has 0, a query that it lacks keeps its order."""
    known = run.select("query_id").distinct().withColumn("known", F.lit(True))
    p = pool.join(run.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left").join(known, "query_id", "left")
    s = F.when(F.col("known"), F.coalesce("score", F.lit(0.0))).otherwise(0.0)
    scored = p.withColumn("score", s)
    return scored.select("query_id", "doc_id", "score", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pos")).alias("rank"))


def weighted_fields(runs: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Sum of w s over the fields' runs, divided by the sum of all weights."""
    whole, out = sum(weights.values()), None
    for name, run in runs.items():
        part = run.select("query_id", "doc_id", (F.col("score") * (weights[name] / whole)).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def chunk_scores(pairs: DataFrame, how: str = "max", n: int = 3) -> DataFrame:
    """Run from chunk pairs (query_id, doc_id, q_chunk, d_chunk, sim).

    ``max``: best pair; ``mean``: mean over the query's chunks of their best; ``sum``: sum of the n best of the
    document chunks' best.
    """
    key = ["query_id", "doc_id"]
    if how == "max":
        return pairs.groupBy(*key).agg(F.round(F.max("sim"), 6).alias("score"))
    if how == "mean":
        return pairs.groupBy(*key, "q_chunk").agg(F.max("sim").alias("s")).groupBy(*key).agg(F.round(F.avg("s"), 6).alias("score"))
    best = pairs.groupBy(*key, "d_chunk").agg(F.max("sim").alias("s"))
    ranked = best.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("s"), "d_chunk")))
    return ranked.filter(F.col("r") <= n).groupBy(*key).agg(F.round(F.sum("s"), 6).alias("score"))


def znorm_smoothed(run: DataFrame, eps: float = 1e-10) -> DataFrame:
    """(score - mean) / (population deviation + eps) per query."""
    s = _stats(run, F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return s.select("query_id", "doc_id", ((F.col("score") - F.col("m")) / (F.col("s") + eps)).alias("score"))


def minmax_or_zero(run: DataFrame) -> DataFrame:
    """Scores on 0 to 1 per query; 0 where they don't vary."""
    s = _stats(run, F.min("score").alias("lo"), F.max("score").alias("hi"))
    return s.select("query_id", "doc_id", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("score"))


def complete_top(run: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``top`` over every candidate: documents without a common term have score 0 and follow by doc_id.

    A query needs k such documents at most and misses k of the smallest ids at most, so the 2k smallest ids are enough.
    """
    best = top(run, k)
    few = docs.select("doc_id").distinct().orderBy("doc_id").limit(2 * k)
    zero = queries.select("query_id").distinct().crossJoin(F.broadcast(few)).join(best, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))  # 2k rows a query
    return top(best.select("query_id", "doc_id", "score").unionByName(zero), k)


def two_stage(first: DataFrame, second: DataFrame, depth: int, alpha: float) -> DataFrame:
    """The first run's best ``depth`` documents, scored by alpha z(first) + (1 - alpha) z(second) inside that pool."""
    pool = top(first, depth).select("query_id", "doc_id", "score")
    other = pool.select("query_id", "doc_id").join(second, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return fuse(znorm(pool), znorm(other), alpha)


def features(tfidf: DataFrame, bm25: DataFrame, index, queries: DataFrame, depth: int) -> DataFrame:
    """Features of the pairs in the BM25 run's best ``depth``: both scores, the rank as a share, lengths, their ratio and the Jaccard similarity of the vocabularies."""
    from docloom.operators.index import postings

    short = written(top(bm25, depth).withColumnRenamed("score", "bm25"))  # depth pairs a query
    pairs = F.broadcast(short.select("query_id", "doc_id"))
    tfidf = tfidf.join(pairs, ["query_id", "doc_id"], "left_semi")
    q = postings(queries, "query_id")
    ql = q.groupBy("query_id").agg(F.first("dl").alias("ql"), F.count(F.lit(1)).alias("qn"))
    own = written(index.postings.join(F.broadcast(short.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "term", "dl"))
    cl = own.groupBy("doc_id").agg(F.first("dl").alias("cl"), F.count(F.lit(1)).alias("cn"))
    common = own.join(pairs, "doc_id").join(q.select("query_id", "term"), ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    j = short.join(tfidf.withColumnRenamed("score", "tfidf"), ["query_id", "doc_id"], "left").join(ql, "query_id").join(cl, "doc_id").join(common, ["query_id", "doc_id"]).crossJoin(F.broadcast(index.size))  # one row
    r = lambda c, n: F.round(c, 6).alias(n)
    a, b = F.col("ql") + 1, F.col("cl") + 1
    return j.select("query_id", "doc_id", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"), "bm25", (1 - F.col("rank") / F.col("n_docs")).alias("rank_feature"), r(F.log(a) / 10, "q_len"), r(F.log(b) / 10, "c_len"), r(F.least(a, b) / F.greatest(a, b), "len_ratio"), r(F.col("c") / (F.col("qn") + F.col("cn") - F.col("c")), "vocab_jac"))


def by_role_sets(turns: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(roles, n_conversations, n_turns, n_chars) of every non-empty set of roles, from one pass that deals a turn to the sets holding its role."""
    from itertools import combinations

    names = [x for n in range(1, len(roles) + 1) for x in combinations(sorted(roles), n)]
    sets_ = F.array(*(F.struct(F.lit("+".join(x)).alias("roles"), F.array(*map(F.lit, x)).alias("members")) for x in names))
    dealt = turns.select("conv_id", "text", F.explode(F.filter(sets_, lambda s: F.array_contains(s["members"], F.col("role")))).alias("s"))
    return dealt.groupBy("s.roles").agg(F.count_distinct("conv_id").alias("n_conversations"), F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


def seeded_sample(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """(id, draw): n rows by the order of a seeded hash of their id, the same on any partitioning."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    return rows.select(id_col, draw.alias("draw")).orderBy("draw", id_col).limit(n)
