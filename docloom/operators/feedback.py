"""Pseudo-relevance feedback over a TF-IDF index: the best documents of a first run reshape the query."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators import score
from docloom.operators.index import TermIndex
from docloom.operators.rank import top
from docloom.sources.tables import written


def _unit(df: DataFrame, key: str) -> DataFrame:
    n = score.norms(df, key)
    return df.join(n, key).withColumn("w", F.when(F.col(f"norm_{key}") > 0, F.col("w") / F.col(f"norm_{key}")).otherwise(0.0)).drop(f"norm_{key}")


def _prune(vectors: DataFrame, terms: int) -> DataFrame:
    """The ``terms`` heaviest terms per query; ties with the last one stay."""
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("w", 9)))
    return vectors.withColumn("r", F.rank().over(best)).filter(F.col("r") <= terms).drop("r")


def _setting(index: TermIndex, queries: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = _unit(score.query_weights(index, queries).select("query_id", "term", "w"), "query_id")
    first = written(top(score.tfidf(index, queries), depth).select("query_id", "doc_id", "score"))
    own = index.postings.join(F.broadcast(first.select("doc_id").distinct()), "doc_id", "left_semi")  # depth documents a query
    d = written(_unit(score.doc_weights(replace(index, postings=own)), "doc_id"))
    return q, first, d


def rocchio(index: TermIndex, queries: DataFrame, depth: int = 5, alpha: float = 1.0, beta: float = 0.5, terms: int = 30) -> DataFrame:
    """(query_id, term, w): alpha q + beta mean of the feedback documents, pruned, L2-normalised."""
    q, first, d = _setting(index, queries, depth)
    n = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    mean = first.join(d, "doc_id").groupBy("query_id", "term").agg(F.sum("w").alias("s")).join(n, "query_id").select("query_id", "term", (F.col("s") / F.col("n") * beta).alias("w"))
    mixed = q.withColumn("w", F.col("w") * alpha).unionByName(mean).groupBy("query_id", "term").agg(F.sum("w").alias("w"))
    return _unit(_prune(mixed, terms), "query_id")


def rm3(index: TermIndex, queries: DataFrame, depth: int = 5, mix: float = 0.5, terms: int = 30) -> DataFrame:
    """(query_id, term, w): the L1 query model mixed with the feedback model of documents weighted by their share of the scores."""
    q, first, d = _setting(index, queries, depth)
    total = first.groupBy("query_id").agg(F.sum("score").alias("total"))
    share = first.join(total, "query_id").select("query_id", "doc_id", F.coalesce(F.try_divide("score", "total"), F.lit(0.0)).alias("p"))
    model = _l1(share.join(_l1(d, "doc_id"), "doc_id").groupBy("query_id", "term").agg(F.sum(F.col("p") * F.col("w")).alias("w")), "query_id")
    mixed = _l1(q, "query_id").withColumn("w", F.col("w") * mix).unionByName(model.withColumn("w", F.col("w") * (1 - mix)).select("query_id", "term", "w"))
    return _unit(_prune(mixed.groupBy("query_id", "term").agg(F.sum("w").alias("w")), terms), "query_id")


def _l1(df: DataFrame, key: str) -> DataFrame:
    n = df.groupBy(key).agg(F.sum("w").alias("l1"))
    return df.join(n, key).withColumn("w", F.when(F.col("l1") > 0, F.col("w") / F.col("l1")).otherwise(0.0)).drop("l1")


def search(index: TermIndex, expanded: DataFrame) -> DataFrame:
    """Run of expanded queries over the whole index."""
    return score.cosine(index, score.known(index, expanded))
