"""Queries of learned rankings: gold from shared passages, the pool of pairs, boosted trees and a forest on held-out items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import boosting, learned, rank, score
from docloom.plans.catalog import _asked, _index, table
from docloom.sources.tables import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COLUMNS = ["tfidf", "bm25", "rank_feature", "q_len", "c_len", "len_ratio", "vocab_jac"]


def _windows(df: DataFrame, key: str) -> DataFrame:
    """(key, w): distinct five-word windows of lower-case words."""
    words = df.select(key, F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z]+"), F.lit(0)).alias("t"))
    each = F.expr("IF(size(t) >= 5, transform(sequence(0, size(t) - 5), i -> concat_ws(' ', t[i], t[i + 1], t[i + 2], t[i + 3], t[i + 4])), cast(array() AS array<string>))")
    return words.select(key, F.explode(F.array_distinct(each)).alias("w"))


def passage_gold(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share at least three five-word windows with an item are relevant to it."""
    asked = _windows(_asked(spark, d), "query_id").distinct()
    # the items are a stated query set: their windows go to the documents, of which only shared windows move
    held = _windows(table(spark, d, "documents"), "doc_id").join(F.broadcast(asked), "w").distinct()
    return held.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n_shared")).filter("n_shared >= 3")


def _grams(name: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(t[i:i + 4], ' ') AS w FROM (SELECT {key}, t, unnest(range(1, len(t) - 3)) AS i FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+') AS t FROM {name}) WHERE len(t) >= 5)"


QUERIES["passage_gold"] = passage_gold
ORACLES["passage_gold"] = f"SELECT item_id AS query_id, doc_id, count(*) AS n_shared FROM ({_grams('benchmark', 'item_id')}) JOIN ({_grams('documents', 'doc_id')}) USING (w) GROUP BY ALL HAVING count(*) >= 3"


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    index, asked = _index(spark, d), _asked(spark, d)
    return written(rank.features(score.tfidf(index, asked, "log"), score.bm25(index, asked), index, asked, 50)), written(passage_gold(spark, d))


def ltr_pool(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs: the BM25 run's best 50, the relevant documents and 20 drawn ones."""
    index = _index(spark, d)
    return boosting.sample_pool(score.bm25(index, _asked(spark, d)), passage_gold(spark, d), table(spark, d, "documents").select("doc_id"), 50, 20)


def lambdamart_top10(spark: SparkSession, d: str) -> DataFrame:
    """Items of even id train, those of odd id are ranked."""
    pairs, gold = _pairs(spark, d)
    model = boosting.lambdamart(pairs.filter("query_id % 2 = 0"), gold, COLUMNS, rounds=10)
    return rank.top(model(pairs.filter("query_id % 2 = 1")), 10)


def forest_top10(spark: SparkSession, d: str) -> DataFrame:
    """The same with a forest."""
    pairs, gold = _pairs(spark, d)
    return rank.top(learned.forest_ranker(pairs.filter("query_id % 2 = 0"), gold, COLUMNS)(pairs.filter("query_id % 2 = 1")), 10)


QUERIES |= {"ltr_pool": ltr_pool, "lambdamart_top10": lambdamart_top10, "forest_top10": forest_top10}
