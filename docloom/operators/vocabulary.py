"""Word ids: a vocabulary by frequency, texts as padded rows of ids, counted distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAD, UNKNOWN = 0, 1


def vocabulary(docs: DataFrame, tokens: Column, least: int = 2, size: int = 50_000) -> DataFrame:
    """(term, id) of the ``size`` most frequent terms of at least ``least`` uses, from id 2 on; ties by the term."""
    counts = docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    most = counts.orderBy(F.desc("n"), "term").limit(size)  # a bounded vocabulary, so one window over it is bounded too
    return most.select("term", (F.row_number().over(W.orderBy(F.desc("n"), "term")) + 1).alias("id"))


def ids(docs: DataFrame, tokens: Column, terms: DataFrame, length: int, id_col: str) -> DataFrame:
    """(id_col, ids): the first ``length`` tokens as ids, unknown ones as 1, filled up with 0."""
    first = docs.select(id_col, F.slice(tokens, 1, length).alias("t"))
    words = first.select(id_col, F.posexplode("t").alias("pos", "term")).join(terms, "term", "left").select(id_col, "pos", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))
    rows = words.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))  # at most ``length`` entries
    every = docs.select(id_col).join(rows, id_col, "left")
    own = F.coalesce("ids", F.array().cast("array<int>"))
    return every.select(id_col, F.concat(own, F.array_repeat(F.lit(PAD), F.lit(length) - F.size(own))).alias("ids"))


def distribution(docs: DataFrame, items: Column, id_col: str = "doc_id") -> DataFrame:
    """(id_col, item, n) of the items of each row's array."""
    return docs.select(id_col, F.explode(items).alias("item")).groupBy(id_col, "item").agg(F.count(F.lit(1)).alias("n"))
