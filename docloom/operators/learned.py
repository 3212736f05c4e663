"""Models that are trained here: a latent space of TF-IDF vectors, word vectors, a forest that ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.tables import forget, written


def sparse_rows(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, ids, ws) of unit length from ``weights`` (doc_id, term, w) and ``terms`` (term, id); a row is as long as the vocabulary at most."""
    rows = weights.join(terms, "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
    return rows.withColumn("norm", norm).filter("norm > 0").select("doc_id", F.col("x.id").alias("ids"), F.transform("x.w", lambda w: w / F.col("norm")).alias("ws"))


def _projected(batch: pd.DataFrame, basis: np.ndarray) -> np.ndarray:
    return np.array([np.asarray(ws) @ basis[np.asarray(ids, dtype=int)] for ids, ws in zip(batch["ids"], batch["ws"], strict=True)]).reshape(len(batch), basis.shape[1])


def latent_basis(rows: DataFrame, size: int, k: int, passes: int = 8, seed: int = 42) -> np.ndarray:
    """The first k right singular vectors (size x k) of ``sparse_rows`` whose ids lie below ``size``, a bounded vocabulary.

    Subspace iteration: a task turns its rows into one size x (k + 10) product, these are summed by row of the product, and
    the driver holds one such matrix. Every row counts in every pass. Fewer than k come back where ``size`` is less.
    """
    width = min(size, k + 10)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]

    def product(of: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((size, of.shape[1]))
            for batch in batches:
                for ids, ws, p in zip(batch["ids"], batch["ws"], _projected(batch, of), strict=True):
                    out[np.asarray(ids, dtype=int)] += np.outer(ws, p)
            yield pd.DataFrame({"id": np.arange(size), "p": list(out)})

        parts = rows.select("ids", "ws").mapInPandas(partial, "id int, p array<double>")
        summed = parts.groupBy("id").agg(F.array(*(F.sum(F.get("p", F.lit(i))) for i in range(of.shape[1]))).alias("p"))
        out = np.zeros((size, of.shape[1]))
        for r in summed.toLocalIterator():  # size rows
            out[r.id] = r.p
        return out

    for _ in range(passes):
        basis = np.linalg.qr(product(basis))[0]
    small = basis.T @ product(basis)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    return basis @ turned[:, np.argsort(-values)[:k]]


def latent_vectors(rows: DataFrame, basis: np.ndarray) -> DataFrame:
    """(doc_id, v): rows in the latent space."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "v": list(_projected(batch, basis))})

    return rows.mapInPandas(project, "doc_id long, v array<double>")


#: Words that ``word_vectors`` learns at most: their vectors are sent to every task.
MOST_WORDS = 200_000


def word_vectors(docs: DataFrame, tokens: Column, terms: DataFrame, size: int = 64, window: int = 5, seed: int = 42, rounds: int = 4) -> DataFrame:
    """(term, v) from how often words of ``terms`` (term), at most ``MOST_WORDS``, stand near each other (see ``factorise``)."""
    ids = _known(terms)
    return _solved(docs.sparkSession, near_pairs(docs, tokens, ids, window), ids, size, seed, rounds)[0]


def _known(terms: DataFrame) -> list[str]:
    ids = terms.select("term").filter("term IS NOT NULL").distinct().orderBy("term").limit(MOST_WORDS + 1).toPandas()["term"].tolist()
    if len(ids) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    return ids


#: Tokens whose neighbours a task counts at once.
_TOKENS = 1 << 20


def near_pairs(docs: DataFrame, tokens: Column, ids: list[str], window: int) -> DataFrame:
    """(i, j, weight) with i <= j, the places in ``ids`` of the words of ``reports.cooccurrence``; pairs with another word aren't formed.

    Pairs are numbers, summed for a million tokens at a time before they move.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = pa.array(sent.value, pa.string()), max(1, len(sent.value))
        for batch in batches:
            lists = batch.column(0)
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy().astype(np.int64)
            doc = pc.list_parent_indices(lists).to_numpy()
            for begin in range(0, len(at), _TOKENS):
                end, keys, ws = min(begin + _TOKENS, len(at)), [], []
                for d in range(1, window + 1):
                    to = min(end + d, len(at))
                    b, a = at[begin + d : to], at[begin : max(begin, to - d)]
                    own = (a >= 0) & (b >= 0) & (doc[begin : begin + len(a)] == doc[begin + d : to])
                    a, b = a[own], b[own]
                    key, times = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_counts=True)
                    keys.append(key)
                    ws.append(times / d)
                key, place = np.unique(np.concatenate(keys), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.bincount(place, np.concatenate(ws), len(key)), pa.float64())], ["key", "w"])

    sums = docs.select(tokens.alias("t")).filter("t IS NOT NULL").mapInArrow(count, "key long, w double").groupBy("key").agg(F.round(F.sum("w"), 6).alias("weight"))
    n = F.lit(max(1, len(ids)))
    return sums.select(F.floor(F.col("key") / n).cast("int").alias("i"), (F.col("key") % n).cast("int").alias("j"), "weight")


def factorise(pairs: DataFrame, terms: DataFrame, size: int = 64, seed: int = 42, rounds: int = 4, most: float = 100.0, power: float = 0.75, ridge: float = 0.1) -> tuple[DataFrame, list[float]]:
    """((term, v), losses per round): vectors whose products approach the logarithms of ``pairs`` (a, b, weight), weighted least squares.

    A pair weighs min(1, weight / most) ^ power. Words and contexts have vectors and offsets; one side is solved exactly for
    each word from the other side, in turns, so the loss falls with each step. A word's pairs are one row, of as many entries as
    there are words at most. Known words without a pair have no vector. The result doesn't depend on partitions
    but for the order of sums.
    """
    spark, ids = pairs.sparkSession, _known(terms)
    numbers = spark.createDataFrame(pd.DataFrame({"term": ids, "n": range(len(ids))}), "term string, n int")
    own = pairs.join(numbers.select(F.col("term").alias("a"), F.col("n").alias("i")), "a").join(numbers.select(F.col("term").alias("b"), F.col("n").alias("j")), "b")
    return _solved(spark, own.select("i", "j", "weight"), ids, size, seed, rounds, most, power, ridge)


def _solved(spark: SparkSession, own: DataFrame, ids: list[str], size: int, seed: int, rounds: int, most: float = 100.0, power: float = 0.75, ridge: float = 0.1) -> tuple[DataFrame, list[float]]:
    """``factorise`` of pairs (i, j, weight) of places in ``ids``."""
    if not ids:
        return spark.createDataFrame([], "term string, v array<double>"), []
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    rows = own.filter("weight > 0").select(F.inline(both), "weight").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "weight"))).alias("x"))  # a word's pairs
    near = written(rows.select("i", "x.j", "x.weight"))
    rng = np.random.default_rng(seed)
    other = np.hstack([rng.normal(0, 1 / np.sqrt(size), (len(ids), size)), np.zeros((len(ids), 1))])  # a vector and an offset

    def side(fixed: np.ndarray) -> tuple[np.ndarray, float]:
        sent = spark.sparkContext.broadcast(fixed)

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, offsets = np.hstack([sent.value[:, :-1], np.ones((len(sent.value), 1))]), sent.value[:, -1]
            for b in batches:
                ws, losses = [], []
                for j, weight in zip(b.column(1), b.column(2)):
                    j, weight = j.values.to_numpy(), weight.values.to_numpy()
                    x, y, f = vectors[j], np.log(weight) - offsets[j], np.minimum(weight / most, 1.0) ** power
                    fx = f[:, None] * x
                    # the smaller of the two equal systems
                    w = np.linalg.solve(x.T @ fx + ridge * np.eye(x.shape[1]), fx.T @ y) if len(x) > x.shape[1] else fx.T @ np.linalg.solve(x @ fx.T + ridge * np.eye(len(x)), y)
                    ws.append(w)
                    losses.append(float((f * (x @ w - y) ** 2).sum() + ridge * (w**2).sum()))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ws) + 1) * fixed.shape[1], pa.int32()), pa.array(np.concatenate(ws) if ws else np.zeros(0)))
                yield pa.RecordBatch.from_arrays([b.column(0), flat, pa.array(losses, pa.float64())], ["i", "w", "loss"])

        out = near.mapInArrow(solve, "i int, w array<double>, loss double").toPandas()
        solved = np.zeros_like(fixed)
        if len(out):
            solved[out["i"].to_numpy()] = np.stack(out["w"])
        sent.unpersist()
        return solved, float(out["loss"].sum())

    losses = []
    for _ in range(rounds):
        words, _ = side(other)
        other, loss = side(words)
        losses.append(loss + ridge * float((words**2).sum()))
    seen = np.flatnonzero(np.abs(words).sum(axis=1))
    forget(near)
    v = (words + other)[:, :-1]
    return spark.createDataFrame(pd.DataFrame({"term": [ids[i] for i in seen], "v": [v[i].tolist() for i in seen]}), "term string, v array<double>"), losses


def forest_ranker(features: DataFrame, gold: DataFrame, columns: list[str], trees: int = 50, depth: int = 6, seed: int = 42):
    """A function from features (query_id, doc_id, *columns) to a run: the share of trees' votes that a pair is relevant.

    ``gold`` (query_id, doc_id) holds the relevant pairs of the training features; null features count as 0. All pairs
    train. Both kinds must occur.
    """
    whole = VectorAssembler(inputCols=columns, outputCol="vector")
    marked = features.join(gold.select("query_id", "doc_id").distinct().withColumn("relevant", F.lit(1.0)), ["query_id", "doc_id"], "left").na.fill(0.0, [*columns, "relevant"])
    model = RandomForestClassifier(featuresCol="vector", labelCol="relevant", numTrees=trees, maxDepth=depth, seed=seed).fit(whole.transform(marked))

    def ranked(pairs: DataFrame) -> DataFrame:
        out = model.transform(whole.transform(pairs.na.fill(0.0, columns)))
        return out.select("query_id", "doc_id", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("score"))

    return ranked
