"""Vectors of documents: a document's vector predicts its words (distributed bag of words), word weights are shared.

A document's vector solves a logistic regression: its words, each as often as it occurs, against noise words, over the
shared word weights and with a penalty on its length. Training and inference place documents by the same solver, so vectors of
unseen texts lie in the space of the trained ones. One pass places every document, then moves the word weights by the gradients
summed over all documents, divided by a bound of their curvature; with equal noise no pass can raise the loss. A word's
documents are never gathered: only one summed gradient per word and task moves.

Defined results: words outside the vocabulary don't count; a document without a known word (null, empty) has no vector.
Repeated rows of an id count as one text. Results don't depend on partitions but for the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.learned import MOST_WORDS
from docloom.sources.tables import forget, written


@dataclass
class DocumentModel:
    """Words in the order of their rows in ``weights``, how often each is drawn as noise, losses per pass."""

    terms: list[str]
    weights: np.ndarray
    share: np.ndarray
    noise: int
    ratio: float
    ridge: float
    seed: int
    losses: list[float] = field(default_factory=list)

    def drawn(self, turn: int) -> np.ndarray:
        """Noise words of a pass; inference takes those of turn -1."""
        return np.random.default_rng([self.seed, turn + 1]).choice(len(self.terms), self.noise, p=self.share)


def word_counts(docs: DataFrame, tokens: Column, terms: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, ns): how often each known word occurs; a row is as long as the vocabulary at most."""
    spark = docs.sparkSession
    numbers = spark.createDataFrame(pd.DataFrame({"term": terms, "n": range(len(terms))}), "term string, n int")
    each = docs.filter(F.col(id_col).isNotNull()).select(id_col, F.explode(tokens).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("uses"))
    rows = each.join(numbers, "term").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("n", "uses"))).alias("x"))
    return rows.select(id_col, F.col("x.n").alias("ids"), F.col("x.uses").alias("ns"))


def solve(x: np.ndarray, y: np.ndarray, f: np.ndarray, ridge: float, steps: int = 8, least: float = 1e-7) -> tuple[np.ndarray, float]:
    """The vector that tells rows of x with label 1 from those with 0, weighed by f, and its loss.

    Newton steps, halved while they don't help, until one gains less than ``least`` of the loss.
    """
    sign = 1 - 2 * y

    def loss(z: np.ndarray, v: np.ndarray) -> float:
        return float(f @ np.logaddexp(0, sign * z) + ridge / 2 * (v @ v))

    v, z = np.zeros(x.shape[1]), np.zeros(len(x))
    best, eye = loss(z, v), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = _chance(z)
        move = np.linalg.solve((x * (f * p * (1 - p))[:, None]).T @ x + eye, x.T @ (f * (p - y)) + ridge * v)
        turn, size = x @ move, 1.0
        while (now := loss(z - size * turn, v - size * move)) > best and size > 1e-3:
            size /= 2
        if now >= best:
            break
        v, z, gain, best = v - size * move, z - size * turn, best - now, now
        if gain < least * best:
            break
    return v, best


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _case(ids: np.ndarray, ns: np.ndarray, drawn: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, labels and weights of a document: its words, and noise that weighs ``ratio`` times as much as they together."""
    y = np.concatenate([np.ones(len(ids)), np.zeros(len(drawn))])
    f = np.concatenate([ns.astype(float), np.full(len(drawn), ratio * ns.sum() / len(drawn))])
    return np.concatenate([ids, drawn]), y, f


def fit(docs: DataFrame, tokens: Column, terms: DataFrame, size: int = 64, passes: int = 8, noise: int = 256, ratio: float = 5.0, ridge: float = 1.0, seed: int = 42) -> DocumentModel:
    """Train over ``docs(doc_id, ...)``; ``terms(term)`` holds ``MOST_WORDS`` words at most, of which the driver keeps one matrix.

    Every document counts in every pass. A pass runs in as many tasks as the cluster has cores, each of which sends a
    gradient per word that it met.
    """
    spark = docs.sparkSession
    words = terms.select("term").filter("term IS NOT NULL").distinct().orderBy("term").limit(MOST_WORDS + 1).toPandas()["term"].tolist()
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    rows = written(word_counts(docs, tokens, words))
    uses = np.zeros(len(words))
    for r in rows.select(F.explode(F.arrays_zip("ids", "ns")).alias("x")).groupBy("x.ids").agg(F.sum("x.ns").alias("n")).toLocalIterator():  # one row a word
        uses[r.ids] = r.n
    if not uses.any():
        forget(rows)
        return DocumentModel([], np.zeros((0, size)), np.zeros(0), noise, ratio, ridge, seed)
    share = uses**0.75 / (uses**0.75).sum()
    model = DocumentModel(words, np.random.default_rng(seed).normal(0, 1 / np.sqrt(size), (len(words), size)), share, noise, ratio, ridge, seed)
    few = rows.coalesce(spark.sparkContext.defaultParallelism)
    for turn in range(passes):
        sent = spark.sparkContext.broadcast((model.weights, model.drawn(turn)))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, drawn = sent.value
            pull, bound, total = np.zeros_like(weights), np.zeros(len(weights)), 0.0
            noise_pull, noise_bound = np.zeros((len(drawn), weights.shape[1])), np.zeros(len(drawn))
            for b in batches:
                for ids, ns in zip(b.column(0), b.column(1)):
                    rows_, y, f = _case(ids.values.to_numpy(), ns.values.to_numpy(), drawn, ratio)
                    x = weights[rows_]
                    v, loss = solve(x, y, f, ridge, least=1e-3)  # weights move on before the last digits count
                    own, n = (f * (_chance(x @ v) - y))[:, None] * v, len(ids)
                    curve = f * (v @ v) / 4
                    pull[rows_[:n]] += own[:n]  # a document's words are distinct, noise words may repeat
                    bound[rows_[:n]] += curve[:n]
                    noise_pull += own[n:]
                    noise_bound += curve[n:]
                    total += loss
            np.add.at(pull, drawn, noise_pull)
            np.add.at(bound, drawn, noise_bound)
            met = np.flatnonzero(bound)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * weights.shape[1], pa.int32()), pa.array(pull[met].ravel()))
            losses = np.zeros(len(met))
            losses[:1] = total  # in the task's first row
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), flat, pa.array(bound[met]), pa.array(losses)], ["id", "pull", "bound", "loss"])

        parts = few.select("ids", "ns").mapInArrow(step, "id int, pull array<double>, bound double, loss double")
        out = parts.groupBy("id").agg(F.array(*(F.sum(F.get("pull", F.lit(i))) for i in range(size))).alias("pull"), F.sum("bound").alias("bound"), F.sum("loss").alias("loss")).toPandas()  # one row a word
        sent.unpersist()
        at, moved = out["id"].to_numpy(), model.weights.copy()
        moved[at] -= np.stack(out["pull"]) / (out["bound"].to_numpy() + 1e-9)[:, None]
        model.weights = moved
        model.losses.append(float(out["loss"].sum()))
    forget(rows)
    return model


def infer(model: DocumentModel, docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """(id_col, v) of ``docs``, known or unseen, by the model's word weights."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, v array<double>"
    if not model.terms:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((model.weights, model.drawn(-1)))
    ratio, ridge = model.ratio, model.ridge

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, drawn = sent.value
        for b in batches:
            vs = []
            for ids, ns in zip(b.column(1), b.column(2)):
                rows_, y, f = _case(ids.values.to_numpy(), ns.values.to_numpy(), drawn, ratio)
                vs.append(solve(weights[rows_], y, f, ridge)[0])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vs) + 1) * weights.shape[1], pa.int32()), pa.array(np.concatenate(vs) if vs else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], [id_col, "v"])

    return word_counts(docs, tokens, model.terms, id_col).mapInArrow(place, schema)
