"""Learning to rank by boosted trees over listwise gradients (LambdaMART), with its pool of training pairs.

Each round turns a query's pairs into gradients of NDCG: a relevant pair that stands below another one is pulled up by
what swapping the two would gain. A regression tree is fitted to the gradients, its leaves take Newton steps (summed
gradients over summed curvatures), and the scores move by a part of them. Gradients are made per query, whose pairs
are bounded by the pool; trees, leaves and scores are Spark jobs over all pairs, and each round's scores are a written
table that replaces the one before.

Defined results: null features count as 0. Queries without a relevant or without another pair give no gradients. Equal
scores stand by doc_id. Trees and draws follow from the seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.rank import top
from docloom.sources.tables import forget, written

_KEYS = ["query_id", "doc_id"]


def sample_pool(run: DataFrame, gold: DataFrame, docs: DataFrame, depth: int, negatives: int, seed: int = 42) -> DataFrame:
    """(query_id, doc_id, relevant): the run's best ``depth`` pairs, all relevant ones, and up to ``negatives`` others drawn by a seeded hash.

    Documents lie in as many buckets as there are documents, each shown by its smallest id; a query draws buckets, so
    nothing is paired with everything. Drawn pairs that are in the pool or relevant already don't count as negatives.
    """
    rel = gold.select(*_KEYS).distinct()
    best = top(run, depth).select(*_KEYS)
    n = max(docs.count(), 1)
    bucket = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(n))
    shown = docs.filter("doc_id IS NOT NULL").groupBy(bucket("doc_id").alias("bucket")).agg(F.min("doc_id").alias("doc_id"))
    tries = F.explode(F.sequence(F.lit(1), F.lit(3 * negatives))) if negatives else F.explode(F.array().cast("array<int>"))
    drawn = best.select("query_id").distinct().select("query_id", tries.alias("draw")).withColumn("bucket", bucket("query_id", "draw")).join(shown, "bucket")
    own = best.union(rel.join(best.select("query_id").distinct(), "query_id", "left_semi")).distinct()
    new = drawn.groupBy(*_KEYS).agg(F.min("draw").alias("draw")).join(own, _KEYS, "left_anti")
    new = top(new.select(*_KEYS, (-F.col("draw")).cast("double").alias("score")), negatives).select(*_KEYS)
    return own.union(new).join(rel.withColumn("relevant", F.lit(1)), _KEYS, "left").select(*_KEYS, F.coalesce("relevant", F.lit(0)).alias("relevant"))


def gradients(relevant: np.ndarray, scores: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of one query's pairs, which come in the order of their ids."""
    order = np.argsort(-scores, kind="stable")
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    discount = np.where(place < cut, 1 / np.log2(place + 2), 0.0)
    ideal = (1 / np.log2(np.arange(min(cut, int(relevant.sum()))) + 2)).sum()
    up, down = np.flatnonzero(relevant == 1), np.flatnonzero(relevant == 0)
    pull, bend = np.zeros(len(scores)), np.zeros(len(scores))
    if not len(up) or not len(down):
        return pull, bend
    worth = np.abs(discount[up][:, None] - discount[down][None]) / ideal
    rho = 1 / (1 + np.exp(np.clip(scores[up][:, None] - scores[down][None], -50, 50)))
    step, curve = worth * rho, worth * rho * (1 - rho)
    pull[up], pull[down] = step.sum(axis=1), -step.sum(axis=0)
    bend[up], bend[down] = curve.sum(axis=1), curve.sum(axis=0)
    return pull, bend


def lambdamart(features: DataFrame, gold: DataFrame, columns: list[str], rounds: int = 20, depth: int = 3, rate: float = 0.3, cut: int = 10, seed: int = 42):
    """A function from features (query_id, doc_id, *columns) to a run (query_id, doc_id, score); ``gold`` has the relevant pairs."""
    whole = VectorAssembler(inputCols=columns, outputCol="vector")
    marked = features.select(*_KEYS, *columns).join(gold.select(*_KEYS).distinct().withColumn("relevant", F.lit(1)), _KEYS, "left").na.fill(0.0, columns).na.fill(0, ["relevant"])
    scored = written(whole.transform(marked).select(*_KEYS, "relevant", "vector", F.lit(0.0).alias("score")))
    types = dict(features.dtypes)

    def of_query(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        pull, bend = gradients(pdf["relevant"].to_numpy(), pdf["score"].to_numpy(), cut)
        return pd.DataFrame({"query_id": pdf["query_id"], "doc_id": pdf["doc_id"], "pull": pull, "bend": bend})

    trees: list[tuple] = []
    tree = DecisionTreeRegressor(featuresCol="vector", labelCol="pull", leafCol="leaf", predictionCol="mean_pull", maxDepth=depth, seed=seed)
    for _ in range(rounds):
        found = scored.groupBy("query_id").applyInPandas(of_query, f"query_id {types['query_id']}, doc_id {types['doc_id']}, pull double, bend double")
        pulled = written(scored.join(found, _KEYS))
        if not pulled.head(1):
            break
        model = tree.fit(pulled)
        leaves = model.transform(pulled)
        steps = {r.leaf: rate * r.pull / (r.bend + 1e-6) for r in leaves.groupBy("leaf").agg(F.sum("pull").alias("pull"), F.sum("bend").alias("bend")).collect()}  # at most 2^depth
        trees.append((model, steps))
        moved = written(leaves.select(*_KEYS, "relevant", "vector", (F.col("score") + _step(steps)).alias("score")))
        forget(scored, pulled)
        scored = moved
    forget(scored)

    def ranked(pairs: DataFrame) -> DataFrame:
        out = whole.transform(pairs.select(*_KEYS, *columns).na.fill(0.0, columns)).withColumn("score", F.lit(0.0))
        for model, steps in trees:
            out = model.transform(out).withColumn("score", F.col("score") + _step(steps)).drop("leaf", "mean_pull")
        return out.select(*_KEYS, F.round("score", 6).alias("score"))

    return ranked


def _step(steps: dict[float, float]):
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(float(x)) for kv in steps.items() for x in kv)), F.col("leaf")), F.lit(0.0))
