"""Sinks: results kept by key, similarity matrices, label-graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """``new`` and the rows of ``old`` whose key it lacks; columns of either side stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def save_results(new: DataFrame, path: str, key: str = "model") -> None:
    """Upsert a small JSON table of results.

    The merged rows go to a sibling folder; the old table steps aside before that one takes its name and goes last, so a
    stop at any point leaves one whole table, which the next call finds.
    """
    spark = new.sparkSession
    at = lambda ending: spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ending)
    here, fresh, old = at(""), at(".new"), at(".old")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(here) and fs.exists(old):
        fs.rename(old, here)
    merged = upserted(spark.read.json(path), new, key) if fs.exists(here) else new
    merged.write.mode("overwrite").json(fresh.toString())
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(fresh, here)
    fs.delete(old, True)


def missing_labels(plan: DataFrame, done: DataFrame, key: str = "label") -> DataFrame:
    """Rows of a sweep's plan that have no successful result yet (resume)."""
    return plan.join(done.filter("ok").select(key), key, "left_anti")


def similarity_matrix(run: DataFrame, docs: list[int | str]) -> DataFrame:
    """One row per query and one column per stated document; absent pairs are 0."""
    return run.groupBy("query_id").pivot("doc_id", docs).agg(F.first("score")).fillna(0.0)


def write_label_graph(labels: DataFrame, edges: DataFrame, folder: str) -> None:
    """The four CSV tables of a label graph, lists joined by ``|``; case edges by shared count, then ids."""
    c = labels.distinct()
    nodes = c.groupBy("case_id").agg(F.count("label").alias("label_count"), F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))  # bounded by one case's labels
    tables = {"case_nodes": nodes, "label_nodes": c.select(F.col("label").alias("label_name")).distinct(), "case_label_edges": c.select("case_id", F.col("label").alias("label_name")), "case_case_edges": edges.orderBy(F.desc("shared_count"), "source_case_id", "target_case_id")}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
