"""Readers of corpora, judgements and runs into canonical frames: docs(doc_id, text), qrels(query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = "`Query Set` array<struct<id:string, query_name:string, `relevant candidates`:array<string>>>, `Candidate Set` array<struct<id:string>>"


def read_corpus(spark: SparkSession, folder: str, int_ids: bool = False) -> DataFrame:
    """(doc_id, text) of a folder of text files, one document a file; the id is the file name (or its number)."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    key = F.regexp_extract("name", "([0-9]+)", 1).cast("long") if int_ids else F.col("name")
    return files.select(key.alias("doc_id"), "text")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """qrels of a label file in JSON; queries without relevant candidates give no row."""
    return spark.read.schema(LABELS).json(path, multiLine=True).select(F.explode("Query Set").alias("q")).select(F.coalesce("q.id", "q.query_name").alias("query_id"), F.explode("q.`relevant candidates`").alias("doc_id")).distinct()


def read_labels_csv(spark: SparkSession, path: str, query: str = "Query Case", cited: str = "Cited Cases") -> DataFrame:
    """qrels of a CSV whose second column lists ids, plainly or as a bracketed list with quotes."""
    rows = spark.read.csv(path, header=True, escape='"').select(F.trim(query).alias("query_id"), F.explode(F.regexp_extract_all(F.coalesce(cited, F.lit("")), F.lit(r"([^\[\]'\", ]+)"), F.lit(1))).alias("doc_id"))
    return rows.distinct()


def read_trec_qrels(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """qrels of lines ``query 0 document relevance`` whose relevance is at least ``least``."""
    w = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).filter("size(w) = 4")
    return w.select(F.col("w")[0].alias("query_id"), F.col("w")[2].alias("doc_id"), F.col("w")[3].cast("int").alias("rel")).filter(F.col("rel") >= least).select("query_id", "doc_id").distinct()


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rank) of predictions in JSON: per query a list of ids, a map to scores or a list of records.

    A score that isn't a number is 0; of repeated ids the first stays; plain lists keep their order.
    """
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("query_id", "v"))
    number = lambda c: F.coalesce(F.expr("try_cast({} as double)".format(c)), F.lit(0.0))
    listed = whole.filter("v LIKE '[%'").select("query_id", F.posexplode(F.from_json("v", "array<string>")).alias("pos", "x"))
    record = F.from_json("x", "id string, case_id string, label string, name string, score string, prob string, confidence string")
    listed = listed.withColumn("r", F.when(F.col("x").startswith("{"), record)).select("query_id", "pos", F.coalesce("r.id", "r.case_id", "r.label", "r.name", "x").alias("doc_id"), F.when(F.col("r").isNotNull(), number("coalesce(r.score, r.prob, r.confidence)")).otherwise(0.0).alias("score"))
    scored = whole.filter("v LIKE '{%'").select("query_id", F.explode(F.from_json("v", "map<string,string>")).alias("doc_id", "s")).select("query_id", F.lit(0).alias("pos"), "doc_id", number("s").alias("score"))
    first = listed.unionByName(scored).groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("loss"), "pos")).alias("o"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "doc_id")).alias("rank"))


def within_pool(qrels: DataFrame, pool: DataFrame) -> DataFrame:
    """Judgements whose document is in ``pool(doc_id)``; queries left without any disappear."""
    return qrels.join(pool.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id")
