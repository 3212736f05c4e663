"""Data sets in their own layouts, read as one: texts of queries and candidates, gold pairs, candidate pools."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Dataset:
    """``queries`` and ``candidates`` are (doc_id, text), ``gold`` is (query_id, doc_id), ``pool`` restricts a query's candidates or is None."""

    queries: DataFrame
    candidates: DataFrame
    gold: DataFrame
    pool: DataFrame | None = None


def _lenient(content: Column) -> Column:
    """UTF-8 where it is; otherwise byte by byte as Latin-1, so no file stops a run."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): a row per ``.txt`` file, its name without the ending; a file that is no UTF-8 is read as Latin-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("doc_id"), _lenient(F.col("content")).alias("text"))


def named_texts(ids: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) of every id; a text that isn't there is empty."""
    return ids.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def without_ending(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"\.(txt|json)$", "")


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id) of one JSON object ``{query: [candidates]}`` whose names may end in .txt."""
    body = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("q", "c"))
    return body.select(without_ending(F.col("q")).alias("query_id"), F.explode("c").alias("c")).select("query_id", without_ending(F.col("c")).alias("doc_id")).distinct()


def graded(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(query_id, doc_id) of one JSON object ``{query: {candidate: grade}}``: grades of at least ``least`` are relevant."""
    body = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, map<string, int>>")).alias("query_id", "c"))
    return body.select("query_id", F.explode("c").alias("doc_id", "grade")).filter(F.col("grade") >= least).select("query_id", "doc_id")


def csv_mapping(spark: SparkSession, path: str, key: str = "Query Case", listed: str = "Cited Cases") -> DataFrame:
    """(query_id, doc_id) of a CSV whose second column holds a list in Python's notation, quoted once or twice."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    ids = F.regexp_extract_all(F.col(f"`{listed}`"), F.lit("['\"]+([^'\"\\[\\],]+)['\"]+"), F.lit(1))
    return rows.select(without_ending(F.col(f"`{key}`")).alias("query_id"), F.explode(ids).alias("doc_id")).select("query_id", without_ending(F.col("doc_id")).alias("doc_id")).distinct()


def gold_lists(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(query_id, doc_id) of gold in any of these shapes: a JSON list, a list in Python's notation, ids between commas."""
    b = F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"[\[\]'\"{}]", "")
    ids = F.filter(F.transform(F.split(b, ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.col(key).cast("string").alias("query_id"), F.explode(F.array_distinct(ids)).alias("doc_id"))


def case_ids(*frames: DataFrame) -> DataFrame:
    """(doc_id): every id that any frame names as query, candidate or document, once."""
    out = None
    for f in frames:
        for c in ("query_id", "doc_id"):
            if c in f.columns:
                one = f.select(F.col(c).cast("string").alias("doc_id"))
                out = one if out is None else out.union(one)
    return out.filter("doc_id IS NOT NULL").distinct()


def load_split(spark: SparkSession, root: str, split: str) -> Dataset:
    """``root/split`` with folders ``query`` and ``candidate`` and the gold in ``gold.json`` (a mapping). Queries without a text are empty."""
    gold = mapping(spark, f"{root}/{split}/gold.json")
    found = texts(spark, f"{root}/{split}/query")
    ids = gold.select(F.col("query_id").alias("doc_id")).union(found.select("doc_id"))
    return Dataset(named_texts(ids, found), texts(spark, f"{root}/{split}/candidate"), gold)


def every_text(data: Dataset) -> DataFrame:
    """(doc_id, text) of queries and candidates together; where both have an id the candidate's text counts."""
    extra = data.queries.join(data.candidates.select("doc_id"), "doc_id", "left_anti")
    return data.candidates.unionByName(extra)


def restrict(run: DataFrame, pool: DataFrame | None) -> DataFrame:
    """The run's pairs that the pool allows."""
    return run if pool is None else run.join(pool.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header in the folder ``path``, replaced as a whole."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table at ``path`` lacks, so a run that broke off goes on where it stopped."""
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)


def write_matrix(run: DataFrame, path: str, candidates: list[str]) -> None:
    """A run as a CSV matrix: a row per query, a column per listed candidate (a bounded list), 0 where there is no score."""
    wide = run.groupBy("query_id").pivot("doc_id", candidates).agg(F.first("score")).na.fill(0.0)
    write_csv(wide.select("query_id", *(F.col(f"`{c}`") for c in candidates)).orderBy("query_id"), path)


def write_corpus(docs: DataFrame, path: str) -> None:
    """Documents as JSON lines, a row each: the form that the other tools read."""
    docs.select("doc_id", "text").write.mode("overwrite").json(path)
