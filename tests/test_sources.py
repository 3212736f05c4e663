"""Readers, sinks, text functions and the streamed index on small literal files."""

import json

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.index import postings
from docloom.sources import readers, writers
from docloom.streaming.index import append_postings


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "0000000012.txt").write_text("a\nb")
    assert pairs(readers.read_corpus(spark, f"{tmp_path}/c", int_ids=True)) == [(12, "a\nb")]
    (tmp_path / "l.json").write_text(json.dumps({"Query Set": [{"id": "q1", "relevant candidates": ["d1", "d2", "d1"]}, {"query_name": "q2", "relevant candidates": []}], "Candidate Set": [{"id": "d1"}]}))
    labels = readers.read_labels(spark, f"{tmp_path}/l.json")
    assert pairs(labels) == [("q1", "d1"), ("q1", "d2")]
    assert pairs(readers.within_pool(labels, spark.createDataFrame([("d2",)], "doc_id string"))) == [("q1", "d2")]
    (tmp_path / "l.csv").write_text("Query Case,Cited Cases\nq1,\"['d1', 'd2']\"\nq2,\n")
    assert pairs(readers.read_labels_csv(spark, f"{tmp_path}/l.csv")) == [("q1", "d1"), ("q1", "d2")]
    (tmp_path / "q.txt").write_text("q1 0 d1 2\nq1 0 d2 0\n")
    assert pairs(readers.read_trec_qrels(spark, f"{tmp_path}/q.txt")) == [("q1", "d1")]
    (tmp_path / "r.json").write_text(json.dumps({"a": ["x", "y", "x"], "b": {"x": 0.1, "y": "0.9", "z": "no"}, "c": [{"id": "x", "score": 1}, {"name": "y", "prob": 2}]}))
    assert pairs(readers.read_run(spark, f"{tmp_path}/r.json")) == [("a", "x", 1), ("a", "y", 2), ("b", "x", 2), ("b", "y", 1), ("b", "z", 3), ("c", "x", 2), ("c", "y", 1)]


def test_writers(spark, tmp_path):
    for f1 in (0.1, 0.2):
        writers.save_results(spark.createDataFrame([("m", f1)], "model string, f1 double"), f"{tmp_path}/r")
    writers.save_results(spark.createDataFrame([("n", 0.3)], "model string, f1 double"), f"{tmp_path}/r")
    assert sorted((r.model, r.f1) for r in writers.read_results(spark, f"{tmp_path}/r").collect()) == [("m", 0.2), ("n", 0.3)]
    run = spark.createDataFrame([(1, 5, 0.5)], "query_id int, doc_id int, score double")
    assert pairs(writers.similarity_matrix(run, [5, 6])) == [(1, 0.5, 0.0)]


def test_text(spark):
    t = "w1 w2 <CITATION_7> w3. Next one! <CITATION_7> <CITATION_2>"
    df = spark.createDataFrame([(t, "Fact\ta b\nnone\nRatio\tc"), (None, None)], "t string, r string")
    a, b = df.select(T.citations(F.col("t")).alias("c"), T.citation_context(F.col("t"), 1).alias("x"), T.sentences(F.col("t")).alias("s"), T.role_text(F.col("r"), {"Fact": 1, "Ratio": 2}).alias("f"), T.windows(T.simple_tokens(F.col("t")), 4, 2).alias("w")).collect()
    assert a.c == ["7", "2"] and a.x == ["w2 w3.", "one!", ""] and len(a.s) == 3 and a.f == "a b c c" and [len(x) for x in a.w] == [4, 4, 4]
    assert b.c == [] and b.x == [] and b.s == [] and b.f == ""


def test_streamed_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    append_postings(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    cols = ["doc_id", "term", "tf", "dl", "maxtf"]
    assert pairs(spark.read.parquet(f"{tmp_path}/out").select(cols)) == pairs(postings(docs, "doc_id").select(cols))
