"""Layouts of data sets and result files, on small files."""

import json

from docloom.sources import adapters, writers


def pairs(df):
    return sorted((r.query_id, r.doc_id) for r in df.collect())


def test_split(spark, tmp_path):
    for side, files in (("query", {"q1": b"one", "q2": b"caf\xe9"}), ("candidate", {"c1": "zwölf".encode(), "q1": b"as candidate"})):
        (tmp_path / "train" / side).mkdir(parents=True)
        for n, body in files.items():
            (tmp_path / "train" / side / f"{n}.txt").write_bytes(body)
    (tmp_path / "train" / "gold.json").write_text(json.dumps({"q1.txt": ["c1.txt", "c1"], "q3": ["c1"], "q4": []}))
    d = adapters.load_split(spark, str(tmp_path), "train")
    assert pairs(d.gold) == [("q1", "c1"), ("q3", "c1")]
    assert sorted(map(tuple, d.queries.collect())) == [("q1", "one"), ("q2", "café"), ("q3", "")]
    assert sorted(map(tuple, adapters.every_text(d).collect())) == [("c1", "zwölf"), ("q1", "as candidate"), ("q2", "café"), ("q3", "")]
    assert sorted(r.doc_id for r in adapters.case_ids(d.gold, d.candidates).collect()) == ["c1", "q1", "q3"]


def test_gold(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"1": {"a": 3, "b": 1}, "2": {"a": 2}}))
    assert pairs(adapters.graded(spark, str(tmp_path / "g.json"))) == [("1", "a"), ("2", "a")]
    (tmp_path / "g.csv").write_text("Query Case,Cited Cases\nq1.txt,\"['a.txt', 'b.txt']\"\nq2.txt,\"[\"\"'c.txt'\"\"]\"\nq3.txt,[]\n")
    assert pairs(adapters.csv_mapping(spark, str(tmp_path / "g.csv"))) == [("q1", "a"), ("q1", "b"), ("q2", "c")]
    df = spark.createDataFrame([("1", '["a", "b"]'), ("2", "['c']"), ("3", "d, e"), ("4", None), ("5", "[]")], "q string, g string")
    assert pairs(adapters.gold_lists(df, "q", "g")) == [("1", "a"), ("1", "b"), ("2", "c"), ("3", "d"), ("3", "e")]


def test_sinks(spark, tmp_path):
    run = spark.createDataFrame([("1", "a", 0.5), ("2", "b", 0.25)], "query_id string, doc_id string, score double")
    adapters.write_matrix(run, str(tmp_path / "m"), ["a", "b"])
    assert next((tmp_path / "m").glob("*.csv")).read_text().split() == ["query_id,a,b", "1,0.5,0.0", "2,0.0,0.25"]
    for _ in range(2):
        adapters.append_missing(run, str(tmp_path / "r"), ["query_id", "doc_id"])
    adapters.append_missing(run.withColumn("query_id", run.doc_id), str(tmp_path / "r"), ["query_id", "doc_id"])
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    assert pairs(adapters.restrict(run, run.filter("query_id = '1'"))) == [("1", "a")] and adapters.restrict(run, None) is run
    adapters.write_corpus(spark.createDataFrame([("d", "t", 1)], "doc_id string, text string, x int"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).collect()[0].asDict() == {"doc_id": "d", "text": "t"}


def test_results_survive_a_stop(spark, tmp_path):
    at = str(tmp_path / "results")
    row = lambda m, x: spark.createDataFrame([(m, x)], "model string, f1 double")
    writers.save_results(row("a", 0.1), at)
    writers.save_results(row("b", 0.2), at)
    writers.save_results(row("a", 0.3), at)
    assert sorted((r.model, r.f1) for r in writers.read_results(spark, at).collect()) == [("a", 0.3), ("b", 0.2)]
    (tmp_path / "results").rename(tmp_path / "results.old")  # a stop between the two renames
    writers.save_results(row("c", 0.4), at)
    assert sorted((r.model, r.f1) for r in writers.read_results(spark, at).collect()) == [("a", 0.3), ("b", 0.2), ("c", 0.4)]


def test_label_graph_and_resume(spark, tmp_path):
    labels = spark.createDataFrame([("c1", "x"), ("c1", "y"), ("c2", "x"), ("c2", "y"), ("c3", "x")], "case_id string, label string")
    from docloom.operators.sets import label_edges

    writers.write_label_graph(labels, label_edges(labels), str(tmp_path))
    read = lambda n: [tuple(r) for r in spark.read.csv(str(tmp_path / n), header=True).collect()]
    assert sorted(read("case_nodes")) == [("c1", "2", "x|y"), ("c2", "2", "x|y"), ("c3", "1", "x")]
    assert read("case_case_edges")[0] == ("c1", "c2", "2", "x|y") and len(read("case_label_edges")) == 5
    plan, done = spark.createDataFrame([("a",), ("b",), ("c",)], "label string"), spark.createDataFrame([("a", True), ("b", False)], "label string, ok boolean")
    assert sorted(r.label for r in writers.missing_labels(plan, done).collect()) == ["b", "c"]
