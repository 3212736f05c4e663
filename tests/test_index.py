"""The stored index: shared by the queries of a session, built again for a table that has changed; norms written once."""

from docloom.operators import score
from docloom.plans import catalog


def _docs(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")


def _scores(spark, folder, scheme="log"):
    index = catalog._index(spark, str(folder))
    asked = spark.createDataFrame([(1, "red stone")], "query_id long, text string")
    return index, {r.doc_id: r.score for r in score.tfidf(index, asked, scheme).collect()}


def test_stored_once(spark, tmp_path):
    _docs(spark, tmp_path, ["red stone", "blue stone wall", None, ""])
    index, first = _scores(spark, tmp_path)
    again, second = _scores(spark, tmp_path)
    assert again is index and first == second and first[0] == 1.0 and set(first) == {0, 1}
    assert list(index.kept) == [("norms", "log", "smooth")]
    _scores(spark, tmp_path, "raw")
    assert len(index.kept) == 2
    read = score.tfidf(index, spark.createDataFrame([(1, "red")], "query_id long, text string"), "log").inputFiles()
    folder = index.kept["norms", "log", "smooth"]._docloom_path.rsplit("/", 1)[1]
    assert any(folder in f for f in read) and not any("documents.parquet" in f for f in read)


def test_changed_table(spark, tmp_path):
    _docs(spark, tmp_path, ["red stone", "blue stone wall"])
    index, _ = _scores(spark, tmp_path)
    _docs(spark, tmp_path, ["green tree", "red wall", "red stone red"])
    other, found = _scores(spark, tmp_path)
    assert other is not index and set(found) == {1, 2}
    assert catalog._index(spark, str(tmp_path), ngram=2) is not other


def test_empty_table(spark, tmp_path):
    _docs(spark, tmp_path, [])
    assert _scores(spark, tmp_path)[1] == {}
