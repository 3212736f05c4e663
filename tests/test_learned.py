"""Learned models on small fixtures, against numpy or what a reader expects."""

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import records
from docloom.functions.text import simple_tokens
from docloom.operators import learned, reports


def test_latent_space_is_numpys(spark):
    rng = np.random.default_rng(3)
    dense = rng.random((60, 12)) * (rng.random((60, 12)) < 0.5)
    dense[:, 0] += 0.1
    weights = spark.createDataFrame([(i, f"t{j}", float(w)) for i, r in enumerate(dense) for j, w in enumerate(r) if w], "doc_id long, term string, w double")
    terms = spark.createDataFrame([(f"t{j}", j) for j in range(12)], "term string, id int")
    rows = learned.sparse_rows(weights.repartition(3), terms)
    basis = learned.latent_basis(rows, 12, 4, passes=30)
    unit = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    want = np.linalg.svd(unit)[2][:4].T
    assert np.allclose(np.abs(np.sum(basis * want, axis=0)), 1, atol=1e-5)
    got = {r.doc_id: r.v for r in learned.latent_vectors(rows, basis).collect()}
    assert len(got) == 60 and np.allclose(got[7], unit[7] @ basis)
    none = learned.latent_vectors(learned.sparse_rows(weights.limit(0), terms), basis)
    assert none.count() == 0


def test_forest_tells_relevant_pairs(spark):
    pairs = spark.createDataFrame([(q, d, float(d % 2), None if d == 5 else float(d)) for q in range(6) for d in range(10)], "query_id long, doc_id long, a double, b double")
    ranked = learned.forest_ranker(pairs, pairs.filter("a = 1"), ["a", "b"], trees=10)(pairs)
    low, high = ranked.agg(F.max(F.when(F.col("doc_id") % 2 == 0, F.col("score"))), F.min(F.when(F.col("doc_id") % 2 == 1, F.col("score")))).first()
    assert ranked.count() == 60 and low < 0.5 < high


def test_word_vectors_keep_to_the_vocabulary(spark):
    docs = spark.createDataFrame([(i, "red green blue") for i in range(20)] + [(99, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("red",), ("blue",)], "term string")
    got = learned.word_vectors(docs, simple_tokens(F.col("text")), terms, size=4)
    assert sorted(r.term for r in got.collect()) == ["blue", "red"] and got.first().v.__len__() == 4


def test_cooccurrence_and_means(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r.a, r.b): r.weight for r in reports.cooccurrence(docs, simple_tokens(F.col("text")), 2).collect()}
    assert got == {("a", "b"): 2.0, ("a", "a"): 0.5}
    counts = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (1, "unknown", 9), (2, "unknown", 1)], "doc_id long, term string, tf long")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "term string, v array<double>")
    weights = spark.createDataFrame([("x", 2.0)], "term string, weight double")
    assert [(r.doc_id, r.v) for r in reports.mean_vectors(counts, weights, vectors, "doc_id", 2).collect()] == [(1, [0.8, 0.2])]


def test_numbers_in_words_and_definitions(spark):
    df = spark.createDataFrame([('Pay twenty-five thousand three hundred and six or Two Million; someone. "Rent" means money.',), (None,), ("",)], "t string")
    rows = df.select(records.records("number_words", F.col("t")).alias("n"), records.records("definition", F.col("t")).alias("d")).collect()
    assert [(r.text, r.value) for r in rows[0].n] == [("twenty-five thousand three hundred and six", 25306.0), ("Two Million", 2e6)]
    assert [(r.term, r.verb) for r in rows[0].d] == [("Rent", "means")] and rows[1].n == rows[2].n == rows[1].d == []


def test_word_vectors_of_planted_synonyms(spark):
    """Words that stand in the same places come close, whatever they stand beside; the loss falls."""
    import random

    rng, rows = random.Random(4), []
    for i in range(600):
        topic = i % 3
        rows.append((i, " ".join(rng.choice([f"t{topic}w{j}" for j in range(6)] + [f"syn{topic}a", f"syn{topic}b"]) for _ in range(12))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pairs = reports.cooccurrence(docs, F.split("text", " "), 3)
    terms = pairs.select(F.col("a").alias("term")).union(pairs.select("b"))
    got, losses = learned.factorise(pairs, terms, size=6, rounds=4)
    v = {r.term: np.array(r.v) / np.linalg.norm(r.v) for r in got.collect()}
    assert all(x > y for x, y in zip(losses, losses[1:])) and len(v) == 24
    for t in range(3):
        near = v[f"syn{t}a"] @ v[f"syn{t}b"]
        assert near > 0.8 and all(v[f"syn{t}a"] @ v[f"syn{o}{x}"] < near for o in range(3) if o != t for x in "ab")
    assert learned.factorise(pairs, terms.limit(0))[0].collect() == []


def test_lambdamart_beats_single_features(spark):
    from docloom.operators import boosting, evaluate  # noqa: F401

    rng = np.random.default_rng(6)
    rows, gold = [], []
    for q in range(30):
        for d in range(40):
            a, b, c = rng.random(3)
            rows.append((q, d, float(a), float(b), None if d == 0 else float(c)))
            if (a > 0.6) != (b > 0.6) and c > 0.4:  # no single feature tells
                gold.append((q, d))
    pairs, rel = spark.createDataFrame(rows, "query_id long, doc_id long, a double, b double, c double"), spark.createDataFrame(gold, "query_id long, doc_id long")
    ranked = boosting.lambdamart(pairs.filter("query_id < 20"), rel, ["a", "b", "c"], rounds=8)
    test, good = pairs.filter("query_id >= 20"), set(gold)

    def ndcg(run):
        own, total = {}, []
        for r in run:
            own.setdefault(r.query_id, []).append((-r.score, r.doc_id))
        for q, ds in own.items():
            ds.sort()
            ideal = sum(1 / np.log2(i + 2) for i in range(min(10, sum((q, d) in good for _, d in ds))))
            total.append(sum(((q, d) in good) / np.log2(i + 2) for i, (_, d) in enumerate(ds[:10])) / ideal)
        return np.mean(total)

    single = max(ndcg(test.select("query_id", "doc_id", (s * F.coalesce(F.col(x), F.lit(0.0))).alias("score")).collect()) for x in "abc" for s in (F.lit(1), F.lit(-1)))
    assert ndcg(ranked(test).collect()) > single + 0.1
    assert boosting.lambdamart(pairs.limit(0), rel, ["a", "b", "c"], rounds=2)(test.limit(3)).count() == 3


def test_gradients_and_pool(spark):
    from docloom.operators import boosting

    pull, bend = boosting.gradients(np.array([0, 1, 0]), np.array([2.0, 1.0, 0.0]), 10)
    assert pull[1] > 0 > pull[0] and abs(pull.sum()) < 1e-12 and (bend > 0).all() and not boosting.gradients(np.array([0, 0]), np.zeros(2), 10)[0].any()
    run = spark.createDataFrame([(q, d, float(-d)) for q in (1, 2) for d in range(50)], "query_id long, doc_id long, score double")
    gold = spark.createDataFrame([(1, 40), (1, 2), (3, 1)], "query_id long, doc_id long")
    docs = spark.range(200).select(F.col("id").alias("doc_id"))
    pool = boosting.sample_pool(run, gold, docs, 5, 20).collect()
    assert sorted((r.query_id, r.doc_id, r.relevant) for r in boosting.sample_pool(run.repartition(7), gold, docs.repartition(3), 5, 20).collect()) == sorted((r.query_id, r.doc_id, r.relevant) for r in pool)
    one = [r for r in pool if r.query_id == 1]
    assert {r.doc_id for r in one if r.relevant} == {2, 40} and {0, 1, 2, 3, 4} <= {r.doc_id for r in one} and len(one) == 26 == len({r.doc_id for r in one})
    assert len([r for r in pool if r.query_id == 2]) == 25 and {r.query_id for r in pool} == {1, 2}
    assert len(boosting.sample_pool(run, gold, docs, 5, 0).collect()) == 11
