"""Evaluation conventions where the run and the gold name different queries."""

import pytest

from docloom.operators import evaluate, rank


@pytest.fixture(scope="module")
def both(spark):
    run = [(1, 1, 1), (1, 11, 2), (1, 12, 3), (2, 21, 1), (2, 22, 2)]  # query 2 has no gold, query 1 lists itself
    gold = [(1, 11), (1, 19), (3, 31)]  # query 3 has no run
    return spark.createDataFrame(run, "query_id long, doc_id long, rank int"), spark.createDataFrame(gold, "query_id long, doc_id long")


def at(df, k):
    return next(tuple(round(x, 4) for x in r[1:]) for r in df.collect() if r.k == k)


def test_unmatched_queries(both):
    assert at(evaluate.micro_of_results(*both), 1) == (0.5, 0.5, 0.5)  # hits 1 of 2 predicted, 2 relevant in the run's queries
    assert at(evaluate.micro_official(*both), 1) == (1.0, 0.3333, 0.5)  # only gold queries, query 3 adds a miss
    assert at(evaluate.micro_fixed_k(*both), 2) == (0.25, 0.5, 0.3333)
    assert at(evaluate.micro_fixed_k(*both, skip=(2,)), 2) == (0.5, 0.5, 0.5)
    assert at(evaluate.micro_with_self(*both), 2) == (0.5, 0.3333, 0.4)
    assert evaluate.best_k(*both).first().k == 1


def test_summary(both):
    r = {x.k: x for x in evaluate.summary(*both, ks=(1, 2)).collect()}
    assert r[1].n_queries == 1 and (r[1].p, r[1].r, r[1].map, r[1].mrr, r[1].r_precision) == (1.0, 0.5, 0.5, 1.0, 0.5)
    assert r[1].micro_f1 == 0.5 and r[2].p == 0.5 and r[2].map_at_k == 0.5
    m = evaluate.macro_official(*both, 2).first()
    assert m.n_queries == 2 and (m.prec, m.rec, m.rr) == (0.25, 0.25, 0.5)


def test_label_macro_and_train_choice(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "case_id long, label string")
    guess = spark.createDataFrame([(1, "a"), (2, "b")], "case_id long, label string")
    m = evaluate.macro_label_f1(evaluate.label_f1(gold, guess)).first()
    assert m.n_labels == 2 and m.macro_precision == 0.5 and m.macro_recall == 0.25
    train = spark.createDataFrame([("x", 1, 0.2), ("x", 2, 0.5), ("x", 3, 0.5)], "exp string, k int, f1 double")
    assert [tuple(r) for r in evaluate.chosen_on_train(train, train.withColumn("f1", train.f1 / 2)).select("exp", "k", "test_f1").collect()] == [("x", 2, 0.25)]


def test_rankings(spark):
    run = spark.createDataFrame([(1, 5, 2.0), (1, 7, 1.0)], "query_id long, doc_id long, score double")
    docs, asked = spark.createDataFrame([(i,) for i in range(1, 10)], "doc_id long"), spark.createDataFrame([(1,), (2,)], "query_id long")
    found = sorted((r.query_id, r["rank"], r.doc_id) for r in rank.complete_top(run, asked, docs, 4).collect())
    assert found == [(1, 1, 5), (1, 2, 7), (1, 3, 1), (1, 4, 2), (2, 1, 1), (2, 2, 2), (2, 3, 3), (2, 4, 4)]
    flat = run.withColumn("score", run.score * 0)
    assert {r.score for r in rank.minmax_or_zero(flat).collect()} == {r.score for r in rank.znorm_smoothed(flat).collect()} == {0.0}
