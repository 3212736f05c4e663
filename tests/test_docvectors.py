"""Document vectors: falling loss, planted topics, unseen texts, partitions, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.text import clean_tokens
from docloom.operators import docvectors, rank, score

WORDS = clean_tokens
TOPICS = [[f"{a}{chr(97 + i)}{chr(98 + i)}" for i in range(12)] for a in ("sea", "law", "ore")]


def _texts(seed, n):
    rng = np.random.default_rng(seed)
    return [(i, " ".join([*rng.choice(TOPICS[i % 3], 12), *rng.choice(["and", "the", "for"], 6)])) for i in range(n)]


@pytest.fixture(scope="module")
def world(spark):
    docs = spark.createDataFrame(_texts(1, 90), "doc_id long, text string")
    terms = docs.select(F.explode(WORDS(F.col("text"))).alias("term")).distinct()
    return docs, terms, docvectors.fit(docs, WORDS(F.col("text")), terms, size=16, passes=12, noise=30, ratio=2.0)


def test_loss_falls(world):
    losses = world[2].losses
    assert len(losses) == 12 and losses[-1] < 0.97 * losses[0]


def test_unseen_texts_meet_their_topic(spark, world):
    docs, _, model = world
    asked = spark.createDataFrame(_texts(2, 9), "query_id long, text string")
    run = score.dense_top(docvectors.infer(model, asked, WORDS(F.col("text")), "query_id"), docvectors.infer(model, docs, WORDS(F.col("text"))))
    best = rank.top(run, 10).collect()
    assert len(best) == 90
    assert np.mean([r.query_id % 3 == r.doc_id % 3 for r in best]) > 0.9


def test_equal_texts_have_equal_vectors(spark, world):
    docs, _, model = world
    text = docs.filter("doc_id = 4").first().text
    known, new = (docvectors.infer(model, df, WORDS(F.col("text"))).filter("doc_id = 4").first().v for df in (docs, spark.createDataFrame([(4, text)], "doc_id long, text string")))
    assert np.allclose(known, new)


def test_partitions_do_not_matter(world):
    docs, terms, _ = world
    one, many = (docvectors.fit(docs.repartition(n), WORDS(F.col("text")), terms, size=8, passes=3, noise=20) for n in (1, 7))
    assert one.terms == many.terms and np.allclose(one.weights, many.weights) and np.allclose(one.losses, many.losses)


def test_solve_is_a_minimum():
    rng = np.random.default_rng(3)
    x, y, f = rng.normal(size=(40, 5)), (rng.random(40) < 0.4).astype(float), rng.random(40) * 3
    v, best = docvectors.solve(x, y, f, 0.5, 50)
    of = lambda v: (f * np.logaddexp(0, (1 - 2 * y) * (x @ v))).sum() + 0.25 * (v @ v)
    assert np.isclose(of(v), best)
    assert all(of(v + d) >= best - 1e-9 for d in rng.normal(0, 1e-3, (200, 5)))


def test_odd_input(spark, world):
    model = world[2]
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "unknown 12 ??", "x"), (None, "seaab seabc", "x"), (5, "seaab " * 50_000, "x"), (6, "seaab", "x"), (6, "seaab", "y")], "doc_id long, text string, v string")
    out = {r.doc_id: r.v for r in docvectors.infer(model, odd, WORDS(F.col("text"))).collect()}
    assert sorted(out) == [5, 6] and np.isfinite(out[5]).all()
    none = docvectors.fit(odd.limit(0), WORDS(F.col("text")), world[1])
    assert none.terms == [] and docvectors.infer(none, odd, WORDS(F.col("text"))).count() == 0
