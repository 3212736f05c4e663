"""Best paths against all paths and against a plain decoder; long sequences in blocks."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import sequence

STATES, OBS = ["a", "b", "c"], [1, 2, 3, 4]


def model(spark, rng):
    p = lambda: math.log(rng.random() + 1e-3)
    e = {(s, o): p() for s in STATES for o in OBS if (s, o) != ("a", 4)}
    t = {(s, n): p() for s in STATES for n in STATES if (s, n) != ("c", "a")}
    s = {x: p() for x in STATES}
    frames = [spark.createDataFrame([(*k, v) if isinstance(k, tuple) else (k, v) for k, v in d.items()], c) for d, c in ((e, "state string, obs int, logp double"), (t, "state string, next string, logp double"), (s, "state string, logp double"))]
    return (e, t, s), frames


def score(path, obs, e, t, s):
    total = s[path[0]]
    for i, (x, o) in enumerate(zip(path, obs)):
        total += e.get((x, o), -30.0) + (t.get((path[i - 1], x), -math.inf) if i else 0)
    return total


def plain(obs, e, t, s):
    best = {x: s[x] + e.get((x, obs[0]), -30.0) for x in STATES}
    for o in obs[1:]:
        best = {x: max(best[y] + t.get((y, x), -math.inf) for y in STATES) + e.get((x, o), -30.0) for x in STATES}
    return max(best.values())


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_viterbi(spark, block):
    rng = random.Random(5)
    (e, t, s), frames = model(spark, rng)
    data = {k: [rng.choice([*OBS, 9]) for _ in range(rng.randint(1, 8))] for k in range(25)} | {None: [1, 2, 3], 100: [rng.choice(OBS) for _ in range(500)]}
    rows = [(k, i, o) for k, os in data.items() for i, o in enumerate(os)] + [(1, None, 2), (7, None, None)]
    rng.shuffle(rows)
    out = sequence.viterbi(spark.createDataFrame(rows, "seq long, pos long, obs int"), *frames, block=block).collect()
    assert sorted((r.seq is None, r.seq or 0, r.pos is None, r.pos or 0, r.obs or 0) for r in out) == sorted((k is None, k or 0, p is None, p or 0, o or 0) for k, p, o in rows)
    assert all(r.state is None for r in out if r.pos is None)
    for k, os in data.items():
        path = [r.state for r in sorted((r for r in out if r.seq == k and r.pos is not None), key=lambda r: r.pos)]
        assert score(path, os, e, t, s) == pytest.approx(plain(os, e, t, s))
        if len(os) <= 6:
            assert score(path, os, e, t, s) == pytest.approx(max(score(p, os, e, t, s) for p in itertools.product(STATES, repeat=len(os))))


def test_no_path_and_empty(spark):
    frames = [spark.createDataFrame([("a", 1, -1.0)], "state string, obs int, logp double"), spark.createDataFrame([], "state string, next string, logp double"), spark.createDataFrame([("a", 0.0)], "state string, logp double")]
    steps = spark.createDataFrame([(1, i, 1) for i in range(4)] + [(2, 0, 1)], "seq long, pos long, obs int")
    for block in (2, 10):
        assert {(r.seq, r.state) for r in sequence.viterbi(steps, *frames, block=block).collect()} == {(1, None), (2, "a")}
    assert sequence.viterbi(steps.limit(0), *frames).collect() == []
    with pytest.raises(ValueError):
        sequence.Model(frames[1], spark.range(300).select(F.col("id").alias("state"), F.lit(0.0).alias("logp")))


def test_bridges_compose():
    rng = np.random.default_rng(2)
    seen, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    halves = sequence._bridge(seen[:4], moves), sequence._bridge(seen[4:], moves)
    whole = (halves[0][:, :, None, None] + moves[None, :, :, None] + halves[1][None, None]).max(axis=(1, 2))
    assert np.allclose(whole, sequence._bridge(seen, moves))


def test_estimated(spark):
    steps = spark.createDataFrame([(1, 0, "x", "q"), (1, 1, "y", "r"), (1, 2, "x", "q"), (2, 5, "x", "r"), (3, None, "x", "q"), (3, 0, "x", None)], "seq long, pos long, obs string, role string")
    e, t, s = ([tuple(r)[:-1] + (round(math.exp(r.logp), 6),) for r in d.collect()] for d in sequence.estimated(steps, "role"))
    assert sorted(e) == [("q", "x", 0.75), ("q", "y", 0.25), ("r", "x", 0.5), ("r", "y", 0.5)]
    assert sorted(t) == [("q", "q", round(1 / 3, 6)), ("q", "r", round(2 / 3, 6)), ("r", "q", round(2 / 3, 6)), ("r", "r", round(1 / 3, 6))]
    assert sorted(s) == [("q", 0.5), ("r", 0.5)]
