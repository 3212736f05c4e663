"""Labels of conversations against a plain decoder."""

import math

import pytest

from docloom.plans import grammar

SF = "/root/testdata/sf0.001"


def test_sequence_roles(spark):
    e, t, s = {}, {}, {}
    for r in grammar.sequence_model(spark, SF).collect():
        {"emission": e, "transition": t, "start": s}[r.kind][(r.state, r.seen) if r.kind != "start" else r.state] = r.logp
    talks = {}
    for r in grammar.sequence_roles(spark, SF).collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.obs, r.state))
    assert talks
    for turns in talks.values():
        turns.sort()
        best = {x: s[x] + e[x, turns[0][1]] for x in s}
        for _, o, _ in turns[1:]:
            best = {x: max(best[y] + t.get((y, x), -math.inf) for y in s) + e[x, o] for x in s}
        path = [x for _, _, x in turns]
        own = s[path[0]] + sum(e[x, o] for x, (_, o, _) in zip(path, turns)) + sum(t[a, b] for a, b in zip(path, path[1:]))
        assert own == pytest.approx(max(best.values()), abs=1e-4)
