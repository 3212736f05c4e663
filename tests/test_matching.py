"""Texts filtered by shared events, language profiles and statute scores against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from docloom.functions.text import clean_tokens
from docloom.operators import overlap, profiles, sets


def _plain(texts, asks):
    """What every pair of a query and another document shares, listed pair by pair."""
    lines = {k: [set(x.split()) for x in (t or "").split("\n")] for k, t in texts.items()}
    whole = {k: set().union(*v) for k, v in lines.items()}
    queries = [k for k in texts if asks(k)]
    kept = {("query", q): set().union(*(whole[q] & whole[c] for c in texts if c != q)) for q in queries}
    kept |= {("candidate", c): set().union(*(whole[q] & whole[c] for q in queries if q != c)) for c in texts}
    return {(s, k): "\n".join(x for x, own in zip((texts[k] or "").split("\n"), lines[k]) if own & e) for (s, k), e in kept.items()}


def test_filtered_texts(spark):
    rng = np.random.default_rng(5)
    texts = {i: "\n".join(" ".join(f"w{chr(97 + x // 26)}{chr(97 + x % 26)}" for x in rng.integers(0, 120, rng.integers(0, 4))) for _ in range(rng.integers(1, 6))) for i in range(30)}
    texts |= {30: None, 31: "", 32: "only here\nnobody else", 33: "hot\n" * 3000 + "hot", 34: "hot x", 40: "hot x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sentences, asks = F.split(F.coalesce("text", F.lit("")), "\n"), F.col("doc_id") % 5 == 0
    events = overlap.events_of(docs, sentences, clean_tokens, asks)
    out = overlap.filtered_texts(docs, sentences, overlap.shared_lines(events.union(events)), asks).collect()
    want = _plain({k: t for k, t in texts.items()}, lambda k: k % 5 == 0)
    one = {k: "\n".join(x for x in t.split("\n") if x) for k, t in want.items()}
    assert {(r.side, r.doc_id): r.text for r in out} == one
    assert {(r.side, r.doc_id): r.n_lines for r in out} == {k: len(t.split("\n")) if t else 0 for k, t in one.items()}
    assert overlap.shared_events(events).filter("doc_id = 32").count() == 0


def test_a_document_gives_itself_nothing(spark):
    rows = [("query", 1, 0, "a"), ("candidate", 1, 0, "a"), ("candidate", 2, 0, None), ("query", None, 0, "a"), ("query", 3, 1, "b"), ("candidate", 1, 4, "b")]
    events = spark.createDataFrame(rows, "side string, doc_id long, line int, event string")
    assert sorted(map(tuple, overlap.shared_lines(events).collect())) == [("candidate", 1, 4), ("query", 3, 1)]
    assert overlap.shared_lines(events.limit(0)).count() == 0


def _pairs(text):
    t = [c for c in text or "" if c in "\t\n\x0b\x0c\r" or " " <= c <= "~"]
    out = {}
    for a, b in zip(t, t[1:]):
        if (a + b).isalnum():
            out[ord(a) * 128 + ord(b)] = out.get(ord(a) * 128 + ord(b), 0) + 1
    return out


def test_ratings(spark):
    prose, junk = "the cat sat on that mat and the dog ate " * 4, "x7Qz9 Kq0w Zz8 " * 10
    texts = [(1, prose, "en"), (2, prose + "été", "en"), (3, junk, "en"), (4, "das ist ein sehr gutes Haus " * 5, "de"), (5, None, "en"), (6, "", "en"), (7, "a b c " * 40, "en"), (8, prose, None), (9, prose, "xx"), (10, "the cat", "en"), (11, "é\x00", "de"), (12, "a" * 300_000, "de")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("share", F.lit("extra"))
    shape = {}
    for lang in ("en", "de", "xx"):
        own = [p for _, t, g in texts if g == lang and t and len(t) >= 100 and (p := _pairs(t))]
        keys = {k for p in own for k in p}
        shape[lang] = {k: sum(p.get(k, 0) / sum(p.values()) for p in own) / len(own) for k in keys}
    got = {(r.lang, r.pair): r.share for r in profiles.language_profiles(df).collect()}
    assert got.keys() == {(g, k) for g in shape for k in shape[g]}
    assert all(math.isclose(v, shape[g][k], abs_tol=1e-12) for (g, k), v in got.items())
    out = {r.doc_id: r for r in profiles.rated_by_own_language(df).collect()}
    assert sorted(out) == list(range(1, 13))
    for i, t, g in texts:
        p, q = _pairs(t), shape.get(g) or shape["en"]
        dot = sum(n * q.get(k, 0) for k, n in p.items())
        cos = dot / math.sqrt(sum(n * n for n in p.values()) * sum(x * x for x in q.values())) if p else 0
        assert math.isclose(out[i].cosine, cos, abs_tol=1e-8)
        assert out[i].rating == round(int(round(cos, 9) * 100) / 10)
        x = round(cos, 9) * 100
        assert out[i].rating_quadratic == (0 if x < 50 else min(10, round(0.00219033 * x * x - 0.1239173 * x + 1.1268522)))
    assert out[1].rating > out[3].rating and out[5].rating == out[6].rating == out[7].rating == 0
    assert profiles.language_profiles(df.limit(0)).count() == 0
    assert {r.rating for r in profiles.text_ratings(df, profiles.language_profiles(df.limit(0))).collect()} == {0.0}


def test_set_scores(spark):
    rng = np.random.default_rng(7)
    b = {i: {f"s{x}" for x in rng.integers(0, 25, rng.integers(0, 6))} for i in range(40)}
    a = {i: {f"s{x}" for x in rng.integers(0, 30, rng.integers(0, 6))} for i in range(10)}
    rows = lambda s: [(i, e) for i, v in s.items() for e in v] + [(0, None)]
    x, y = spark.createDataFrame(rows(a) + rows(a), "query_id long, element string"), spark.createDataFrame(rows(b), "doc_id long, element string")
    n = len({i for i, v in b.items() if v} | {0})
    w = lambda e: (math.log((n + 1) / (sum(e in v for v in b.values()) + 1)) + 1) ** 2 if any(e in v for v in b.values()) else 1.0
    want = {}
    for q, s in a.items():
        for d, t in b.items():
            if s & t:
                z = math.sqrt(sum(map(w, s)) * sum(map(w, t)))
                want[q, d] = (len(s & t), len(s & t) / len(s | t), len(s & t) / math.sqrt(len(s) * len(t)), sum(map(w, s & t)) / z)
    got = {(r.query_id, r.doc_id): tuple(r)[2:] for r in sets.set_scores(x, y).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    assert sets.set_scores(x, y.limit(0)).count() == 0
