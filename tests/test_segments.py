"""Trained segments: planted paragraphs, sections and titles on held-out texts, features against plain counting, odd input."""

import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import segments

rng = np.random.default_rng(11)


def _line(n, end):
    return " ".join("".join(rng.choice(list("aeioubcdlmnrst"), rng.integers(2, 9))) for _ in range(n)) + end


def _planted(i):
    """Paragraphs of long lines that end with a short one, the next indented; every third has a numbered head line; blank lines fall anywhere."""
    lines, starts, heads = [], [], []
    for k in range(int(rng.integers(3, 9))):
        starts.append(len(lines))
        if (k + i) % 3 == 0:
            heads.append(len(lines))
            lines.append(f"{k + 1}. " + _line(3, "").title())
        else:
            lines.append("    " + _line(10, "").capitalize())
        for _ in range(int(rng.integers(1, 5))):
            lines.append(_line(int(rng.integers(9, 12)), ""))
            if rng.random() < 0.1:
                lines.append("")
        lines.append(_line(3, "."))
    return "\n".join(lines), starts, heads


@pytest.fixture(scope="module")
def world(spark):
    made = [(i, *_planted(i)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    marked = spark.createDataFrame([(i, n) for i, _, s, _ in made for n in s], "doc_id long, line int")
    heads = spark.createDataFrame([(i, n) for i, _, _, h in made for n in h], "doc_id long, line int")
    return made, docs, marked, heads


def _score(got, want):
    hit = len(got & want)
    return hit / len(got), hit / len(want)


def test_paragraphs_of_held_out_texts(world):
    made, docs, marked, _ = world
    model = segments.fit_lines(docs.filter("doc_id < 80"), marked)
    out = segments.segments(model, docs.filter("doc_id >= 80")).collect()
    want = {(i, segments.line_places(t)[n][0]) for i, t, s, _ in made if i >= 80 for n in s}
    precision, recall = _score({(r.doc_id, r.start) for r in out}, want)
    assert precision > 0.95 and recall > 0.95
    texts = {i: t for i, t, _, _ in made}
    assert all(r.text == texts[r.doc_id][r.start : r.end] for r in out)
    for i in range(80, 120):  # nothing is lost
        assert "".join(r.text for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.nth)) == texts[i]


def test_titles(world):
    made, docs, _, heads = world
    model = segments.fit_lines(docs.filter("doc_id < 80"), heads)
    got = {(r.doc_id, r.text) for r in segments.segments(model, docs.filter("doc_id >= 80"), titles=True).collect()}
    precision, recall = _score(got, {(i, t.split("\n")[n]) for i, t, _, h in made if i >= 80 for n in h})
    assert precision > 0.95 and recall > 0.95


def test_runs_merge():
    model = segments.LineModel(0, 0, np.r_[0, 0, 0, 1.0, np.zeros(6 + 5 + 95)], -0.5)  # upper case alone
    text = "ONE\r\nTWO\nthree\nFOUR"
    taken = segments.found_lines(model, text, 0.5)
    assert taken.tolist() == [True, True, False, True]
    places = segments.line_places(text)
    assert [text[a:b] for a, b in segments._runs(text, places, taken)] == ["ONE\r\nTWO", "FOUR"]
    assert [text[a:b] for a, b in segments._between(text, places, taken)] == ["ONE\r\n", "TWO\nthree\n", "FOUR"]


def test_features_against_counting():
    text = "Title Here\n\n  12, été one.\tX \r\nUPPER 1!\n\rlast"
    lines = ["Title Here", "", "  12, été one.\tX ", "UPPER 1!", "last"]
    assert [text[a:b] for a, b, _ in segments.line_places(text)] == lines
    ((at, x),) = segments.features(text, 1, 2)
    looks = [[len(s), len(s.strip()), s == s.title(), s == s.upper(), sum(map(str.isalpha, s)), sum(map(str.isdigit, s)), sum(c in string.punctuation for c in s), s.count(" "), not s.strip(), s.strip().endswith((".", "!", "?", ":", ";"))] for s in lines]
    for n in range(5):
        want = [v for k in range(n - 1, n + 3) for v in (looks[k] if 0 <= k < 5 else [-1] * 10)]
        assert np.allclose(x[n, :40], want)
        assert np.allclose(x[n, 45:], [lines[n].count(chr(c)) for c in range(32, 127)])


def test_chunks_join():
    text = "\n".join("x" * (i % 7) for i in range(segments.CHUNK * 2 + 5))
    whole = np.vstack([x for _, x in segments.features(text, 3, 3)])
    assert whole.shape[0] == segments.CHUNK * 2 + 5
    near = whole[segments.CHUNK - 1, 0:70:10]
    assert near.tolist() == [(segments.CHUNK - 1 + k) % 7 for k in range(-3, 4)]


def test_odd_input(spark, world):
    model = segments.fit_lines(world[1].filter("doc_id < 20"), world[2])
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, " \n\t\n ", "z"), (4, "one line", None), (None, "no id", None), (5, "a\n" * 100_000, None), (6, "b" * 1_000_000, None)], "doc_id long, text string, start string")
    out = segments.segments(model, odd).collect()
    assert {r.doc_id for r in out} == {4, None, 5, 6}
    assert next(r.text for r in out if r.doc_id == 4) == "one line" and next(r.end for r in out if r.doc_id == 6) == 1_000_000
    assert sum(len(r.text) for r in out if r.doc_id == 5) == 200_000
    assert segments.segments(model, odd.limit(0)).count() == 0
    assert segments.line_features(odd).filter(F.col("doc_id") == 5).count() == 100_000
