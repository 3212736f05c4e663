"""Learned sentence boundaries: planted abbreviations, initials and figures in texts that training hasn't seen; odd input."""

import random

import pytest

from docloom.operators import sentences

ABBREVIATIONS = ("dr", "mr", "inc", "u.s", "jan", "art")
NAMES = ("Miller", "Jones", "Adams", "Baker", "Clark", "Davis")
WORDS = "the court held that plain reasons support every claim which parties brought before judges when terms changed under notice given later".split()
STARTS = ("The", "However", "This", "They", "When", "Under")


def sentence(rng: random.Random) -> str:
    words = [rng.choice(WORDS) for _ in range(rng.randint(4, 12))]
    for _ in range(rng.randint(0, 3)):
        a = rng.choice(ABBREVIATIONS)
        planted = {"dr": f"Dr. {rng.choice(NAMES)}", "mr": f"Mr. {rng.choice(NAMES)}", "inc": "Inc. of", "u.s": "U.S. law", "jan": f"Jan. {rng.randint(1, 28)}", "art": f"art. {rng.randint(1, 90)}"}[a]
        words.insert(rng.randrange(1, len(words)), planted if rng.random() < 0.8 else f"{rng.choice('ABCDEFG')}. {rng.choice(NAMES)}")
    last = rng.choice(WORDS)
    return f"{rng.choice(STARTS)} {' '.join(words)} {last}{rng.choice('.....?!')}"


def corpus(seed: int, n: int) -> tuple[list, set]:
    """Texts and the places of their sentences."""
    rng, texts, want = random.Random(seed), [], set()
    for doc in range(n):
        text = ""
        for _ in range(rng.randint(1, 12)):
            text += rng.choice((" ", "\n", "  ")) if text else ""
            s = sentence(rng)
            want.add((doc, len(text), len(text) + len(s)))
            text += s
        texts.append((doc, text))
    return texts, want


@pytest.fixture(scope="module")
def model(spark):
    return sentences.fit(spark.createDataFrame(corpus(1, 1500)[0], "doc_id long, text string").repartition(5))


def found(model, spark, texts):
    df = sentences.sentences(model, spark.createDataFrame(texts, "doc_id long, text string"))
    return {(r.doc_id, r.start, r.end) for r in df.collect()}


def test_abbreviations(model):
    assert set(ABBREVIATIONS) <= {r.type for r in model.abbreviations.collect()} <= {*ABBREVIATIONS, *"abcdefg"}


def test_unseen_texts(model, spark):
    texts, want = corpus(2, 300)
    got = found(model, spark, texts)
    right = len(got & want)
    assert right / len(got) > 0.97 and right / len(want) > 0.97
    every_stop = sum(t.count(". ") + t.count(".\n") for _, t in texts)
    assert every_stop > 1.5 * len(want)  # cutting at each full stop would be wrong a third of the time


def test_blank_lines_and_junk(model, spark):
    text = 'A Title without a mark\n \n\n"The court held." However, 5 parties left!\n\nab c de\n\n...\n\n7'
    got = sorted(text[s:e] for _, s, e in found(model, spark, [(1, text)]))
    assert got == sorted(["A Title without a mark", '"The court held."', "However, 5 parties left!", "7"])


def test_odd_input(model, spark):
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 5), (5, "." * 100_000), (6, " " * 500_000 + "word" + " " * 500_000 + "x"), (7, '"' * 200_000 + "word")]
    got = found(model, spark, texts)
    assert {d for d, _, _ in got} == {4, 6, 7} and (6, 500_000, 1_000_005) in got
    assert found(model, spark, []) == set()


def test_long_text_and_partitions(model, spark):
    texts, want = corpus(3, 400)
    long = " ".join(t for _, t in texts)
    one = found(model, spark, [(9, long)])
    assert abs(len(one) - len(want)) < 0.03 * len(want)
    again = sentences.fit(spark.createDataFrame(corpus(1, 1500)[0], "doc_id long, text string").repartition(2))
    assert {tuple(r) for r in again.words.collect()} == {tuple(r) for r in model.words.collect()}
    assert found(again, spark, [(9, long)]) == one


def test_empty_training(spark):
    none = sentences.fit(spark.createDataFrame([], "doc_id long, text string"), extra=("dr",))
    assert [r.type for r in none.abbreviations.collect()] == ["dr"]
    assert found(none, spark, [(1, "One day came. Then Dr. nobody left.")]) == {(1, 0, 13), (1, 14, 35)}
