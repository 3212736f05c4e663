"""Dictionary entities against a plain search over all aliases at all places."""

import random
import re

from pyspark.sql import functions as F

from docloom.operators import dictionary

TOKEN = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+|[^\x80-\U0010ffff0-9A-Za-z_\s]")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute(docs, entries, overlaps):
    out = set()
    for d, text in set(docs):
        ts = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text or "")]
        found = []
        for e, alias, strict, p in entries:
            a = TOKEN.findall(alias or "")
            fold = (lambda s: s) if strict else lower
            for i in range(len(ts) - len(a) + 1 if a else 0):
                if [fold(t[0]) for t in ts[i : i + len(a)]] == [fold(x) for x in a]:
                    found.append((i, -len(a), -(p or 0), e, lower(" ".join(a)), " ".join(a) if strict else None))
        best = {}
        for f in sorted(found, key=lambda f: f[:4]):
            best.setdefault((f[0], f[4], f[5]), f)  # one entity per alias
        end = 0
        for i, n, _, e, _, _ in sorted(best.values(), key=lambda f: f[:4]):
            if overlaps or i >= end:
                end = i - n
                s, t = ts[i][1], ts[i - n - 1][2]
                out.add((d, s, t, text[s:t], e, i, -n))
    return out


ENTRIES = [(1, "New York", False, 0), (2, "New York City", False, 0), (3, "York City Court of Appeals", False, 5), (4, "IT", True, 1), (5, "it works", False, None), (6, "new  york", False, 3), (7, "U.S.", True, 0), (8, "U.S. Supreme Court", False, 0), (9, "", False, 0), (10, None, None, None), (11, "Zürich", False, 0), (2, "NYC", None, 0), (12, "a a", False, 0)]
DOCS = [(1, "In new york city court of appeals, NEW YORK and New\n York City."), (2, "IT works; it works. It is IT, u.s. and U.S. supreme court (nyc)"), (3, None), (4, ""), (5, "a a a a a Zürich zürich 日本"), (None, "New York"), (1, "York"), (2, "IT works; it works. It is IT, u.s. and U.S. supreme court (nyc)")]


def run(spark, docs, entries, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("extra")).withColumn("key", F.lit(1))
    e = spark.createDataFrame(entries, "entity_id int, alias string, strict boolean, priority int").withColumn("text", F.lit("x"))
    return [tuple(r) for r in dictionary.entities(d, e, "strict", "priority", **options).collect()]


def test_entities(spark):
    for overlaps in (False, True):
        rows = run(spark, DOCS, ENTRIES, overlaps=overlaps)
        assert set(rows) == brute(DOCS, ENTRIES, overlaps) and len(rows) == len(set(rows))
    assert run(spark, [], ENTRIES) == [] == run(spark, DOCS, [])


def test_random_dictionaries(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "b", "c", "A", "B", "."])
    entries = [(i, " ".join(word() for _ in range(rng.randint(1, 4))), rng.random() < 0.3, rng.randint(0, 2)) for i in range(60)]
    docs = [(i, rng.choice([" ", "  "]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(99, "a b c . " * 3000)]
    assert set(run(spark, docs, entries)) == brute(docs, entries, False)
