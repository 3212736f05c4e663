"""Tokenization automaton, filter audit and lexical search against the library, SQL and brute force."""

import hashlib
import json
from itertools import permutations
from math import factorial, floor, log

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from docloom.llm import automaton, filter_audit, lexical_search
from docloom.llm.automaton import Automaton, Words
from docloom.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.test_llm import SF, docs, empty, got, rows  # noqa: F401


def sql(name, **tables):
    c = duckdb.connect()
    for t, df in tables.items():
        pdf = df.toArrow()  # noqa: F841
        c.sql(f"CREATE TABLE {t} AS SELECT * FROM pdf")
    q = c.sql(ORACLES[name])
    return rows(q.fetchall(), q.columns)


@pytest.fixture(scope="module")
def items(spark):
    data = [(1, "the a b c"), (2, "the the"), (3, None), (4, ""), (5, "nosuchterm zzz"), (6, "Password token é ü 日本"), (6, "a b"), (1, "the a b c"), (None, "lines is long enough passage 1234")]
    return spark.createDataFrame(data, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("doc_id", F.lit("x"))


@pytest.fixture(scope="module")
def labels(spark):
    data = [(i, i % 2, (i // 2) % 2) for i in range(0, 40, 2)] + [(1, 1, None), (1, 0, 1), (3, None, None), (None, 1, 1), (999, 1, 1)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int").withColumn("n", F.lit("q"))


# --- op11

def test_automaton_spells_what_the_library_gives(docs, empty):
    library = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), r.doc_id, h(",".join(map(str, ids))), len(ids)))
    assert got(automaton.automaton_query(docs, tokenizer_path())) == sorted(want, key=repr)
    assert automaton.automaton_query(empty, tokenizer_path()).collect() == []


def test_automaton_on_random_words():
    import random

    rng, library = random.Random(3), Tokenizer.from_file(tokenizer_path())
    words = Words(Automaton(open(tokenizer_path()).read()))
    for alphabet in ("ab", "aaaab", "there inat", "=-_ ", "日本é\U0001f600x", "  \n\t", "0123456789", "'stdmrlve "):
        for _ in range(500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert words.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t
    for t in ("z" * 200_000, "ab" * 60_000):
        assert words.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert sum(len(words.automaton.labels[i]) for i in words.ids(" " * 2_000_000)) == 2_000_000


def test_automaton_of_small_merges():
    """Every word over two letters, for merge lists with repeats, overlaps and a token that no word gives."""
    symbols = automaton.byte_symbols()
    for merges in (["a a", "aa a"], ["a b", "b a", "ab a", "b ab"], ["b b", "a bb", "a b", "b a", "bb bb"], ["a a", "aa aa", "a b", "aaaa b"], ["a b", "b b", "ab b", "abb a", "a abb"]):
        vocab = {s: i for i, s in enumerate(symbols)}
        for m in merges:
            vocab[m.replace(" ", "")] = len(vocab)
        spec = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel"}, "normalizer": None}
        own, library = Automaton(json.dumps(spec)), Tokenizer(models.BPE(vocab=vocab, merges=[tuple(m.split()) for m in merges]))
        for n in range(1, 11):
            for x in range(1 << n):
                w = "".join("ab"[x >> i & 1] for i in range(n))
                assert own.word(w.encode()) == library.encode(w).ids, (merges, w)
    with pytest.raises(ValueError):
        Automaton(json.dumps({"model": {"type": "BPE", "vocab": vocab, "merges": ["abb a", "a b"]}, "pre_tokenizer": {"type": "ByteLevel"}}))


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([([464, 50256, 222, -1, 10**6], 1), (None, 2), ([], 3)], "ids array<int>, `odd``name` int")
    out = automaton.decode(df, tokenizer_path()).collect()
    assert [r.text for r in out] == ["The<|endoftext|>�", None, ""] and out[0]["odd`name"] == 1
    with pytest.raises(ValueError):
        automaton.decode(df.withColumn("text", F.lit(1)), tokenizer_path())


# --- op12

def test_plain_changes():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filter_audit.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == factorial(n) == 1 + sum(1 for _ in filter_audit.plain_changes(n))


def test_audit_odd_rows(docs, labels, empty):
    df = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s").when(F.col("doc_id") % 3 == 1, "ü"))
    assert got(filter_audit.audit_query(df, labels)) == sql("op12_filter_audit", documents=df, labels=labels)
    assert filter_audit.audit_query(empty, labels).collect() == []
    assert got(filter_audit.audit_query(df, labels.limit(0))) == sql("op12_filter_audit", documents=df, labels=labels.limit(0))


def test_audit_of_other_filters(docs):
    filters = {"x": F.col("doc_id") % 2 == 0, "y": F.length("text") > 40, "z": F.col("text").contains("a")}
    out = filter_audit.audit(docs, filters).collect()
    data = [(r.doc_id is not None and r.doc_id % 2 == 0, r.text is not None and len(r.text) > 40, r.text is not None and "a" in r.text, r.source or "") for r in docs.collect()]
    assert {r.part for r in out} == {d[3] for d in data} and len(out) == 6 * 3 * 2
    for r in out:
        own = [dict(zip("xyz", d)) for d in data if d[3] == r.part]
        for f in r.filter_order[: r.step - 1]:
            own = [d for d in own if not d[f]]
        gone = sum(d[r.filter_order[r.step - 1]] for d in own)
        assert (r.removed, r.kept) == (gone, len(own) - gone)
    for part in {r.part for r in out}:
        for f in "xyz":
            mine = [r for r in out if r.part == part and r.filter_order[r.step - 1] == f]
            assert {r.shapley for r in mine} == {sum(r.removed for r in mine)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, {"long": F.lit(True)})
    assert len(set(permutations("xyz"))) == 6


# --- op13

def brute(docs, items, k=20):
    texts = [(r.doc_id, lexical_search.terms_of(r.text)) for r in docs]
    texts = [(i, t) for i, t in texts if t]
    total, lengths = len(texts), sum(len(t) for _, t in texts)
    df = {}
    for _, t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in {(r.item_id, r.text or "") for r in items}:
        scores = []
        for i, t in texts:
            m, s = 75 + 25 * len(t) * total // lengths, 0
            for w in lexical_search.terms_of(text):
                if w in df and (tf := t.count(w)):
                    s += floor(1000 * log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(i, item, rank, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_terms, doc_range, block", [(2_000_000, 2048, 4 << 20), (50, 4, 80), (1, 1, 4 << 20)])
def test_search_odd_rows(docs, items, empty, monkeypatch, shard_terms, doc_range, block):
    for name, value in (("SHARD_TERMS", shard_terms), ("RANGE", doc_range), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(lexical_search, name, value)
    want = brute(docs.collect(), items.collect())
    assert want and got(lexical_search.search(docs, items)) == want == sql("op13_lexical_search", documents=docs, benchmark=items)
    assert got(lexical_search.search(docs, items, k=3)) == brute(docs.collect(), items.collect(), 3)
    assert lexical_search.search(empty, items).collect() == [] == lexical_search.search(docs, items.limit(0)).collect()


def test_search_copies(spark):
    """A thousand equal documents: the smallest ids win the ties, whatever partition holds them."""
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one two three").otherwise(F.concat(F.lit("four "), F.col("id"))).alias("text")).orderBy(F.rand(3)).repartition(5)
    out = lexical_search.search(df, spark.createDataFrame([(1, "two four")], "item_id int, text string"))
    assert sorted(r.rank for r in out.collect()) == list(range(1, 21)) and {r.doc_id for r in out.collect()} == set(range(1, 41, 2))


def test_non_essential_postings_are_probed_only(spark, docs):
    """With a score to beat, terms that can't reach it together find no documents of their own."""
    index = lexical_search.build_index(docs.coalesce(1)).first()
    wanted = {b"the": 0, b"x": 1}
    shard = lexical_search.Shard(wanted, {0: 5, 1: 5000}, 40, 4000, bytes(index.lengths), bytes(index.terms), bytes(index.ends), bytes(index.docs), bytes(index.occurs))
    most = shard.lists[0][2]
    for found, _ in shard.best({0: 1, 1: 1}, 20, most + 1):
        assert set(found) <= set(shard.lists[1][0])
    assert list(shard.best({0: 1}, 20, most + 1)) == []


def test_queries_on_sf(spark):
    assert {"op11_bpe_automaton", "op12_filter_audit", "op13_lexical_search"} <= set(QUERIES)
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    assert got(QUERIES["op12_filter_audit"](spark, SF)) == sql("op12_filter_audit", documents=read("documents"), labels=read("labels"))
    assert got(QUERIES["op13_lexical_search"](spark, SF)) == sql("op13_lexical_search", documents=read("documents"), benchmark=read("benchmark"))
