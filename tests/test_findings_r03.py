"""Findings of round 3, on inputs that failed before."""

import functools
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from docloom.functions import extract, records
from docloom.operators import dense, evaluate, feedback, index, rank, score, sets


def test_word_edges_are_ascii(spark):
    """a letter outside ASCII ends a word, as in the SQL."""
    text = "a 5 miércoles, 3 kmü, 7 miles, 9 kms"
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(extract.matches("distance", F.col("text")).alias("m"), records.records("distance", F.col("text")).alias("r")).first()
    want = duckdb.connect().execute("SELECT regexp_extract_all(?, ?, 0)", [text, extract.PATTERNS["distance"]]).fetchall()[0][0]
    assert row.m == want == ["5 mi", "3 km", "7 miles"]
    assert [(r.amount, r.unit, r.text) for r in row.r] == [(5.0, "mile", "5 mi"), (3.0, "kilometer", "3 km"), (7.0, "mile", "7 miles")]


def test_boost_rounds_halves_as_sql(spark):
    """products of six-place scores that lie on a half of the sixth place."""
    pairs = [(1, n, round(n / 1000, 6), round(0.000001 * (500 * m + 500), 6)) for n, m in ((n, m) for n in range(1, 1000, 2) for m in range(3))]
    pairs = [(q, i, s, c) for i, (q, _, s, c) in enumerate(pairs)]
    df = spark.createDataFrame(pairs, "query_id long, doc_id long, score double, c double")
    got = {r.doc_id: r.score for r in rank.boost(df.select("query_id", "doc_id", "score"), df.select("query_id", "doc_id", F.col("c").alias("score")), 1.0).collect()}
    c = duckdb.connect()
    assert got == {i: c.execute("SELECT round(?::DOUBLE * (1 + ?::DOUBLE), 6)", [s, x]).fetchall()[0][0] for _, i, s, x in pairs}


DENSE_MET = dense.met


def _vectors(spark, n, seed, groups):
    """Vectors with groups of equal ones and labels that repeat."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(groups, 6))
    return spark.createDataFrame([(i, base[r.integers(groups)].tolist(), int(r.integers(3)) if i % 7 else None) for i in range(n)], "doc_id long, v array<double>, label int")


def test_dense_blocks_lose_nothing(spark, monkeypatch):
    """Blocks give what all pairs give, with many equal scores, and list no pairs."""
    monkeypatch.setattr(dense, "met", functools.partial(dense.met, sizes=(7, 90)))
    v = _vectors(spark, 260, 1, 40).select("doc_id", "v").localCheckpoint()
    q = v.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    every = score.dense_top(q, v)
    assert rows(rank.top(dense.best(q, v, 12), 12)) == rows(rank.top(every, 12))
    found = dense.best(q, v, 12, own=False)
    assert rows(rank.top(found, 12)) == rows(rank.top(every.filter("query_id <> doc_id"), 12))
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    parts = F.array(F.slice("v", 1, 3), F.slice("v", 4, 3))
    two = rank.top(dense.best(q, v, 5, parts=parts), 5)
    half = lambda a, n: score.dense_top(q.withColumn("v", F.slice("v", a, 3)), v.withColumn("v", F.slice("v", a, 3))).withColumnRenamed("score", n)
    both = half(1, "a").join(half(4, "b"), ["query_id", "doc_id"]).select("query_id", "doc_id", F.round(F.col("a") + F.col("b"), 6).alias("score"))
    assert rows(two) == rows(rank.top(both, 5))


def test_chunk_blocks_equal_pairs(spark):
    """documents of one to seven chunks."""
    v = _vectors(spark, 150, 2, 150).select((F.col("doc_id") * 7 % 41).alias("doc_id"), F.col("doc_id").alias("chunk"), "v").filter("doc_id < 20 OR chunk % 3 > 0").localCheckpoint()
    q = v.filter("doc_id % 4 = 0").withColumnRenamed("doc_id", "query_id")
    key = lambda df, n: df.select(F.struct(F.col(n).alias("id"), F.col("chunk").alias("c")).alias(n), "v")
    p = score.dense_top(key(q, "query_id"), key(v, "doc_id"))
    p = p.select(F.col("query_id.id").alias("query_id"), F.col("doc_id.id").alias("doc_id"), F.col("query_id.c").alias("q_chunk"), F.col("doc_id.c").alias("d_chunk"), F.col("score").alias("sim")).localCheckpoint()
    rows = lambda df: {(r.query_id, r.doc_id): r.score for r in df.collect()}
    for how in ("max", "mean", "sum"):
        got, want = rows(dense.chunked(q, v, how)), rows(rank.chunk_scores(p, how))
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1.1e-6 for x in want)  # a half of the last place may fall either way


def test_gold_by_label_lists_no_pairs(spark):
    """The same figures as from listed pairs, null labels included, without the pairs."""
    v = _vectors(spark, 200, 3, 200).localCheckpoint()
    q = v.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    run = rank.top(score.dense_top(q, v), 20).localCheckpoint()
    labels = evaluate.ByLabel(q.select("query_id", "label"), v.select("doc_id", "label"))
    pairs = v.join(q.select("query_id", "label"), "label").filter("query_id <> doc_id").select("query_id", "doc_id").localCheckpoint()
    pool = v.filter("doc_id % 3 > 0")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for f in (evaluate.micro_f1, evaluate.micro_of_results, evaluate.micro_official, evaluate.micro_fixed_k, evaluate.best_k, evaluate.micro_with_self, evaluate.macro_fixed_k, evaluate.comprehensive, evaluate.detailed, evaluate.summary,
              lambda r, g: evaluate.per_query(r, g, 10), lambda r, g: evaluate.macro_official(r, g, 7, pool), lambda r, g: evaluate.by_threshold(r, g, (0.1, 0.5))):
        assert rows(f(run, labels)) == rows(f(run, pairs))


def test_sets_meet_as_classes(spark):
    """Equal sets are one class, so 200 copies of five sets are no more joined rows than pairs come out; results as pair by pair."""
    kinds = [("x", "y"), ("y", "z"), ("x", "y", "z"), ("q",), ("x",)]
    rows = [(i, e) for i in range(200) for e in kinds[i % 5]]
    held = {i: set(kinds[i % 5]) for i in range(200)}
    want = {(a, b): held[a] & held[b] for a in held for b in held if a < b and held[a] & held[b]}
    got = sets.set_jaccard(spark.createDataFrame([*rows, (1, None), (3, "q")], "id long, element string"))
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == {(a, b): round(len(c) / len(held[a] | held[b]), 6) for (a, b), c in want.items()}
    assert got.count() == len(want)
    edges = sets.label_edges(spark.createDataFrame([*rows, (1, " "), (3, " q ")], "case_id long, label string"), 2)
    assert {(r.source_case_id, r.target_case_id): (r.shared_count, r.shared_labels) for r in edges.collect()} == {p: (len(c), "|".join(sorted(c))) for p, c in want.items() if len(c) >= 2}
    known, membership = sets.classes(spark.createDataFrame(rows, "id long, element string"))
    assert known.count() == 5 and membership.count() == 200


def test_op4_shuffles_whole_records(spark):
    """the query's places are those of the records, and the texts cross the shuffle."""
    from docloom.llm import sharding

    docs = spark.createDataFrame([(i, None if i % 9 == 0 else f"text {i % 7} " * (i % 11), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    want = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs, 8).select("row.doc_id", "shard", "slot").collect()}
    got = sharding.sharding_query(docs)
    assert {r.doc_id: (r.shard, r.slot) for r in got.collect()} == want
    for r in got.collect():
        text = (None if r.doc_id % 9 == 0 else f"text {r.doc_id % 7} " * (r.doc_id % 11)) or ""
        assert (r["size"], r.text_crc32) == (len(text) + 1, zlib.crc32(text.encode()))


def test_lexical_hits_move_once(spark):
    """joined rows of queries and postings aren't shuffled, and the postings not by term."""
    docs = spark.createDataFrame([(i, f"common word{i % 5} word{i % 3} rare{i}") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common wordx rarea"), (2, "word common common")], "query_id long, text string")
    built = index.TermIndex.build(docs)
    for run in (score.bm25(built, asked), score.tfidf(built, asked), score.bm25_floor(built, asked), feedback.search(built, feedback.rm3(built, asked))):
        plan = run._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(query_id#\w+, doc_id#", plan) and len(re.findall(r"Exchange hashpartitioning\(doc_id#\w+, \d+\), REPARTITION_BY_COL", plan)) == 1
        assert run.count() == 80


def test_word_vectors_count_known_words_alone(spark, monkeypatch):
    """neighbours of known words are numbers before they move, equal to those counted from all words; vectors go to the postings."""
    from docloom.functions.text import simple_tokens
    from docloom.operators import learned, reports

    monkeypatch.setattr(learned, "_TOKENS", 7)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j * j % 13}" for j in range(i % 17))) for i in range(120)] + [(998, ""), (999, None)], "doc_id long, text string").repartition(3)
    ids, words = sorted(f"w{i}" for i in range(0, 13, 2)), simple_tokens(F.col("text"))
    every = {(r.a, r.b): r.weight for r in reports.cooccurrence(docs, words, 4).collect()}
    got = {(ids[r.i], ids[r.j]): r.weight for r in learned.near_pairs(docs, words, ids, 4).collect()}
    assert got == {p: w for p, w in every.items() if set(p) <= set(ids)} and len(got) > 10
    counts = docs.select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).localCheckpoint()
    vectors, weights = spark.createDataFrame([(x, [float(len(x)), 1.0]) for x in ids], "term string, v array<double>"), spark.createDataFrame([("w2", 2.0)], "term string, weight double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reports.mean_vectors(counts, weights, vectors, "doc_id", 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and not re.search(r"hashpartitioning\(term#", plan)


def _near_copies(spark):
    """Texts of 0 to 40 words with copies, near copies, empty and null ones."""
    r = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in r.integers(0, 30, n)) for n in (0, 1, 2, 3, 9, 20, 40, 40)]
    texts = [None if i % 31 == 0 else (base[i % 8] + (f" w{i % 30}" if i % 3 else "")) for i in range(220)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_minhash_pairs_come_from_blocks(spark, monkeypatch):
    """signatures of a table are those of the expression, pairs those of all pairs, without listing them."""
    from docloom.operators import minhash

    monkeypatch.setattr(dense, "met", lambda *a: DENSE_MET(*a[:6], (7, 90)))
    hashes = minhash.family(32)
    sh = _near_copies(spark).select("doc_id", minhash.shingles(F.col("text"), 3).alias("sh")).localCheckpoint()
    sig = minhash.signatures(sh, "doc_id", hashes).localCheckpoint()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sig) == rows(sh.select("doc_id", minhash.signature(F.col("sh"), hashes)))
    q = sig.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    every = minhash.estimates(q, sig)
    assert every.count() == 11 * 219
    for least in (0.01, 0.1, 0.25, 1.0):
        found = minhash.estimates(q, sig, least)
        assert rows(found) == rows(every.filter(F.col("score") >= least))
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_shingle_pairs_are_counted_in_blocks(spark, monkeypatch):
    """F16: the similarities of all pairs that share a shingle, without a joined row for each shared shingle."""
    from docloom.operators import minhash

    monkeypatch.setattr(dense, "met", lambda *a: DENSE_MET(*a[:6], (7, 90)))
    sh = _near_copies(spark).select("doc_id", minhash.shingles(F.col("text"), 3).alias("sh")).localCheckpoint()
    q = sh.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    held = {r.doc_id: set(r.sh) for r in sh.collect()}
    want = {(a, b): round(len(held[a] & held[b]) / len(held[a] | held[b]), 6) for a in held for b in held if a % 20 == 0 and a != b and held[a] & held[b]}
    found = minhash.exact(q, sh)
    assert {(r.query_id, r.doc_id): r.score for r in found.collect()} == want and found.count() == len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((s|query_id)#\w+, (doc_id)?", plan)


def test_diffusion_lists_no_edges(spark):
    """scores as by the listed edges, with isolated documents, several rows of a pair, scores of either sign; no document meets a document."""
    r = np.random.default_rng(9)
    held = spark.createDataFrame({(int(d), f"e{e}") for d, e in zip(r.integers(0, 30, 90), r.integers(0, 40, 90))} | {(77, "alone"), (88, None)}, "doc_id long, element string").localCheckpoint()
    run = spark.createDataFrame([(int(q), int(d), float(s)) for q, d, s in zip(r.integers(0, 40, 400), r.integers(0, 35, 400), r.integers(-3, 9, 400))] + [(1, 77, 2.0), (2, 99, 1.0)], "query_id long, doc_id long, score double").localCheckpoint()
    x = held.withColumnRenamed("doc_id", "src")
    edges = x.join(held.withColumnRenamed("doc_id", "dst"), "element").filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    near = lambda df: {(a.query_id, a.doc_id): round(a.score, 5) for a in df.collect()}
    found = sets.diffuse_shared(run, held)
    got, want = near(found), near(sets.diffuse(run, edges))
    assert got.keys() == want.keys() and len(got) > 500 and all(abs(got[k] - want[k]) < 2e-5 for k in want)
    assert not re.search(r"hashpartitioning\((src|s)#\w+, dst#", found._jdf.queryExecution().executedPlan().toString())


def test_sets_meet_by_two_elements(spark):
    """only ids that share two elements are joined; counts and weights are those of all pairs."""
    r = np.random.default_rng(11)
    rows = [(int(i), int(e)) for i, e in zip(r.integers(0, 60, 400), r.integers(0, 25, 400))] + [(i, 99) for i in range(200, 400)]  # a hot element that alone joins nobody
    held: dict[int, set] = {}
    for i, e in rows:
        held.setdefault(i, set()).add(e)
    df = {e: sum(e in x for x in held.values()) for e in range(100)}
    w = {e: (np.log((len(held) + 1) / (n + 1)) + 1) ** 2 for e, n in df.items()}
    want = {(a, b): held[a] & held[b] for a in held for b in held if a < b and len(held[a] & held[b]) >= 2}
    found = sets.sharing_two(spark.createDataFrame(rows, "id long, element long"))
    got = {(x.a, x.b): x for x in found.collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for (a, b), c in want.items():
        x = got[a, b]
        assert (x.shared, x.na, x.nb) == (len(c), len(held[a]), len(held[b]))
        assert np.allclose((x.dot, x.za**2, x.zb**2), (sum(w[e] for e in c), sum(w[e] for e in held[a]), sum(w[e] for e in held[b])))


def test_co_cite_meets_in_blocks(spark, monkeypatch):
    """cosines of all ids with a common pair, by blocks of few ids and batches that cut pairs; no joined row of a pair is listed."""
    r = np.random.default_rng(13)
    counts = {(int(i) * 3, f"a{a}", int(b)): int(n) for i, a, b, n in zip(r.integers(0, 70, 600), r.integers(0, 12, 600), r.integers(0, 4, 600), r.integers(1, 9, 600))}
    counts |= {(i * 3, "hot", 1): 1 + i % 5 for i in range(0, 70, 2)} | {(1000, "alone", 1): 2}
    vectors: dict[int, dict] = {}
    for (i, a, b), n in counts.items():
        vectors.setdefault(i, {})[a, b] = n
    norm = {i: float(np.sqrt(sum(n * n for n in v.values()))) for i, v in vectors.items()}
    want = {(x, y): sum(n * vectors[y].get(e, 0) for e, n in vectors[x].items()) for x in vectors for y in vectors if x != y and vectors[x].keys() & vectors[y].keys()}
    norm[0] = float(np.sqrt(norm[0] ** 2 + 49))  # a row with a null counts in the norm alone
    rows = [(i, a, b, n) for (i, a, b), n in counts.items()] + [(0, None, 1, 7), (None, "hot", 1, 3)]
    df = spark.createDataFrame(rows, "id long, a string, b int, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for block in (7, 2048):
            monkeypatch.setattr(sets, "_BLOCK", block)
            found = sets.co_cite_cosine(df)
            got = {(x.query_id, x.doc_id): x.score for x in found.collect()}
            assert got.keys() == want.keys() and len(got) == found.count() > 1000
            assert all(abs(got[x, y] - dot / (norm[x] * norm[y])) < 5.1e-7 for (x, y), dot in want.items())
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\((query_id|x)#\w+, (doc_id|y)#", plan) and not re.search(r"Join \[a#", plan)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
