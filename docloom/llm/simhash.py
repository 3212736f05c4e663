"""SimHash near-duplicates by a binary trie self-join.

Fingerprint: 64 majority bits over the XXH64 (seed 42) hashes of a text's word shingles, repeats
included. Two fingerprints link when at most ``budget`` bits differ; groups are connected components.

How the join scales. Equal fingerprints fall together first (partial aggregation), so a group of
copies is one row from there on. A pair within the budget agrees on one of ``budget + 1`` blocks of the
open bits, so every distinct fingerprint is dealt once per block and only sub-tries with the same block
meet. A sub-trie of at most ``limit`` rows is walked by one task, which holds the trie as sorted arrays and
visits *pairs of nodes* level by level: the differing bits add up and a pair beyond the budget is pruned with
everything below it. A larger sub-trie is dealt again by the blocks of the bits that are still open, so a hot
block of n rows costs ``budget + 1`` copies a row and level whatever n is; after four levels at budget 2 thirteen
bits are open at most, which bounds a sub-trie by 8,192 rows. A task emits a spanning forest of its links, never
all pairs. Components come from contracting edges, all in DataFrames; each round is written to the shared folder.

Defined results: a null or empty text, or one without words, has fingerprint 0 and links like any
other. Fewer words than a shingle: the whole sequence is the only shingle. Repeated rows stay and share
a component. A null doc_id never names a component unless the whole component has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import columns, cut, forget, key_filter, maybe, passes, pinned, small_batches

BITS = 64


def simhash(text: str | None, size: int, seed: int = 42) -> int:
    """Unsigned fingerprint of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[k - 1 :])]
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        block = np.array(hashes[at : at + 4096], dtype="<u8")
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as the signed long of its 64 bits."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, size) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def trie_pairs(unit: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of one unit within the budget. Rows are sorted by (unit, fp), distinct within a unit."""
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    lo, hi = starts, np.r_[starts[1:], n]
    at = [lo, hi, lo, hi, np.zeros(len(lo), np.int64)]  # the node pairs of this level: two ranges and the bits that differ so far
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(BITS - 1, -1, -1):
        al, ah, bl, bh, d = at
        same = al == bl
        keep = ~(same & (ah - al == 1))
        ends = keep & ~same & (ah - al == 1) & (bh - bl == 1)
        if ends.any():  # two leaves: the rest of both paths at once
            i, j = al[ends], bl[ends]
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= budget
            found.append((i[ok], j[ok]))
        keep &= ~ends
        if not keep.any():
            break
        al, ah, bl, bh, d, same = (x[keep] for x in (al, ah, bl, bh, d, same))
        ones = np.r_[0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        parts = [(al, am, bl, bm, d, None), (am, ah, bm, bh, d, None), (al, am, bm, bh, d + 1, None), (am, ah, bl, bm, d + 1, ~same)]
        at = [[], [], [], [], []]
        for p in parts:
            ok = (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget)
            if p[5] is not None:
                ok &= p[5]
            for x, y in zip(at, p):
                x.append(y[ok])
        at = [np.concatenate(x) for x in at]
    else:
        al, ah, bl, bh, d = at
        ok = al != bl
        found.append((al[ok], bl[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n positions."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root
    return root


def _links(budget: int, rows: int):
    def solve(unit, fp, node) -> pa.RecordBatch:
        order = np.lexsort((fp, unit))
        unit, fp, node = unit[order], fp[order], node[order]
        root = forest(len(fp), *trie_pairs(unit, fp, budget))
        a = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[root[a]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)]
        for b in batches:
            new = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()]
            held = [np.concatenate(x) for x in zip(held, new)]
            while len(held[0]) > rows:  # whole units only
                change = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
                cutoff = change[change <= rows].max(initial=0) or change.min(initial=len(held[0]))
                if cutoff >= len(held[0]):
                    break
                yield solve(*(x[:cutoff] for x in held))
                held = [x[cutoff:] for x in held]
        if len(held[0]):
            yield solve(*held)

    return run


#: Sub-tries with so few open bits are walked as they are: they hold 2^13 distinct fingerprints at most.
LEAST_BITS = 13


def _deal(rows: DataFrame, budget: int) -> DataFrame:
    """Each row once per block of its ``r`` open bits ``rest``: the block's value names the new unit, the other bits stay open."""
    blocks = f"transform(sequence(0, {budget}), k -> named_struct('k', k, 'lo', cast(r * k div {budget + 1} AS int), 'hi', cast(r * (k + 1) div {budget + 1} AS int)))"
    value = "IF(hi - lo >= 64, rest, shiftrightunsigned(rest, lo) & (shiftleft(1L, hi - lo) - 1))"
    others = "shiftleft(IF(hi >= r, 0L, shiftrightunsigned(rest, hi)), lo) | (rest & (shiftleft(1L, lo) - 1))"
    x = rows.select("*", F.inline(F.expr(blocks)))
    return x.select(F.expr(f"xxhash64(unit, k, {value})").alias("unit"), "fp", "node", F.expr(others).alias("rest"), F.expr("r - (hi - lo)").alias("r"))


def links(fps: DataFrame, budget: int, limit: int = 4096) -> DataFrame:
    """Spanning links (a, b) among the distinct fingerprints ``fps(fp)`` that differ in at most ``budget`` bits.

    With a column ``space`` only fingerprints of one space meet; with a column ``node`` links name nodes.
    """
    small_batches(fps.sparkSession)
    unit = F.xxhash64("space") if "space" in fps.columns else F.lit(0).cast("long")
    level = fps.select(unit.alias("unit"), "fp", F.col("node" if "node" in fps.columns else "fp").alias("node"), F.col("fp").alias("rest"), F.lit(BITS).alias("r"))
    out, before = None, None
    while True:
        dealt = _deal(level, budget)
        counts = cut(dealt.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("open")).filter("n > 1"))
        hot = (F.col("n") > limit) & (F.col("open") > LEAST_BITS)
        met = dealt.join(counts, "unit")
        walked = met.filter(~hot).select("unit", "fp", "node").repartition("unit").sortWithinPartitions("unit")
        found = cut(walked.mapInArrow(_links(budget, 16384), "a long, b long").distinct())
        out = found if out is None else out.union(found)
        again = not counts.filter(hot).isEmpty()
        following = cut(met.filter(hot).select(*level.columns)) if again else None
        forget(counts, *([before] if before is not None else []))
        if not again:
            return out
        level = before = following


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: hash-ordered contraction, a round shrinks the edges geometrically."""
    e, rounds = cut(edges), []
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("v")).union(e.select(F.col("b").alias("node"), F.col("a").alias("v")))
        best = both.groupBy("node").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("m"))
        parent = cut(best.select("node", F.when(F.col("m") < F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v")), F.col("m.v")).otherwise(F.col("node")).alias("root")))
        rounds.append(parent)
        step = e.join(parent.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(parent.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        e = cut(step.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root")) if not rounds else rounds[0]
    for parent in rounds[1:]:
        nxt = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out


def near_duplicates(docs: DataFrame, size: int = 5, budget: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable)."""
    fps = cut(fingerprints(docs, size, id_col, text))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = cut(components(links(distinct.select("fp"), budget)))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    lows = cut(named.groupBy("root").agg(F.min("low").alias("component_id")))
    classes = cut(named.join(lows, "root").select("fp", "component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


#: For ``keep_one``: sub-fingerprints per text at most, and shingles in one of them at most (2 to 4).
SUBS, PER_SUB = 12, 4


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted; empty for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[k - 1 :])], dtype=np.uint64))


def sub_fingerprints(h: np.ndarray) -> tuple[list[int], list[int]]:
    """(spaces, signed fingerprints) of a shingle set.

    The distinct shingles are dealt by hash into 2^c groups of 2 to 4, each with its own SimHash. Two texts
    that share 80 % of their shingles differ in fewer shingles than they have groups, so some group is the
    same in both; beyond SUBS groups, the first SUBS are a sample that misses a pair at 80 % with a
    probability under 0.4 %. A text whose copy may have the next size class is dealt for that one too.
    """
    if not len(h):
        return [], []
    spaces: list[int] = []
    fps: list[int] = []
    c = max(0, (2 * len(h) // PER_SUB).bit_length() - 1)
    for c in (c, c + 1) if 1.25 * len(h) >= PER_SUB << c else (c,):
        group = (h >> np.uint64(20)) & np.uint64((1 << c) - 1)
        own = np.flatnonzero(group < SUBS)
        if not len(own):
            continue
        own = own[np.argsort(group[own], kind="stable")]
        g = group[own]
        at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        votes = np.add.reduceat(np.unpackbits(h[own].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32), at, axis=0)
        n = np.diff(np.r_[at, len(own)])
        fps += np.packbits(votes * 2 > n[:, None], axis=1, bitorder="little").reshape(-1).view("<i8").tolist()
        spaces += (g[at].astype(np.int64) + 100 * c).tolist()
    return spaces, fps


def similar_texts(docs: DataFrame, size: int = 5, similarity: float = 0.8, budget: int = 2, text: str = "text") -> DataFrame:
    """(node, root): texts (by their 64-bit hash) linked through pairs of at least that shingle similarity.

    One 64-bit SimHash can't tell such pairs: at 80 % of shared shingles about ten of its bits differ, far
    beyond any budget that prunes. So each text gets several SimHashes over small groups of its shingles;
    the trie self-join runs within each group number, and every candidate is verified by the Jaccard
    similarity of the shingle sets. Two stars per equal mark come first, so a group of copies gives links in
    proportion to its size; whatever they leave apart under one mark is then compared in full (``unresolved``).
    """
    small_batches(docs.sparkSession)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets_ = [shingle_set(t, size) for t in b.column(1).to_pylist()]
            out = [sub_fingerprints(h) for h in sets_]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets_], pa.int64()), *(pa.array([x[k] for x in out], pa.list_(pa.int64())) for k in (0, 1))], ["uid", "w", "spaces", "fps"])

    # no text is shuffled: copies give the same few marks, which meet after the map side's aggregation
    texts = docs.select(F.xxhash64(F.col(text)).alias("uid"), F.col(text).alias("t"))
    marked = texts.mapInArrow(marks, "uid long, w long, spaces array<long>, fps array<long>")
    marked = cut(marked.groupBy("uid").agg(F.first("w").alias("w"), F.first("spaces").alias("spaces"), F.first("fps").alias("fps")))
    subs = marked.select("uid", "w", F.explode(F.arrays_zip("spaces", "fps")).alias("x")).select("uid", "w", F.col("x.spaces").alias("space"), F.col("x.fps").alias("fp"))
    first, second = (F.min(F.struct(F.xxhash64(F.lit(k), "uid").alias("h"), "uid", "w")) for k in (1, 2))
    heads = cut(subs.groupBy("space", "fp").agg(first.alias("h1"), second.alias("h2"), F.count(F.lit(1)).alias("n")))
    crowd = heads.filter("n > 1").select("space", "fp", F.array("h1", "h2").alias("heads"))
    alike = lambda a, b: (F.col(a) >= F.lit(similarity) * F.col(b) - 1e-9) & (F.col(b) >= F.lit(similarity) * F.col(a) - 1e-9)  # noqa: E731  sets of other sizes can't reach the similarity
    stars = subs.join(crowd, ["space", "fp"]).select(F.col("uid").alias("a"), "w", F.explode("heads").alias("h")).filter(alike("w", "h.w")).select("a", F.col("h.uid").alias("b"))
    near = links(heads.select("space", "fp", F.col("h1.uid").alias("node")), budget)
    pairs = cut(stars.union(near).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    held = shingle_sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), size)
    left = pairs.join(held.select(F.col("uid").alias("a"), F.col("hs").alias("ha")), "a")
    both = pinned(left.join(held.select(F.col("uid").alias("b"), F.col("hs").alias("hb")), "b"), both=F.size(F.array_intersect("ha", "hb")))
    roots = cut(components(both.filter(F.col("both") >= F.lit(similarity) * (F.size("ha") + F.size("hb") - F.col("both")) - 1e-9).select("a", "b")))
    # the heads met every member of their mark; of the others, only those in different components are left
    rest = subs.join(heads.filter("n > 3").select("space", "fp", "h1", "h2"), ["space", "fp"]).filter("uid <> h1.uid AND uid <> h2.uid")
    rest = rest.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").select(F.xxhash64("space", "fp").alias("mark"), "uid", F.coalesce("root", "uid").alias("root"))
    rest = cut(rest)
    more = cut(components(unresolved(rest, held, similarity)))
    up = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    out = cut(up.union(more.join(roots.select("node"), "node", "left_anti").select("node", "root")))
    forget(marked, heads, pairs, held, roots, rest, more)
    return out


def shingle_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(uid, hs): 32-bit shingle hashes of the texts ``texts(uid, t)`` that are wanted, once each, as a written table.

    The sets are made where the texts are read, behind a filter of fixed size, so no text is shuffled.
    """
    wanted = cut(wanted)
    known = key_filter(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(maybe(known.value, b.column(0).to_numpy())))
            hs = [np.unique(shingle_set(t, size).astype(np.uint32)).view(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hs, pa.list_(pa.int32()))], ["uid", "hs"])

    made = texts.mapInArrow(sets, "uid long, hs array<int>").groupBy("uid").agg(F.first("hs").alias("hs"))
    out = cut(made.join(wanted.withColumnRenamed("wanted", "uid"), "uid", "left_semi"))
    forget(wanted)
    return out


def similar_pairs(sizes: np.ndarray, flat: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of all pairs of sets of at least that Jaccard similarity; ``flat`` holds the sets one after another."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[col] > 1  # what only one set has is in no intersection
    row, col = row[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
        a, b = np.searchsorted(col, (lo, lo + 2048))
        has = np.zeros((n, int(col[b - 1]) + 1 - lo), np.float32)
        has[row[a:b], col[a:b] - lo] = 1
        both += has @ has.T
    i, j = np.nonzero(np.triu(both, 1))
    common = both[i, j].astype(np.float64)
    ok = common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9
    return i[ok], j[ok]


def _meet(similarity: float):
    def solve(root: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        names, own = np.unique(root, return_inverse=True)
        i, j = similar_pairs(sizes, flat, similarity) if len(names) > 1 else (own[:0], own[:0])
        low = forest(len(names), own[i], own[j])
        a = np.flatnonzero(low != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[low[a]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the parts of one unit
        last = None
        for b in batches:
            unit, root = b.column(0).to_numpy(), b.column(1).to_numpy()
            sizes, flat = np.diff(b.column(2).offsets.to_numpy()).astype(np.int64), b.column(2).flatten().to_numpy()
            ends = np.r_[0, np.cumsum(sizes)]
            at = np.r_[0, np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)]
            for lo, hi in zip(at[:-1], at[1:]):
                if lo == hi:
                    continue
                if held and unit[lo] != last:
                    yield solve(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                last = unit[lo]
                held.append((root[lo:hi], sizes[lo:hi], flat[ends[lo] : ends[hi]]))
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return run


def unresolved(members: DataFrame, sets: DataFrame, similarity: float, chunk: int = 256, shingles: int = 1 << 20) -> DataFrame:
    """Links (a, b) between components that hold a similar pair under one mark: of ``members(mark, uid, root)``, every pair of different roots is compared.

    The largest component of a mark need not meet itself; its members and the others are cut into chunks, bounded
    by rows and by shingles of ``sets(uid, hs)``, and joined chunk pair by chunk pair, so a hot mark spreads over tasks.
    """
    weighed = cut(members.join(sets.select("uid", F.size("hs").alias("w")), "uid"))
    parts = weighed.groupBy("mark", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    most = parts.groupBy("mark").agg(F.max(F.struct("n", "w", "root")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    pieces = lambda n, w: F.ceil(F.greatest(n / F.lit(chunk), w / F.lit(shingles)))
    plan = cut(most.select("mark", F.col("main.root").alias("main"), pieces(F.col("main.n"), F.col("main.w")).alias("p"), pieces(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("q")))
    dealt = weighed.join(plan, "mark").withColumn("c", F.pmod(F.xxhash64(F.lit(9), "uid"), F.when(F.col("root") == F.col("main"), F.col("p")).otherwise(F.col("q"))))
    units = F.expr("""IF(root = main, transform(sequence(0L, q - 1), j -> xxhash64(mark, 0, c, j)),
        concat(transform(sequence(0L, p - 1), i -> xxhash64(mark, 0, i, c)), transform(sequence(0L, q - 1), j -> xxhash64(mark, 1, least(c, j), greatest(c, j)))))""")
    small_batches(members.sparkSession)
    met = dealt.select("uid", "root", F.explode(units).alias("unit")).join(sets, "uid").select("unit", "root", "hs")
    return met.repartition("unit").sortWithinPartitions("unit").mapInArrow(_meet(similarity), "a long, b long").distinct()


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies, the smallest doc_id (nulls last); all columns kept.

    Groups are components of ``similar_texts``; equal texts belong together (by a 64-bit hash). Texts without
    words are alike only if equal. Of rows that repeat both id and text one stays.
    """
    uid, doc = F.xxhash64(F.col(text)), F.col(id_col)
    ids = cut(docs.select(uid.alias("uid"), doc.alias("doc")).groupBy("uid", "doc").agg(F.count(F.lit(1)).alias("n")))
    roots = similar_texts(docs, size, similarity, text=text)
    classes = cut(ids.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")))
    low = F.min(F.struct(F.col("doc").isNull().alias("z"), "doc", "uid"))
    best = cut(classes.groupBy("root").agg(low.alias("best"), F.sum("n").alias("n")).filter("n > 1").select("root", "best"))
    stays = F.col("best.doc").eqNullSafe(F.col("doc")) & (F.col("best.uid") == F.col("uid"))
    verdict = classes.join(best, "root").filter(~stays | (F.col("n") > 1)).select("uid", "doc", stays.alias("once"))
    verdict = cut(verdict.toDF("__s_uid", "__s_doc", "__s_once"))
    known = key_filter(verdict.select(F.xxhash64("__s_uid", "__s_doc")))
    # rows that the filter lets through meet the verdicts; all others stay where they are
    asked = docs.withColumn("__s_key", uid).withColumn("__s_maybe", passes(known, F.xxhash64("__s_key", doc)))
    judged = asked.filter("__s_maybe").join(verdict, (F.col("__s_key") == F.col("__s_uid")) & doc.eqNullSafe(F.col("__s_doc")), "left")
    free = asked.filter("NOT __s_maybe").select(*columns(docs)).union(judged.filter("__s_uid IS NULL").select(*columns(docs)))
    forget(ids, classes, best, roots)
    return free.union(judged.filter("__s_once").dropDuplicates([id_col, text]).select(*columns(docs)))


def simhash_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 3, 2).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
