"""Similarities of weighted sets ``(id, element)``: only pairs with a common element are formed."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.operators import dense
from docloom.sources.tables import forget, written


def counted(mentions: DataFrame, id_col: str = "id", element: str = "element") -> DataFrame:
    """(id, element, tf) of a multiset of mentions."""
    return mentions.groupBy(F.col(id_col).alias("id"), F.col(element).alias("element")).agg(F.count(F.lit(1)).alias("tf"))


def multiset_similarity(a: DataFrame, b: DataFrame, least_shared: int = 1) -> DataFrame:
    """(query_id, doc_id, shared, recall, soft_jaccard, freq_coupling, freq_idf_cosine) of counted sets a and b.

    Element weights are smooth idf over ``b``, 1 for an element that ``b`` lacks. An element that a large part of ``b`` holds makes pairs in
    proportion to its holders in ``a`` times those in ``b``: pass a bounded query set as ``a``.
    """
    n = b.agg(F.count_distinct("id").alias("n"))
    idf = b.groupBy("element").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("element", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("i"))  # one row

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.join(idf, "element", "left").groupBy("id").agg(F.count(F.lit(1)).alias(f"n{s}"), F.sum("tf").alias(f"m{s}"), F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("i", F.lit(1.0)), 2))).alias(f"z{s}"))

    x = a.select(F.col("id").alias("query_id"), "element", F.col("tf").alias("ta"))
    y = b.select(F.col("id").alias("doc_id"), "element", F.col("tf").alias("tb"))
    p = x.join(y, "element").join(idf, "element").filter("query_id <> doc_id").groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("shared"), F.sum(F.least("ta", "tb")).alias("low"), F.sum(F.col("ta") * F.col("tb") * F.col("i") * F.col("i")).alias("dot")
    )
    p = p.filter(F.col("shared") >= least_shared).join(side(a, "a").withColumnRenamed("id", "query_id"), "query_id").join(side(b, "b").withColumnRenamed("id", "doc_id"), "doc_id")
    r = lambda c, name: F.round(c, 6).alias(name)
    return p.select("query_id", "doc_id", "shared", r(F.col("shared") / F.col("na"), "recall"), r(F.col("low") / (F.col("ma") + F.col("mb") - F.col("low")), "soft_jaccard"), r(F.col("low") / F.sqrt(F.col("ma") * F.col("mb")), "freq_coupling"), r(F.col("dot") / (F.col("za") * F.col("zb")), "freq_idf_cosine"))


def position_weighted(a: DataFrame, b: DataFrame, decay: float = 0.7) -> DataFrame:
    """Run of ordered sets (id, element, pos from 0): an element weighs (1 + pos)^-decay; geometric means of shared weights over both norms."""
    w = F.pow(1.0 + F.col("pos"), F.lit(-decay))
    norm = lambda df, key: df.groupBy(F.col("id").alias(key)).agg(F.sqrt(F.sum(w * w)).alias(f"norm_{key}"))
    x, y = a.select(F.col("id").alias("query_id"), "element", w.alias("wa")), b.select(F.col("id").alias("doc_id"), "element", w.alias("wb"))
    s = x.join(y, "element").filter("query_id <> doc_id").groupBy("query_id", "doc_id").agg(F.sum(F.sqrt(F.col("wa") * F.col("wb"))).alias("s"))
    both = s.join(norm(a, "query_id"), "query_id").join(norm(b, "doc_id"), "doc_id")
    return both.select("query_id", "doc_id", F.round(F.col("s") / (F.col("norm_query_id") * F.col("norm_doc_id")), 6).alias("score"))


def diffuse(run: DataFrame, edges: DataFrame, alpha: float = 0.15) -> DataFrame:
    """(1 - alpha) S0 + alpha T S0, T the row-normalised weights of ``edges(src, dst, weight)`` without loops."""
    e = edges.filter("src <> dst")
    t = e.join(e.groupBy("src").agg(F.sum("weight").alias("z")).filter("z > 0"), "src").select("src", "dst", (F.col("weight") / F.col("z")).alias("t"))
    moved = t.join(run.withColumnRenamed("doc_id", "dst"), "dst").select("query_id", F.col("src").alias("doc_id"), (F.col("t") * F.col("score") * alpha).alias("s"))
    both = run.select("query_id", "doc_id", (F.col("score") * (1 - alpha)).alias("s")).unionByName(moved)
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


#: Queries whose scores travel side by side in one row.
_SIDE_BY_SIDE = 32


def diffuse_shared(run: DataFrame, held: DataFrame, alpha: float = 0.15) -> DataFrame:
    """``diffuse`` over the edges of documents that share elements of ``held(doc_id, element)``, without repeats, weighted by how many; no edge is listed.

    An element sums the scores of its holders, a document those sums of its elements, less its own part. ``run`` holds a
    stated query set.
    """
    ids = [r.query_id for r in run.select("query_id").distinct().orderBy("query_id").collect()]  # the stated query set
    kind = dict(run.dtypes)["query_id"]
    here = held.filter("doc_id IS NOT NULL AND element IS NOT NULL")
    out = None
    for at in range(0, len(ids), _SIDE_BY_SIDE):
        some = ids[at : at + _SIDE_BY_SIDE]
        own = written(run.groupBy("doc_id").agg(*(F.sum(F.when(F.col("query_id").eqNullSafe(F.lit(q)), F.col("score"))).alias(f"s{i}") for i, q in enumerate(some))))
        each = range(len(some))
        at_element = here.join(own, "doc_id", "left").groupBy("element").agg(F.count(F.lit(1)).alias("holders"), *(F.sum(f"s{i}").alias(f"t{i}") for i in each), *(F.count(f"s{i}").alias(f"n{i}") for i in each))
        summed = here.join(at_element, "element").groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"), F.sum("holders").alias("holders"), *(F.sum(f"t{i}").alias(f"t{i}") for i in each), *(F.sum(f"n{i}").alias(f"n{i}") for i in each))
        both = own.join(summed, "doc_id", "full")
        z = F.col("holders") - F.col("size")
        rows = []
        for i, q in enumerate(some):
            mine = F.coalesce(f"s{i}", F.lit(0.0))
            near = F.coalesce(F.col(f"n{i}") - F.when(F.col(f"s{i}").isNotNull(), F.col("size")).otherwise(0), F.lit(0)) > 0
            moved = F.when(near, F.try_divide(alpha * (F.col(f"t{i}") - F.col("size") * mine), z)).otherwise(0.0)
            rows.append(F.struct(F.lit(q).cast(kind).alias("query_id"), F.round(mine * (1 - alpha) + moved, 6).alias("score"), (near | F.col(f"s{i}").isNotNull()).alias("found")))
        part = both.select("doc_id", F.inline(F.array(*rows))).filter("found").select("query_id", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return run.select("query_id", "doc_id", "score") if out is None else out


def classes(sets_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets (id, element) without repeats as classes of equal sets: (class, elements) and membership (id, class).

    A class is named by its elements, sorted, one set of them at a time.
    """
    own = sets_.groupBy("id").agg(F.array_sort(F.collect_list("element")).alias("elements"))  # bounded by one set
    seen = written(own.groupBy("elements").agg(F.min("id").alias("class")))
    return seen.select("class", "elements"), written(own.join(seen, "elements").select("id", "class"))


def class_pairs(known: DataFrame) -> DataFrame:
    """(class_a, class_b, na, nb, common) of classes with a common element, each pair both ways and a class with itself."""
    each = known.select("class", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    a, b = each.toDF("class_a", "na", "element"), each.toDF("class_b", "nb", "element")
    p = a.join(b, "element").filter("class_a <= class_b").groupBy("class_a", "class_b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.collect_list("element").alias("common"))  # bounded by one set
    turned = p.filter("class_a < class_b").select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), F.col("nb").alias("na"), F.col("na").alias("nb"), "common")
    return p.unionByName(turned)


def sharing_two(sets_: DataFrame) -> DataFrame:
    """(a, b, shared, dot, na, nb, za, zb) of ids a < b of sets (id, element) with two common elements or more; repeats count once.

    Ids meet by pairs of elements, so those that share one element alone are never joined: m common elements are
    m (m - 1) / 2 common pairs, and each element is in m - 1 of them. A set is as many rows as it has pairs of elements. ``dot`` and
    ``z`` sum squared weights, ln((N + 1) / (df + 1)) + 1 over the N sets; ``n`` counts a set's elements.
    """
    c = sets_.select("id", "element").distinct()
    n = F.broadcast(c.select("id").distinct().agg(F.count(F.lit(1)).alias("n_sets")))  # one row
    weight = c.groupBy("element").agg(F.count(F.lit(1)).alias("df")).crossJoin(n).select("element", F.pow(F.log((F.col("n_sets") + 1) / (F.col("df") + 1)) + 1, 2).alias("w"))  # one row
    known = written(c.join(weight, "element", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("element").isNotNull(), F.struct("element", "w")))).alias("x"), F.count(F.lit(1)).alias("n"), F.sqrt(F.sum("w")).alias("z")))  # bounded by one set
    two = F.flatten(F.transform("x", lambda p, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda q: F.struct(p["element"].alias("e1"), q["element"].alias("e2"), (p["w"] + q["w"]).alias("w")))))
    each = known.filter(F.size("x") > 1).select("id", F.inline(two))
    a, b = each.toDF("a", "e1", "e2", "w"), each.drop("w").toDF("b", "e1", "e2")
    met = a.join(b, ["e1", "e2"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs"), F.sum("w").alias("w"))
    met = met.withColumn("shared", F.round((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2).cast("long"))
    side = lambda s: known.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("z").alias(f"z{s}"))
    return met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shared", (F.col("w") / (F.col("shared") - 1)).alias("dot"), "na", "nb", "za", "zb")


def degrees(sets_: DataFrame) -> DataFrame:
    """(id, degree): with how many other ids of sets (id, element) an id shares an element; ids that share none are absent, repeats count once.

    An element's holders are counted, not listed: the holders of an id's elements, less itself, count an id that shares m of them
    m times. Only ids that share two or more are met, by pairs of elements (see ``sharing_two``), and taken off m - 1 times.
    """
    known = written(sets_.filter("id IS NOT NULL AND element IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("element")).alias("x")))  # bounded by one set
    each = known.select("id", F.explode("x").alias("element"))
    others = each.join(each.groupBy("element").agg((F.count(F.lit(1)) - 1).alias("n")), "element").select("id", "n")
    two = F.flatten(F.transform("x", lambda p, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda q: F.struct(p.alias("e1"), q.alias("e2")))))
    pairs = known.filter(F.size("x") > 1).select("id", F.inline(two))
    a, b = pairs.toDF("a", "e1", "e2"), pairs.toDF("b", "e1", "e2")
    met = a.join(b, ["e1", "e2"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs"))
    again = (-F.round((F.sqrt(1 + 8 * F.col("pairs")) - 1) / 2)).cast("long").alias("n")
    off = met.select(F.explode(F.array("a", "b")).alias("id"), again)
    return others.unionByName(off).groupBy("id").agg(F.sum("n").alias("degree")).filter("degree > 0")


def members(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Pairs of classes (class_a, class_b, ...) as pairs of ids a < b: as many rows as come out, and twice, as ids meet in order."""
    a, b = membership.toDF("a", "class_a"), membership.toDF("b", "class_b")
    return pairs.join(a, "class_a").join(b, "class_b").filter("a < b").drop("class_a", "class_b")


def _common(a: np.ndarray, a_of: np.ndarray, na: int, b: np.ndarray, b_of: np.ndarray, nb: int, kinds: int) -> np.ndarray:
    """How many elements, numbers below ``kinds``, each of ``na`` sets has in common with each of ``nb`` sets: as a product of matrices or element by element, what costs less."""
    fa, fb = np.bincount(a, minlength=kinds), np.bincount(b, minlength=kinds)
    kept = np.flatnonzero(fa * fb)
    met = int((fa * fb).sum())
    if met * 100 < len(kept) * na * nb:
        order = np.argsort(b, kind="stable")
        begin = (np.cumsum(fb) - fb)[a]
        until, done, counts = np.cumsum(fb[a]), 0, np.zeros(na * nb, np.float32)
        while done < len(a):  # about a million pairs at a time
            upto = max(done + 1, int(np.searchsorted(until, (until[done - 1] if done else 0) + 1_000_000, "right")))
            m = fb[a[done:upto]]
            place = np.arange(m.sum()) + np.repeat(begin[done:upto] - np.cumsum(m) + m, m)
            np.add.at(counts, np.repeat(a_of[done:upto], m) * nb + b_of[order[place]], 1)
            done = upto
        return counts.reshape(na, nb)
    counts, number = np.zeros((na, nb), np.float32), np.full(kinds, -1)
    number[kept] = np.arange(len(kept))

    def rows(x: np.ndarray, of: np.ndarray, n: int, at: int, width: int) -> np.ndarray:
        here = (number[x] >= at) & (number[x] < at + width)
        out = np.zeros((n, width), np.float32)
        out[of[here], number[x[here]] - at] = 1
        return out

    for at in range(0, len(kept), 1024):
        width = min(1024, len(kept) - at)
        counts += rows(a, a_of, na, at, width) @ rows(b, b_of, nb, at, width).T
    return counts


def set_jaccard(mentions: DataFrame) -> DataFrame:
    """(a, b, jaccard) of ids a < b of ``mentions(id, element)`` with a common element.

    Blocks of sets meet (``dense.met``) and count what their sets have in common: no row of a pair and element is listed, memory is bounded by two blocks.
    """
    own = written(mentions.filter("id IS NOT NULL AND element IS NOT NULL").groupBy("id").agg(F.collect_set("element").alias("e")))  # bounded by one set
    kind = dict(own.dtypes)["id"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [(dense.none(), dense.none(), np.zeros(0))]
        if a.num_rows and b.num_rows:
            lists = [t.column("e").combine_chunks() for t in (a, b)]
            code = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
            codes, kinds = code.indices.to_numpy(), len(code.dictionary)
            (x, x_of), (y, y_of) = ((c, pc.list_parent_indices(t).to_numpy()) for c, t in zip(np.split(codes, [len(lists[0].flatten())]), lists))
            nx, ny = np.bincount(x_of, minlength=a.num_rows), np.bincount(y_of, minlength=b.num_rows)
            ia, ib = a.column("a").to_numpy(), b.column("b").to_numpy()
            for at in range(0, a.num_rows, 512):  # some sets at a time
                n = min(512, a.num_rows - at)
                begin, end = np.searchsorted(x_of, [at, at + n])
                shared = _common(x[begin:end], x_of[begin:end] - at, n, y, y_of, b.num_rows, kinds)
                i, k = np.nonzero((shared > 0) & (ia[at : at + n, None] < ib[None, :]))
                c = shared[i, k].astype(float)
                found.append((i + at, k, dense.round6(c / (nx[i + at] + ny[k] - c))))
        i, k, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": a.column("a").take(pa.array(i, pa.int64())), "b": b.column("b").take(pa.array(k, pa.int64())), "jaccard": score})

    return dense.met(own.select(F.col("id").alias("a"), "e"), own.select(F.col("id").alias("b"), "e"), "a", "b", meet, f"a {kind}, b {kind}, jaccard double", (2048, 2048))


def label_edges(labels: DataFrame, min_shared: int = 1) -> DataFrame:
    """(source_case_id, target_case_id, shared_count, shared_labels) of (case_id, label), source < target; blank labels dropped.

    Cases with equal labels are one class: classes are compared, and those that share enough are told as pairs of cases.
    """
    known, membership = classes(labels.select(F.col("case_id").alias("id"), F.trim("label").alias("element")).filter("id IS NOT NULL AND element <> ''").distinct())
    p = class_pairs(known).select("class_a", "class_b", F.size("common").cast("long").alias("shared_count"), F.array_join(F.array_sort("common"), "|").alias("shared_labels")).filter(F.col("shared_count") >= min_shared)
    return members(written(p), membership).select(F.col("a").alias("source_case_id"), F.col("b").alias("target_case_id"), "shared_count", "shared_labels")


def _tasks(df: DataFrame) -> int:
    """Partitions that bound the rows of a task."""
    return max(8 * df.sparkSession.sparkContext.defaultParallelism, df.count() // 250_000)


def co_cite_counts(mentions: DataFrame) -> DataFrame:
    """(id, a, b, n): how many different mentions (id, a, b, ...) have the pair; repeated rows count once. All rows of a pair move once."""
    return mentions.repartition(_tasks(mentions), "id", "a", "b").distinct().groupBy("id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


#: Ids of a block, at most: the sums of a pair of blocks take 8 bytes times its square.
_BLOCK = 2048


def _block_dots(size: int, kinds: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of n times n for each two ids of a pair of blocks (i, j), of rows (i, j, a, b, at, n, id, z) in that order; ``at`` counts on from ``size`` in block j."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, ids, z = np.zeros(size * size, np.int64), None, np.zeros(2 * size)
        known, block, rest = np.zeros(2 * size, bool), None, None

        def add(t: pa.Table, starts: np.ndarray) -> None:
            nonlocal ids
            at, n, rows = t["at"].to_numpy(), t["n"].to_numpy(), np.arange(t.num_rows)
            if not known[at].all():
                places, first = np.unique(at, return_index=True)
                names = t["id"].take(pa.array(first)).to_numpy()
                ids = np.empty(2 * size, names.dtype) if ids is None else ids
                ids[places], z[places], known[places] = names, t["z"].to_numpy()[first], True
            ends = np.r_[starts[1:], len(at)]
            each, first = ends - starts, rows + 1
            if block[0] != block[1]:  # the rows of block i meet those of block j, which come behind them
                first = np.where(at < size, np.repeat(starts + np.add.reduceat((at < size).astype(np.int64), starts), each), np.repeat(ends, each))
            met = np.repeat(ends, each) - first
            until, done = np.cumsum(met), 0
            while done < len(at):  # about a million products at a time
                upto = max(done + 1, int(np.searchsorted(until, (until[done - 1] if done else 0) + 1_000_000, "right")))
                m = met[done:upto]
                x = np.repeat(rows[done:upto], m)
                y = np.arange(len(x)) + np.repeat(first[done:upto] - np.cumsum(m) + m, m)
                np.add.at(sums, at[x] * size + at[y] % size, n[x] * n[y])
                done = upto

        def found() -> Iterator[pa.RecordBatch]:
            cells = np.flatnonzero(sums)
            for begin in range(0, len(cells), 250_000):
                c = cells[begin : begin + 250_000]
                x, y = c // size, c % size + (0 if block[0] == block[1] else size)
                yield pa.RecordBatch.from_pydict({"x": pa.array(ids[x], kinds), "y": pa.array(ids[y], kinds), "dot": sums[c], "zx": z[x], "zy": z[y]})
            sums.fill(0)
            known.fill(False)

        for batch in itertools.chain(batches, [None]):
            parts = ([] if rest is None else [rest]) + ([] if batch is None else [pa.Table.from_batches([batch])])
            if not sum(x.num_rows for x in parts):
                continue
            t = pa.concat_tables(parts).combine_chunks()
            other = lambda *names: np.r_[True, np.any([pc.not_equal(t[c].slice(1), t[c].slice(0, t.num_rows - 1)).to_numpy() for c in names], axis=0)]
            blocks = other("i", "j")
            elements = np.flatnonzero(blocks | other("a", "b"))
            end = t.num_rows if batch is None else elements[-1]  # the last element may go on in the next batch
            rest = t.slice(end)
            for begin, stop in itertools.pairwise(np.r_[np.flatnonzero(blocks[:end]), end]):
                at = (t["i"][begin].as_py(), t["j"][begin].as_py())
                if at != block:
                    yield from found()
                    block = at
                add(t.slice(begin, stop - begin), elements[(elements >= begin) & (elements < stop)] - begin)
        yield from found()

    return meet


def co_cite_cosine(pairs: DataFrame) -> DataFrame:
    """Run (query_id, doc_id, score) of counted pairs (id, a, b, n): cosine of the vectors of co-cited pairs; documents with a common pair only.

    Ids in order are dealt into blocks. The holders of a pair (a, b) go to each two blocks that hold it, where their products are summed in a
    matrix: no joined row is listed, a task's memory is bounded by its blocks, and a pair that many ids hold is dealt over all pairs of
    blocks. Counts are above 0.
    """
    p = written(pairs.select("id", "a", "b", F.col("n").cast("long").alias("n")).filter("id IS NOT NULL"))
    norms = written(p.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("z")))
    cores, n, tasks = p.sparkSession.sparkContext.defaultParallelism, norms.count(), _tasks(p)
    ids = written(norms.repartitionByRange(1 + n // 1_000_000, "id").sortWithinPartitions("id").withColumn("m", F.monotonically_increasing_id()))
    forget(norms)
    size = max(1, min(_BLOCK, -(-n // math.ceil(math.sqrt(2 * cores)))))  # small tables too give each core a pair of blocks
    held = p.filter("a IS NOT NULL AND b IS NOT NULL").join(ids.withColumn("block", F.expr(f"m div {size}")), "id").repartition(tasks, "a", "b")
    of_pair = Window.partitionBy("a", "b")
    held = held.withColumns({"blocks": F.collect_set("block").over(of_pair), "holders": F.count(F.lit(1)).over(of_pair)}).filter("holders > 1")
    dealt = held.withColumn("other", F.explode("blocks")).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    at = F.col("m") % size + F.when(F.col("block") > F.col("i"), size).otherwise(0)
    dealt = dealt.select("i", "j", "a", "b", at.alias("at"), "n", "id", "z").repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "a", "b", "at")
    kind = dict(p.dtypes)["id"]
    dots = dealt.mapInArrow(_block_dots(size, to_arrow_type(p.schema["id"].dataType)), f"x {kind}, y {kind}, dot long, zx double, zy double")
    score = F.round(F.col("dot") / (F.col("zx") * F.col("zy")), 6).alias("score")
    each = lambda q, d: F.struct(F.col(q).alias("query_id"), F.col(d).alias("doc_id"), "score")
    return dots.select("x", "y", score).select(F.inline(F.array(each("x", "y"), each("y", "x"))))


def typed_triplets(triplets: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, type1, entity1, relation, type2, entity2), distinct, of ``triplets(case_id, entity1, relation, entity2)`` and ``entities(case_id, name, type)``.

    Where one side is an entity, the other side's type is that of each of its words that is one, or None; the first side
    goes first. Triplets without an entity keep both types None.
    """
    t = triplets.withColumns({"entity1": F.trim("entity1"), "entity2": F.trim("entity2")})
    known = lambda n, kind: entities.select("case_id", F.col("name").alias(n), F.col("type").alias(kind)).dropDuplicates(["case_id", n])
    t = t.join(known("entity1", "k1"), ["case_id", "entity1"], "left").join(known("entity2", "k2"), ["case_id", "entity2"], "left")
    first = F.col("k1").isNotNull()
    words = t.withColumn("word", F.explode(F.split(F.when(first, F.col("entity2")).otherwise(F.col("entity1")), " "))).filter(first | F.col("k2").isNotNull())
    words = words.join(known("word", "kw"), ["case_id", "word"], "left")
    keys = ["case_id", "entity1", "relation", "entity2", "k1", "k2"]
    hits = words.groupBy(*keys).agg(F.collect_set("kw").alias("kinds"))  # bounded by one entity's words
    hits = hits.select(*keys, F.explode(F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(F.array(F.lit("None")))).alias("kw"))
    none = t.filter("k1 IS NULL AND k2 IS NULL").select(*keys, F.lit("None").alias("kw"))
    one = F.when(first, F.col("k1")).otherwise(F.col("kw"))
    two = F.when(first, F.col("kw")).otherwise(F.coalesce("k2", F.lit("None")))
    return hits.unionByName(none).select("case_id", one.alias("type1"), "entity1", "relation", two.alias("type2"), "entity2").distinct()


#: Positions of a case that are numbered together; a case of any length is numbered by many tasks.
_SPAN = 10_000


def entity_graph(triplets: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs of cases: nodes (case_id, node, name) and directed edges (case_id, seq, src, dst, label).

    ``triplets(case_id, pos, entity1, relation, entity2)``; a triplet that repeats counts where it is first. Every case has
    the virtual node 0 (null name) with two loops; entities are numbered from 1 as they are first seen. A triplet gives six edges: both
    ways between its entities (labelled with the relation) and both ways between the virtual node and each entity (with the entity).
    Triplets with a null entity are left out; repeated ``cases(case_id)`` count once.
    """
    keys = ["case_id", "entity1", "relation", "entity2"]
    t = triplets.filter("entity1 IS NOT NULL AND entity2 IS NOT NULL").groupBy(*keys).agg(F.min("pos").alias("pos"))
    each = F.array(F.struct((F.col("pos") * 2).alias("at"), F.col("entity1").alias("name")), F.struct((F.col("pos") * 2 + 1).alias("at"), F.col("entity2").alias("name")))
    seen = t.select("case_id", F.inline(each)).groupBy("case_id", "name").agg(F.min("at").alias("at")).withColumn("span", F.floor(F.col("at") / _SPAN))
    per = seen.groupBy("case_id", "span").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("case_id", "span", (F.sum("n").over(Window.partitionBy("case_id").orderBy("span")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("case_id", "span").orderBy("at", "name"))
    nodes = seen.withColumn("own", own).join(before, ["case_id", "span"]).select("case_id", (F.col("own") + F.col("before")).alias("node"), "name")
    all_cases = cases.select("case_id").distinct()
    a, b = nodes.toDF("case_id", "e1", "entity1"), nodes.toDF("case_id", "e2", "entity2")
    both = t.join(a, ["case_id", "entity1"]).join(b, ["case_id", "entity2"])
    zero = F.lit(0).cast("long")
    six = [("e1", "e2", "relation"), ("e2", "e1", "relation"), (None, "e1", "entity1"), ("e1", None, "entity1"), (None, "e2", "entity2"), ("e2", None, "entity2")]
    rows = F.array(*(F.struct((F.col("pos") * 6 + n).cast("long").alias("seq"), (F.col(x) if x else zero).alias("src"), (F.col(y) if y else zero).alias("dst"), F.col(z).alias("label")) for n, (x, y, z) in enumerate(six)))
    loops = F.array(*(F.struct(F.lit(n).cast("long").alias("seq"), zero.alias("src"), zero.alias("dst"), F.lit(None).cast("string").alias("label")) for n in (-2, -1)))
    edges = both.select("case_id", F.inline(rows)).unionByName(all_cases.select("case_id", F.inline(loops)))
    return all_cases.select("case_id", zero.alias("node"), F.lit(None).cast("string").alias("name")).unionByName(nodes), edges


def set_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, doc_id, overlap, jaccard, coupling, idf_cosine) of sets ``a(query_id, element)``, a bounded query set, and ``b(doc_id, element)``.

    Only pairs with a common element; all four scores of other pairs are 0. The weight of an element is ln((N + 1) / (df + 1)) + 1
    over the N documents of ``b``, 1 where ``b`` lacks it. Repeated and null elements count once and not at all.
    """
    x = a.filter("element IS NOT NULL").select("query_id", "element").distinct()
    y = b.filter("element IS NOT NULL").select("doc_id", "element").distinct()
    n = b.agg(F.count_distinct("doc_id").alias("n"))
    weight = y.groupBy("element").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("element", F.pow(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 2).alias("w"))  # one row
    sizes = lambda df, key, s: df.join(weight, "element", "left").groupBy(key).agg(F.count(F.lit(1)).alias(f"n{s}"), F.sum(F.coalesce("w", F.lit(1.0))).alias(f"z{s}"))
    p = x.join(weight, "element").join(y, "element").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("overlap"), F.sum("w").alias("dot"))
    p = p.join(sizes(x, "query_id", "a"), "query_id").join(sizes(y, "doc_id", "b"), "doc_id")
    r = lambda c, name: F.round(c, 6).alias(name)
    return p.select("query_id", "doc_id", "overlap", r(F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap")), "jaccard"), r(F.col("overlap") / F.sqrt(F.col("na") * F.col("nb")), "coupling"), r(F.col("dot") / F.sqrt(F.col("za") * F.col("zb")), "idf_cosine"))
