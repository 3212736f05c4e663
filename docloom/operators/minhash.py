"""MinHash signatures of word or character shingles, as an array expression or a table's at once, and the pairs that they or the shingles tell."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import let
from docloom.operators import dense, overlap
from docloom.sources.tables import written

#: Fixed value: the modulus of the hash family.
PRIME = (1 << 31) - 1


def family(n: int = 128, seed: int = 42) -> list[tuple[int, int]]:
    """The (a, b) of n hashes a x + b mod PRIME."""
    r = np.random.RandomState(seed)
    a = r.randint(1, PRIME, size=n, dtype=np.int64)
    return list(zip(a.tolist(), r.randint(0, PRIME, size=n, dtype=np.int64).tolist()))


def shingles(text: Column, size: int, kind: str = "word") -> Column:
    """Distinct shingles of the lower-cased text without citation tags; none for a shorter text."""
    bare = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\[?\?CITATION\?\]?|<CITATION_[0-9]+>", " ")), r"\s+", " "))
    none = F.array().cast("array<string>")
    starts = lambda n: F.sequence(F.lit(1), n - (size - 1))
    if kind == "char":
        return let(bare, lambda t: F.when(F.length(t) >= size, F.array_distinct(F.transform(starts(F.length(t)), lambda i: F.substring(t, i, size)))).otherwise(none))
    words = F.filter(F.split(bare, " "), lambda x: x != "")
    return let(words, lambda w: F.when(F.size(w) >= size, F.array_distinct(F.transform(starts(F.size(w)), lambda i: F.array_join(F.slice(w, i, size), " ")))).otherwise(none))


def _hash(shingle: Column) -> Column:
    """MD5 as a number modulo PRIME, folded from the left over four to seven hexadecimal digits at a time."""
    digit = lambda m, at, n: F.conv(F.substring(m, at, n), 16, 10).cast("long")

    def fold(m: Column) -> Column:
        h = F.lit(0).cast("long")
        for at in range(1, 29, 7):
            h = (h * (1 << 28) + digit(m, at, 7)) % PRIME
        return (h * (1 << 16) + digit(m, 29, 4)) % PRIME

    return fold(F.md5(shingle.cast("binary")))


def signature(shingles_: Column, hashes: list[tuple[int, int]]) -> Column:
    """Array of minima; PRIME throughout for an empty set."""
    pairs = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in hashes))
    return let(F.transform(shingles_, _hash), lambda hs: F.transform(pairs, lambda p: F.coalesce(F.array_min(F.transform(hs, lambda h: (p["a"] * h + p["b"]) % PRIME)), F.lit(PRIME).cast("long"))))


def signatures(docs: DataFrame, id_col: str, hashes: list[tuple[int, int]]) -> DataFrame:
    """(id_col, sig) of ``docs(id_col, sh)``: ``signature`` of each row's shingles, a few thousand of them at a time."""
    a, b = (np.array(x, np.uint64)[:, None] for x in zip(*hashes))
    prime = np.uint64(PRIME)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, len(hashes)), PRIME, np.int32)
            for row, shingles_ in enumerate(batch.column(1)):
                words = np.frombuffer(b"".join(md5(x.encode(), usedforsecurity=False).digest() for x in shingles_.as_py() or ()), ">u4").reshape(-1, 4).astype(np.uint64)
                hs = (words @ np.array([8, 4, 2, 1], np.uint64)) % prime  # 2^32 is 2 modulo PRIME
                for at in range(0, len(hs), 2048):
                    x = a * hs[at : at + 2048] + b
                    for _ in range(2):  # 2^31 is 1
                        x = (x & prime) + (x >> np.uint64(31))
                    x = np.minimum(x, x - prime)  # a difference below zero wraps around
                    out[row] = np.minimum(out[row], x.min(axis=1).astype(np.int32))
            sig = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(hashes), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sig], [id_col, "sig"])

    return docs.select(id_col, "sh").mapInArrow(sign, f"{id_col} {dict(docs.dtypes)[id_col]}, sig array<int>")


def estimates(queries: DataFrame, docs: DataFrame, least: float = 0.0) -> DataFrame:
    """Run of a stated query set (query_id, sig) against all (doc_id, sig): the share of equal places; pairs below ``least`` are absent.

    Blocks of both sides meet (``dense.met``). Only equal places are visited: a place's values are sorted in one block and looked up from
    the other; a few hundred queries are counted at a time.
    """
    if least <= 0:
        same = F.size(F.filter(F.zip_with("qs", "sig", lambda a, b: a == b), lambda x: x))
        pairs = docs.crossJoin(queries.select("query_id", F.col("sig").alias("qs"))).filter("query_id <> doc_id")  # every pair comes back
        return pairs.select("query_id", "doc_id", F.round(same / F.size("sig"), 6).alias("score"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return dense.run_of(a, b, dense.none(), dense.none(), np.zeros(0))
        q, d = (_lists(t, "sig").reshape(t.num_rows, -1).T.copy() for t in (a, b))
        orders = [np.argsort(x, kind="stable") for x in d]
        values = [x[o] for x, o in zip(d, orders, strict=True)]
        found = []
        for at in range(0, a.num_rows, 256):
            n = min(256, a.num_rows - at)
            counts = np.zeros(n * b.num_rows, np.int32)
            for x, order, value in zip(q, orders, values, strict=True):
                own, held = _ranges(x[at : at + n], value)
                counts[own * b.num_rows + order[held]] += 1  # a place has a pair once
            at_least = np.flatnonzero(dense.round6(np.arange(len(q) + 1) / len(q)) >= least)[:1]
            cell = np.flatnonzero(counts >= at_least[0]) if len(at_least) else dense.none()
            found.append((cell // b.num_rows + at, cell % b.num_rows, counts[cell]))
        return _other(a, b, found, lambda qi, di, c: c / len(q))

    return dense.met(queries.select("query_id", "sig"), docs.select("doc_id", "sig"), "query_id", "doc_id", meet, dense.run_schema(queries, docs), (65536, 32768))


def _lists(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _ranges(asked: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``asked``, in the sorted ``held``) of all pairs of equal values."""
    begin = np.searchsorted(held, asked, "left")
    n = np.searchsorted(held, asked, "right") - begin
    own = np.repeat(np.arange(len(asked)), n)
    return own, np.arange(len(own)) + np.repeat(begin - (np.cumsum(n) - n), n)


def _other(a: pa.Table, b: pa.Table, found: list, score) -> pa.Table:
    """The run of found (place in a, place in b, count) without pairs of one id."""
    qi, di, c = (np.concatenate(x) for x in zip(*found))
    ids = lambda t, n, at: t.column(n).take(pa.array(at, pa.int64())).to_numpy()
    other = ids(a, "query_id", qi) != ids(b, "doc_id", di)
    qi, di, c = qi[other], di[other], c[other]
    return dense.run_of(a, b, qi, di, dense.round6(score(qi, di, c)))


def exact(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Run of Jaccard similarities of (query_id, sh) and (doc_id, sh), of shingles without repeats and unique ids; pairs that share none are absent.

    Only shingles that the other side holds as well move, as hashes (``overlap.met``); blocks of both sides meet and count what each pair
    shares, some queries at a time, so no joined row is listed. Two shingles of one 64-bit hash would count as one.
    """
    hashed = lambda df, key: written(df.select(key, F.size("sh").alias("n"), F.transform("sh", lambda x: F.xxhash64(x)).alias("hs")))
    queries, docs = hashed(queries, "query_id"), hashed(docs, "doc_id")
    side = lambda df, key, name: df.select(F.lit(name).alias("side"), F.col(key).alias("doc_id"), F.lit(0).alias("line"), F.explode("hs").alias("event"))
    shared = written(overlap.met(side(queries, "query_id", overlap.QUERY).unionByName(side(docs, "doc_id", overlap.CANDIDATE))).select("doc_id", "h", "as_query"))

    def held(df: DataFrame, key: str, of: DataFrame) -> DataFrame:
        hashes = of.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("h").alias("hs"))  # bounded by one text
        return hashes.join(df.select(key, "n"), key)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return dense.run_of(a, b, dense.none(), dense.none(), np.zeros(0))
        (q, q_of), (d, d_of) = ((_lists(t, "hs"), pc.list_parent_indices(t.column("hs").combine_chunks()).to_numpy()) for t in (a, b))
        order = np.argsort(d, kind="stable")
        values, d_of = d[order], d_of[order]
        nq, nd = (t.column("n").to_numpy().astype(float) for t in (a, b))
        found = []
        for at in range(0, a.num_rows, 64):
            n = min(64, a.num_rows - at)
            counts = np.zeros(n * b.num_rows, np.int64)
            begin, end = np.searchsorted(q_of, [at, at + n])
            for i in range(begin, end, 4096):
                to = min(i + 4096, end)
                own, place = _ranges(q[i:to], values)
                counts += np.bincount((q_of[i:to][own] - at) * b.num_rows + d_of[place], minlength=len(counts))
            cell = np.flatnonzero(counts)
            found.append((cell // b.num_rows + at, cell % b.num_rows, counts[cell]))
        return _other(a, b, found, lambda qi, di, c: c / (nq[qi] + nd[di] - c))

    return dense.met(held(queries, "query_id", shared.filter("as_query")), held(docs, "doc_id", shared.filter("NOT as_query")), "query_id", "doc_id", meet, dense.run_schema(queries, docs), (4096, 16384))
