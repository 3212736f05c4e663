"""Dense retrieval: cosines of a stated query set against all vectors, block by block as matrix products.

Both sides are dealt into blocks by a hash of their ids; every block of queries meets every block of vectors in one group, so
a group's memory is bounded, pairs of blocks spread over tasks, and no side passes the driver. A group gives the best k
of its vectors for each of its queries, or one score per pair of documents. The matrix product only picks candidates: what
comes back is summed in the order of the dimensions and rounded as SQL does.

Defined results: ids are unique; a row without a vector has no score; vectors have one length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.tables import written

#: Rows of a block of queries and of a block of vectors.
QUERIES, VECTORS = 4096, 32768


def met(queries: DataFrame, vectors: DataFrame, q_id: str, d_id: str, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str, sizes: tuple[int, int] = (QUERIES, VECTORS)) -> DataFrame:
    """``meet`` of each block of ``queries`` with each block of ``vectors``; rows of one id (``q_id``, ``d_id``) share a block."""
    q, d = written(queries), written(vectors)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    bq = max(1, -(-q.count() // sizes[0]))
    bd = max(1, -(-d.count() // sizes[1]), -(-2 * cores // bq))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(bq * bd, max(200, 4 * cores))
    left = q.withColumn("bq", block(q_id, bq)).withColumn("bd", every(bd)).repartition(tasks, "bq", "bd")
    right = d.withColumn("bd", block(d_id, bd)).withColumn("bq", every(bq)).repartition(tasks, "bq", "bd")
    return left.groupBy("bq", "bd").cogroup(right.groupBy("bq", "bd")).applyInArrow(meet, schema)


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name).combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1)


def _dots(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sums of products in the order of the dimensions; ``a`` and ``b`` hold an array a dimension."""
    out = np.zeros(len(a[0]) if a else 0)
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def round6(x: np.ndarray) -> np.ndarray:
    """Six places, halves away from zero, decided on the double."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) / 1e6 + 0.0


def run_of(a: pa.Table, b: pa.Table, qi: np.ndarray, di: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"query_id": a.column("query_id").take(pa.array(qi, pa.int64())), "doc_id": b.column("doc_id").take(pa.array(di, pa.int64())), "score": pa.array(score, pa.float64())})


def run_schema(queries: DataFrame, vectors: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(vectors.dtypes)['doc_id']}, score double"


def none() -> np.ndarray:
    return np.zeros(0, np.int64)


def best(queries: DataFrame, vectors: DataFrame, k: int, own: bool = True, parts: Column | None = None) -> DataFrame:
    """Run that holds the best k of ``vectors(doc_id, v)`` for each of ``queries(query_id, v)`` and more: ``rank.top`` of it is that of all pairs.

    Scores are cosines of ``v``, six places. ``parts``, an array of vectors, stands for ``v``: then scores are the sum of
    the cosines of matching parts, each of six places. ``own`` false leaves out pairs of one id.
    """
    parts = F.array("v") if parts is None else parts
    split = lambda df, key: df.select(key, parts.alias("p")).filter(F.col("p").isNotNull() & ~F.exists("p", F.isnull))
    schema = run_schema(queries, vectors)
    queries, vectors = split(queries, "query_id"), split(vectors, "doc_id")

    def sides(t: pa.Table) -> list[np.ndarray]:
        """A matrix for each part."""
        c = t.column("p").combine_chunks()
        n = len(c[0])
        each = c.flatten()
        return [_matrix(pa.table({"v": each.take(pa.array(np.arange(i, len(each), n)))}), "v") for i in range(n)]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return run_of(a, b, none(), none(), np.zeros(0))
        b = b.take(pc.sort_indices(b, [("doc_id", "ascending")]))
        q, d = sides(a), sides(b)
        qt, dt = [list(x.T.copy()) for x in q], [list(x.T.copy()) for x in d]
        nq, nd = [np.sqrt(_dots(x, x)) for x in qt], [np.sqrt(_dots(x, x)) for x in dt]
        self_at = pc.fill_null(pc.index_in(a.column("query_id").cast(b.column("doc_id").type), value_set=b.column("doc_id").combine_chunks()), -1).to_numpy().astype(np.int64)
        slack = 1e-6 * len(q) / 2  # what rounding the parts may add
        top_s, top_i = np.full((a.num_rows, k), -np.inf), np.full((a.num_rows, k), -1, np.int64)

        def exact(qi: np.ndarray, di: np.ndarray) -> np.ndarray:
            total = np.zeros(len(qi))
            for x, y, nx, ny in zip(qt, dt, nq, nd, strict=True):
                dot = np.zeros(len(qi))
                for u, v in zip(x, y, strict=True):
                    dot += u[qi] * v[di]
                total += round6(dot / (nx[qi] * ny[di] + 1e-10))
            return round6(total)

        for at in range(0, a.num_rows, 1024):
            rows = slice(at, at + 1024)
            for begin in range(0, b.num_rows, 2048):
                cols = slice(begin, begin + 2048)
                s = sum((x[rows] @ y[cols].T) / (np.outer(nx[rows], ny[cols]) + 1e-10) for x, y, nx, ny in zip(q, d, nq, nd, strict=True))
                least = top_s[rows, -1] + 1e-6 - slack - 1e-9  # vectors come by id: a later one has to score more
                if not begin and s.shape[1] > k + 1:
                    least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - 2 * slack - 1e-9
                qi, di = np.nonzero(~(s < least[:, None]))
                qi, di = qi + at, di + begin
                if not own:
                    other = self_at[qi] != di
                    qi, di = qi[other], di[other]
                if not len(qi):
                    continue
                u = np.unique(qi)
                kept = top_i[u] >= 0
                all_q = np.concatenate([qi, np.repeat(u, k)[kept.ravel()]])
                all_s, all_i = np.concatenate([exact(qi, di), top_s[u][kept]]), np.concatenate([di, top_i[u][kept]])
                order = np.lexsort((all_i, -np.where(np.isnan(all_s), np.inf, all_s), all_q))
                all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
                place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
                in_ = place < k
                top_s[u], top_i[u] = -np.inf, -1
                top_s[all_q[in_], place[in_]], top_i[all_q[in_], place[in_]] = all_s[in_], all_i[in_]
        qi, at = np.nonzero(top_i >= 0)
        return run_of(a, b, qi, top_i[qi, at], top_s[qi, at])

    return met(queries, vectors, "query_id", "doc_id", meet, schema)


def chunked(queries: DataFrame, docs: DataFrame, how: str = "max", n: int = 3) -> DataFrame:
    """Run of every pair of ``queries(query_id, chunk, v)`` and ``docs(doc_id, chunk, v)``, from the cosines of their chunks (see ``rank.chunk_scores``).

    All chunks of a document lie in one block, so no pair of chunks leaves its group.
    """

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return run_of(a, b, none(), none(), np.zeros(0))
        a, b = (t.take(pc.sort_indices(t, [(key, "ascending"), ("chunk", "ascending")])) for t, key in ((a, "query_id"), (b, "doc_id")))
        starts = lambda t, key: np.flatnonzero(np.r_[True, np.asarray(pc.not_equal(t.column(key).slice(1), t.column(key).slice(0, t.num_rows - 1))).astype(bool)])
        q_at, d_at = starts(a, "query_id"), starts(b, "doc_id")
        q, d = _matrix(a, "v"), _matrix(b, "v")
        nq, nd = (np.sqrt(_dots(list(x.T), list(x.T))) for x in (q, d))
        width, ends, out = np.diff(np.r_[d_at, b.num_rows]), np.r_[q_at, a.num_rows], []
        first = 0
        while first < len(q_at):  # some queries at a time, one at least
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + 256, "right")) - 1)
            rows, cut = slice(ends[first], ends[last]), q_at[first:last] - ends[first]
            s = round6((q[rows] @ d.T) / (np.outer(nq[rows], nd) + 1e-10))
            if how == "sum":
                by_chunk = np.maximum.reduceat(s, cut, axis=0)
                total, nth = np.zeros((len(cut), len(d_at))), np.arange(len(cut))[:, None]
                for _ in range(n):  # the largest left, which then leaves
                    m = np.maximum.reduceat(by_chunk, d_at, axis=1)
                    total += np.where(np.isneginf(m), 0.0, m)
                    held = np.where(by_chunk == np.repeat(m, width, axis=1), np.arange(b.num_rows), b.num_rows - 1)
                    by_chunk[nth, np.minimum.reduceat(held, d_at, axis=1)] = -np.inf
                out.append(total)
            else:
                m = np.maximum.reduceat(s, d_at, axis=1)
                out.append(np.maximum.reduceat(m, cut, axis=0) if how == "max" else np.add.reduceat(m, cut, axis=0) / np.diff(np.r_[cut, len(s)])[:, None])
            first = last
        score = round6(np.vstack(out))
        return run_of(a, b, np.repeat(q_at, len(d_at)), np.tile(d_at, len(q_at)), score.ravel())

    known = lambda df: df.filter("v IS NOT NULL")
    return met(known(queries), known(docs), "query_id", "doc_id", meet, run_schema(queries, docs), (2048, 16384))
