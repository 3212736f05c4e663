"""Ranked lexical search by MaxScore over index shards.

``build_index`` turns the documents into shards, each a row of a written table: the shard's terms, their postings
(document number in the shard, occurrences) and the documents' ids and lengths. A task closes a shard when it holds
``SHARD_TERMS`` terms, so a shard's memory is bounded by that and one document. Nothing is shuffled.

``search`` answers queries in blocks of bounded size (``BLOCK_BYTES`` of their texts), each block against all shards.
Document counts of the block's terms are summed first and give the terms' weights. Then every task goes through its
shards with MaxScore: a query's terms are sorted by the most that each can add in the shard. As long as the terms up
to some place add less together than the score to beat, they are non-essential: documents are found by the postings
of the other, essential terms alone, and non-essential postings are probed, dearest first, only for documents that
can still qualify. The score to beat rises from one range of documents to the next and from shard to shard. A task
emits its best ``k`` documents a query; those are ranked in two steps, by slices of documents and then as a whole.

Scores are integers (see ``impacts``), so the result doesn't depend on shards or partitions.

Defined results: a null or empty text has no terms; documents without terms aren't counted and never found, queries
without known terms give no rows. Repeated rows of documents are ranked each; repeated rows of queries (id and text)
are answered once; a query id with several texts is ranked once per text. Among equal scores the smaller id is
first and a null id last. Any id types; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, forget, small_batches

#: Terms (with repeats) after which a shard is closed; bytes of query text per block; documents per range of a shard.
SHARD_TERMS, BLOCK_BYTES, RANGE = 2_000_000, 4 << 20, 2048
#: The ranking's constants.
SCALE, SATURATION, FLAT, SLOPE = 1_000_000_000, 12, 75, 25
#: Bytes of a term (ASCII digits and letters, all beyond ASCII) stay, A-Z in lower case; the others part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class _Numbers(dict):
    """Gives each new term the next number."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _shard(numbers: _Numbers, keys: list[np.ndarray], lengths: list[int], ids: list, id_type: pa.DataType) -> pa.RecordBatch:
    """One row: terms in byte order, where each one's postings end, their documents and occurrences, the documents."""
    words = sorted(numbers)
    place = np.empty(len(words), np.int64)
    place[[numbers[w] for w in words]] = np.arange(len(words))
    flat, doc = np.concatenate(keys), np.repeat(np.arange(len(lengths)), lengths)
    pairs = np.sort(place[flat] << 32 | doc)
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    occurs = np.diff(np.append(first, len(pairs)))
    pairs = pairs[first]
    ends = np.searchsorted(pairs, np.arange(1, len(words) + 1) << 32)
    blob = lambda a, t: pa.array([np.asarray(a, t).tobytes()], pa.large_binary())
    own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, id_type))
    cols = [own, pa.array([len(ids)], pa.int64()), pa.array([len(flat)], pa.int64()), blob(lengths, "<u4"), pa.array([b" ".join(words)], pa.large_binary()), blob(ends, "<u4"), blob(pairs & 0xFFFFFFFF, "<u4"), blob(occurs, "<u4")]
    return pa.RecordBatch.from_arrays([c.cast(pa.binary()) if c.type == pa.large_binary() else c for c in cols], ["ids", "n_docs", "n_terms", "lengths", "terms", "ends", "docs", "occurs"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table of shards; ``forget`` removes it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, keys, lengths, ids, held, kind = _Numbers(), [], [], [], 0, None
        for b in batches:
            kind = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = terms_of(t.as_py())
                if not found:
                    continue
                keys.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                lengths.append(len(found))
                ids.append(i)
                held += len(found)
                if held >= SHARD_TERMS:
                    yield _shard(numbers, keys, lengths, ids, kind)
                    numbers, keys, lengths, ids, held = _Numbers(), [], [], [], 0
        if ids:
            yield _shard(numbers, keys, lengths, ids, kind)

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text))
    return cut(own.mapInArrow(run, f"ids array<{dict(own.dtypes)['doc_id']}>, n_docs long, n_terms long, lengths binary, terms binary, ends binary, docs binary, occurs binary"))


def _postings_of(wanted: dict[bytes, int], terms: bytes, ends: bytes) -> dict[int, tuple[int, int]]:
    """Number of a wanted term -> where its postings begin and end in the shard."""
    end, out = np.frombuffer(ends, "<u4"), {}
    for place, term in enumerate(terms.split(b" ")):
        n = wanted.get(term)
        if n is not None:
            out[n] = (int(end[place - 1]) if place else 0, int(end[place]))
    return out


def document_counts(index: DataFrame, wanted) -> dict[int, int]:
    """Number of a wanted term -> how many documents hold it; bounded by the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, ends in zip(b.column(0), b.column(1)):
                at = _postings_of(wanted.value[0], terms.as_py(), ends.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([e - s for s, e in at.values()], pa.int64())], ["term", "df"])

    return {r.term: r.df for r in index.select("terms", "ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(occurs: np.ndarray, lengths: np.ndarray, w: int, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to the scores of the documents that hold it."""
    m = FLAT + SLOPE * lengths * n_docs // n_terms
    return w * (SCALE * occurs // (1000 * occurs + SATURATION * m))


class Shard:
    """A shard opened for queries: postings and their impacts of wanted terms."""

    def __init__(self, wanted: dict[bytes, int], weights: dict[int, int], n_docs: int, n_terms: int, lengths: bytes, terms: bytes, ends: bytes, docs: bytes, occurs: bytes, span: int = RANGE):
        size, doc, times = (np.frombuffer(x, "<u4").astype(np.int64) for x in (lengths, docs, occurs))
        self.span, self.bounds = span, np.arange(0, len(size) + span, span)
        self.lists = {}
        for n, (s, e) in _postings_of(wanted, terms, ends).items():
            adds = impacts(times[s:e], size[doc[s:e]], weights[n], n_docs, n_terms)
            self.lists[n] = (doc[s:e], adds, int(adds.max()), np.searchsorted(doc[s:e], self.bounds))

    def best(self, query: dict[int, int], k: int, beat: int):
        """Yields (documents, scores) that may be among the best ``k``; ``beat`` (sent back) is the score to reach."""
        held = sorted((self.lists[n][2] * times, n, times) for n, times in query.items() if n in self.lists)
        limits = np.cumsum([most for most, _, _ in held])  # what the terms up to each place add at most
        for r in range(len(self.bounds) - 1):
            cut_off = int(np.searchsorted(limits, beat))  # terms before it are non-essential: together below ``beat``
            if cut_off == len(held):
                return
            base, scores = self.bounds[r], np.zeros(self.span, np.int64)
            for _, n, times in held[cut_off:]:
                docs, adds, _, at = self.lists[n]
                scores[docs[at[r] : at[r + 1]] - base] += adds[at[r] : at[r + 1]] * times
            found = np.flatnonzero(scores)
            scores = scores[found]
            for place in range(cut_off - 1, -1, -1):
                able = scores + limits[place] >= beat
                found, scores = found[able], scores[able]
                if not len(found):
                    break
                _, n, times = held[place]
                docs, adds, _, at = self.lists[n]
                docs, adds = docs[at[r] : at[r + 1]], adds[at[r] : at[r + 1]]
                spot = np.searchsorted(docs, found + base)
                spot[spot == len(docs)] = 0
                hit = docs[spot] == found + base if len(docs) else np.zeros(len(found), bool)
                scores[hit] += adds[spot[hit]] * times
            able = scores >= beat
            if able.any():
                beat = yield found[able] + base, scores[able]


def _best_of_task(index: DataFrame, sent, weights: dict[int, int], n_docs: int, n_terms: int, k: int, id_type: str) -> DataFrame:
    """(query, doc_id, score): each task's best ``k`` documents a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, queries = sent.value
        best: list[list[tuple]] = [[] for _ in queries]  # (-score, id is null, id), best first
        kind = None
        for b in batches:
            kind = b.column(0).type.value_type
            for row in range(b.num_rows):
                ids = b.column(0)[row].values
                order = np.empty(len(ids), np.int64)  # place of each document by id, nulls last
                order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                shard = Shard(wanted, weights, n_docs, n_terms, *(b.column(c)[row].as_py() for c in range(1, 6)), RANGE)
                for q, query in enumerate(queries):
                    own = best[q]
                    search, beat = shard.best(query, k, -own[-1][0] if len(own) == k else 1), None
                    while True:
                        try:
                            docs, scores = search.send(beat)
                        except StopIteration:
                            break
                        top = np.lexsort((order[docs], -scores))[:k]
                        own = sorted([*own, *((-int(s), i is None, i) for s, i in zip(scores[top], ids.take(pa.array(docs[top])).to_pylist()))], key=lambda r: r[:2] if r[1] else r)[:k]
                        beat = -own[-1][0] if len(own) == k else 1
                    best[q] = own
        rows = [(q, i, -s) for q, own in enumerate(best) for s, _, i in own]
        if rows:
            q, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, kind), pa.array(s, pa.int64())], ["query", "doc_id", "score"])

    return index.select("ids", "lengths", "terms", "ends", "docs", "occurs").mapInArrow(run, f"query int, doc_id {id_type}, score long")


def _top(df: DataFrame, keys: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_index(index: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every query."""
    spark = index.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    asked = asked.withColumn("__s_key", F.xxhash64("item_id", "text"))
    size, total = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0], index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    blocks, id_type, out = 1 + size // BLOCK_BYTES, dict(index.dtypes)["ids"][6:-1], None
    for n in range(blocks):
        block = asked.filter(F.pmod("__s_key", F.lit(blocks)) == n) if blocks > 1 else asked
        rows = block.select("item_id", "text").toArrow().sort_by("item_id")
        wanted, queries = _Numbers(), []
        for t in rows.column("text"):
            query: dict[int, int] = {}
            for term in terms_of(t.as_py()):
                query[wanted[term]] = query.get(wanted[term], 0) + 1
            queries.append(query)
        sent = spark.sparkContext.broadcast((dict(wanted), queries))
        df = document_counts(index, sent)
        weights = {t: weight(total[0], c) for t, c in df.items()}
        found = _best_of_task(index, sent, weights, total[0], total[1], k, id_type)
        found = _top(found, ["query", F.pmod(F.xxhash64("doc_id"), F.lit(64))], k).drop("rank")
        names = spark.createDataFrame(rows.select(["item_id"]).append_column("query", pa.array(range(len(queries)), pa.int32())))
        ranked = _top(found, ["query"], k).join(names.select(F.col("query").alias("__s_q"), F.col("item_id").cast(dict(items.dtypes)[item_id]).alias("item_id")), F.col("query") == F.col("__s_q"))
        ranked = ranked.select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Index and search in one: (item_id, rank, doc_id, score), the index removed again."""
    index = build_index(docs, id_col, text)
    found = cut(search_index(index, items, k, item_id, item_text))
    forget(index)
    return found


SQL = r"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(s, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM f GROUP BY r),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term, docs),
m AS (SELECT r, 75 + (25 * n * docs) // terms AS m FROM n, g),
i AS (SELECT row_number() OVER () AS i, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(regexp_extract_all(s, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""
