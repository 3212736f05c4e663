"""Token-ID output: packed id matrices by best-fit decreasing with a segment tree.

Every task encodes the documents of its own scan partition, cuts those longer than ``size`` into pieces
(none of their ids is lost) and packs windows of ``window`` tokens: longest piece first, each into the
open sequence with the least room that still fits, which a segment tree over the capacities finds in
log(size) steps. A row is one sequence: its ids padded to ``size`` (a row of the matrix, little-endian, 16
bits where the vocabulary allows), the cumulative segment lengths and the position ids, which restart at
each segment. No shuffle; memory is bounded by the window; a lost task is redone alone.

Defined results: a null or empty text yields the end id alone. Repeated rows are packed each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bpe import Encoder, loaded, shipped
from docloom.llm.common import small_batches
from docloom.llm.packing import cuts


class Rooms:
    """Open sequences by room left; a segment tree of counts answers "least room of at least n"."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.tree = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.width
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the best fit, taken out; None if nothing fits."""
        i = need + self.width
        while not self.tree[i]:
            while i & 1:  # a right child: nothing to its right under this parent
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.width:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.width
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Positions of ``lengths`` per sequence."""
    rooms, out = Rooms(size), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        hit = rooms.take(lengths[k])
        if hit is None:
            out.append([])
            hit = size, len(out) - 1
        out[hit[1]].append(k)
        rooms.put(hit[0] - lengths[k], hit[1])
    return out


SCHEMA = "sequence_id long, n_tokens int, doc_ids array<{0}>, pieces array<int>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


def packed_ids(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, window: int = 2_000_000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per packed sequence; see the module's docstring."""
    spark = docs.sparkSession
    small_batches(spark)
    definition, end, kind = shipped(spark, tokenizer), struct.pack("<I", end_id), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(definition.value)
        encoder = Encoder(bpe)
        wide = "<u2" if max(*bpe.vocab.values(), *bpe.special.values(), end_id) < 1 << 16 else "<u4"
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        held: list[tuple] = []  # (doc_id, piece, start, ids)
        tokens, id_type = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            plan = best_fit([len(h[3]) for h in held], size)
            for at in range(0, len(plan), 512):
                rows: list[list] = [[] for _ in range(8)]
                for members in plan[at : at + 512]:
                    parts = [held[k] for k in members]
                    ns = [len(p[3]) for p in parts]
                    ids = np.full(size, end_id, wide)
                    pos = np.zeros(size, "<u2" if size <= 1 << 16 else "<u4")
                    ids[: sum(ns)] = np.concatenate([p[3] for p in parts])
                    pos[: sum(ns)] = np.concatenate([np.arange(n) for n in ns])
                    for col, v in zip(rows, (serial, sum(ns), [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], [0, *np.cumsum(ns).tolist()], ids.tobytes(), pos.tobytes())):
                        col.append(v)
                    serial += 1
                types = [pa.int64(), pa.int32(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], [f.split()[0] for f in SCHEMA.split(", ")])
            held.clear()

        for b in batches:
            id_type = b.column(0).type
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(encoder.encode(t or "") + end, "<u4").astype(wide)
                held.extend((doc, i, s, ids[s : s + n]) for i, (s, n) in enumerate(cuts(len(ids), size)))
                tokens += len(ids)
                if tokens >= window:
                    yield from flush()
                    tokens = 0
        if held:
            yield from flush()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text)).mapInArrow(run, SCHEMA.format(kind))


def unpack(row) -> Iterator[tuple]:
    """(doc_id, piece, start, ids) of each segment of a row."""
    width = len(row.position_ids) and len(row.input_ids) // (len(row.position_ids) // 2)
    ids = np.frombuffer(row.input_ids, "<u2" if width == 2 else "<u4")
    for k, doc in enumerate(row.doc_ids):
        yield doc, row.pieces[k], row.starts[k], ids[row.cu_seqlens[k] : row.cu_seqlens[k + 1]]
