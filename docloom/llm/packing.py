"""Best-fit packing by length-histogram planning.

Tokenising turns each document into pieces (length, start, checksum) without a shuffle of texts. The
plan needs only the histogram of piece lengths, at most ``size`` rows whatever the corpus: best-fit
decreasing runs over counts, moving whole classes of equally full sequences at once. Pieces then take
planned slots by their rank within their length. Ranks are dealt over ``buckets`` hash buckets per
length, so that a length held by a third of all pieces is ranked by many tasks.

Defined results: a null text is empty and yields the end id alone, one piece of length 1. Repeated rows
are packed each. Ties within a length fall by bucket, doc_id and piece. Only documents longer than
``size`` are cut, every piece but the first full.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.bpe import Encoder, loaded, shipped
from docloom.llm.common import cut, small_batches


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids followed by ``end_id``."""
    spark = docs.sparkSession
    small_batches(spark)
    definition, end = shipped(spark, tokenizer), struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(loaded(definition.value))
        for b in batches:
            at, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                ids = encoder.encode(t or "") + end
                for i, (s, n) in enumerate(cuts(len(ids) // 4, size)):
                    at.append(k)
                    rows.append((i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, pieces a sequence, offset).

    The piece of rank r in a row's range goes to sequence first + (r - first rank) // per, behind
    ``offset`` and the (r - first rank) % per pieces of its length that are there already.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences
    out, n_sequences = [], 0
    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            room = min((r for r, v in free.items() if r >= length and v), default=None)
            if room is None:
                per = size // length
                new = -(-todo // per)
                free.setdefault(size, []).append((n_sequences, new))
                n_sequences += new
                continue
            lo, n = free[room].pop()
            per = room // length
            used = min(n, -(-todo // per))
            if used < n:
                free[room].append((lo + used, n - used))
            placed = min(todo, used * per)
            out.append((length, rank, placed, lo, per, size - room))
            full, rest = divmod(placed, per)
            if full and (left := room - per * length):
                free.setdefault(left, []).append((lo, full))
            if rest:
                free.setdefault(room - rest * length, []).append((lo + full, 1))
            rank += placed
            todo -= placed
    return out


def place(cut_pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    spark = cut_pieces.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    cells = cut(p.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    ahead = cells.withColumn("ahead", F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    p = p.withColumn("nth", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = p.join(ahead, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    slots = spark.createDataFrame(plan(histogram, size) or [(0, 0, 0, 0, 1, 0)], "at_length long, lo long, n long, first long, per long, base long")
    hit = ranked.join(F.broadcast(slots), (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n")))  # the plan follows from ``size``, not from the corpus
    nth = F.col("rank") - F.col("lo")
    return hit.withColumn("sequence_id", (F.col("first") + F.floor(nth / F.col("per"))).cast("long")).withColumn("offset", F.col("base") + nth % F.col("per") * F.col("length")).select(*cut_pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    return place(cut(pieces(docs, tokenizer, size, end_id, id_col, text)), size)
