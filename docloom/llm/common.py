"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.tables import forget  # noqa: F401
from docloom.sources.tables import written as cut  # noqa: F401

#: White space of every operator here: blank and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and bytes, so that long texts don't pile up; a session's own values stay."""
    for key, value in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", str(32 << 20))):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) in (None, "10000", "-1"):
            spark.conf.set(name, value)


def words_of(text: Column) -> Column:
    """Array of the words (runs without ASCII white space) of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(words: str, size: int) -> str:
    """SQL for the XXH64 hashes of all ``size``-word shingles of the array column ``words``."""
    parts = ", ' ', ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(size))
    return f"IF(size({words}) >= {size}, transform(sequence(0, size({words}) - {size}), i -> xxhash64(concat({parts}))), array())"


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once: no later filter is pushed below them with their expressions."""
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: A key filter has 2^26 bits (8 MB) at any size of the corpus; up to some 8 million keys it lets 3 % of the others through.
FILTER_WORDS, FILTER_PROBES = 1 << 20, 3


def _probes(keys: np.ndarray) -> np.ndarray:
    """Bit numbers (probes x keys) of 64-bit keys."""
    k = keys.view(np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([((k * np.uint64(2 * n * 0x9E3779B97F4A7C15 % (1 << 64) | 1)) >> np.uint64(38)) for n in range(1, FILTER_PROBES + 1)]).astype(np.int64)


def key_filter(keys: DataFrame):
    """A broadcast Bloom filter of the first column's 64-bit keys: 8 MB whatever their number, gathered by tasks as words of bits.

    It only spares rows a shuffle that an exact join would send away; every row it lets through still meets that join, so a
    full filter costs time and loses nothing.
    """
    small_batches(keys.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_probes(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).ravel())
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(np.int64(1), at & 63), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits)], ["word", "bits"])

    found = keys.select(F.col(keys.columns[0]).cast("long").alias("k")).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(words)


def maybe(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    at = _probes(np.ascontiguousarray(keys, np.int64))
    return ((words[at >> 6] >> (at & 63)) & 1).all(axis=0)


def passes(filter_, key: Column) -> Column:
    """Boolean column: the filter lets the key through."""

    @F.pandas_udf("boolean")
    def check(k: pd.Series) -> pd.Series:
        return pd.Series(maybe(filter_.value, k.to_numpy()))

    return check(key)
