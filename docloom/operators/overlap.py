"""Texts reduced to what both sides of a search tell: sentences with an event that a document of the other side has as well.

No pair of documents is formed. A document keeps an event if the other side holds it outside the document itself, which the
smallest and the largest id of its holders tell: both are the document only where nobody else has the event. Events travel as hashes of 96 bits
with ids and line numbers; sentences stay with their text until the kept line numbers meet it.

Defined results: a query and a candidate of equal id are the same document and give each other nothing. Null events and ids
count nowhere; repeated rows count once. Documents that keep no sentence have an empty text and no lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.tables import written

QUERY, CANDIDATE, BOTH = "query", "candidate", "both"

#: Bits that tell which events no query has: 8 MB at any size of the query set.
BITS = 1 << 26


def _query_bits(queries: DataFrame) -> np.ndarray:
    """A word of 64 bits for each 64 event hashes ``h``. A full set lets all events through and loses nothing."""
    b = queries.select(F.col("h").bitwiseAND(F.lit(BITS - 1).cast("long")).alias("b"))
    rows = b.select(F.shiftright("b", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("bit"))
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most BITS / 64 rows
    out = np.zeros(BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def met(events: DataFrame) -> DataFrame:
    """(doc_id, line, h, g, as_query, as_candidate): events that the other side holds outside the document, and for which side of it.

    Events that no query has stay out before anything moves; those of one document alone before the second join.
    """
    own = events.filter("event IS NOT NULL AND doc_id IS NOT NULL").select("side", "doc_id", "line", F.xxhash64("event").alias("h"), F.hash("event").alias("g"))
    asked, offered = F.col("side").isin(QUERY, BOTH), F.col("side").isin(CANDIDATE, BOTH)
    sent = events.sparkSession.sparkContext.broadcast(_query_bits(own.filter(asked)))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(3).to_numpy().view(np.uint64) & np.uint64(BITS - 1)
            yield batch.filter(pa.array((sent.value[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1))

    near = written(own.mapInArrow(known, own.schema))
    ends = lambda side, a, b: (F.min(F.when(side, F.col("doc_id"))).alias(a), F.max(F.when(side, F.col("doc_id"))).alias(b))
    held = near.groupBy("h", "g").agg(*ends(asked, "q1", "q2"), *ends(offered, "c1", "c2")).filter("q1 IS NOT NULL AND c1 IS NOT NULL AND NOT (q1 = q2 AND c1 = c2 AND q1 = c1)")
    told = lambda side, a, b: (side & ((F.col(a) != F.col("doc_id")) | (F.col(b) != F.col("doc_id"))))
    met = near.join(held, ["h", "g"]).select("doc_id", "line", "h", "g", told(asked, "c1", "c2").alias("as_query"), told(offered, "q1", "q2").alias("as_candidate"))
    return met.filter("as_query OR as_candidate")


def _by_side() -> Column:
    return F.explode(F.filter(F.array(F.when(F.col("as_query"), QUERY), F.when(F.col("as_candidate"), CANDIDATE)), F.isnotnull)).alias("side")


def shared_lines(events: DataFrame) -> DataFrame:
    """(side, doc_id, line), distinct, of ``events(side, doc_id, line, event)`` that hold an event of the other side; ``side`` may be ``both``."""
    lines = met(events).groupBy("doc_id", "line").agg(F.max("as_query").alias("as_query"), F.max("as_candidate").alias("as_candidate"))
    return lines.select(_by_side(), "doc_id", "line")


def shared_events(events: DataFrame) -> DataFrame:
    """(side, doc_id, n_shared): a document's distinct events that the other side holds; documents without one are absent."""
    each = met(events).groupBy("doc_id", "h", "g").agg(F.max("as_query").alias("as_query"), F.max("as_candidate").alias("as_candidate"))
    return each.select(_by_side(), "doc_id").groupBy("side", "doc_id").agg(F.count(F.lit(1)).alias("n_shared"))


def events_of(docs: DataFrame, sentences: Column, events: Callable[[Column], Column], queries: Column) -> DataFrame:
    """(side, doc_id, line, event) of ``docs``; every document is a candidate, those where ``queries`` holds are on both sides.

    ``events`` makes an array of events of one sentence's column. Lines count from 0.
    """
    side = F.when(queries, BOTH).otherwise(CANDIDATE)
    lines = docs.select(side.alias("side"), "doc_id", F.posexplode(sentences).alias("line", "sentence"))
    return lines.select("side", "doc_id", "line", F.explode(F.array_distinct(events(F.col("sentence")))).alias("event"))


def filtered_texts(docs: DataFrame, sentences: Column, lines: DataFrame, queries: Column, joiner: str = "\n") -> DataFrame:
    """(side, doc_id, n_lines, text): the sentences of ``lines(side, doc_id, line)`` in their order, one row a side and document of unique id."""
    kept = lines.groupBy("doc_id").agg(  # bounded by one document's lines
        F.sort_array(F.collect_list(F.when(F.col("side") == QUERY, F.col("line")))).alias(QUERY),
        F.sort_array(F.collect_list(F.when(F.col("side") == CANDIDATE, F.col("line")))).alias(CANDIDATE),
    )
    none = F.array().cast("array<int>")
    row = lambda side: F.struct(F.lit(side).alias("side"), F.coalesce(side, none).alias("at"))
    both = docs.select("doc_id", sentences.alias("s"), queries.alias("asked")).join(kept, "doc_id", "left")
    out = both.select("doc_id", "s", F.inline(F.when(F.col("asked"), F.array(row(QUERY), row(CANDIDATE))).otherwise(F.array(row(CANDIDATE)))))
    return out.select("side", "doc_id", F.size("at").cast("long").alias("n_lines"), F.array_join(F.transform("at", lambda i: F.get("s", i)), joiner).alias("text"))
