"""Entities of a dictionary in texts: a token trie as tables, longest match, aliases, priorities.

A dictionary is a table of (entity, alias, case_sensitive, priority). Its aliases are cut into tokens. The trie's first
level is a table from a first token to the lengths of the aliases below it; its leaves are a table from whole aliases
to entities. Every place of a text whose token is on the first level is followed down to those lengths and no further,
so a text is read once and its places multiply by the lengths that their token has, not by the aliases that share it.
Tokens that can't begin an alias stay out by a bit set of
fixed size. Both tables have one row a key and take any size: Spark broadcasts them by measured size or shuffles the places.

Where matches overlap, the leftmost stays, of those the longest, then the highest priority, then the smallest entity;
matches are sorted within partitions and resolved as a stream, so no document's matches are gathered.

Defined results: a null or empty text or alias has no tokens. Letter case counts only for case-sensitive aliases; blanks
between tokens don't count, every sign is a token. Of one alias that several entities have, the one of highest priority
(null counts as 0), then of smallest id is meant. Repeated rows (id and text) are answered once. Any id types.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.records import sums_before
from docloom.functions.text import let

#: A word of letters, figures and anything beyond ASCII, or a single sign.
TOKEN = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[^\x{80}-\x{10FFFF}0-9A-Za-z_\s]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(entries: DataFrame, entity: str = "entity_id", alias: str = "alias", case_sensitive: str | None = None, priority: str | None = None) -> DataFrame:
    """(key, exact, n, first, entity_id, priority): one row per alias, ``exact`` null where letter case doesn't count."""
    strict = F.coalesce(F.col(case_sensitive), F.lit(False)) if case_sensitive else F.lit(False)
    weight = F.coalesce(F.col(priority), F.lit(0)).cast("long") if priority else F.lit(0).cast("long")
    own = entries.select(F.col(entity).alias("entity_id"), strict.alias("strict"), weight.alias("priority"), tokens(F.col(alias)).alias("t")).filter(F.size("t") > 0)
    word = F.concat_ws(" ", "t")
    own = own.select("entity_id", "priority", _lower(word).alias("key"), F.when(F.col("strict"), word).alias("exact"), F.size("t").alias("n"), _lower(F.get("t", F.lit(0))).alias("first"))
    best = own.groupBy("key", "exact", "n", "first").agg(F.min(F.struct((-F.col("priority")).alias("p"), "entity_id")).alias("best"))
    return best.select("key", "exact", "n", "first", "best.entity_id", (-F.col("best.p")).alias("priority"))


def first_level(leaves_: DataFrame) -> DataFrame:
    """(first, lengths): the lengths of the aliases that begin with a token."""
    return leaves_.groupBy("first").agg(F.collect_set("n").alias("lengths"))  # at most one per length


#: Bits that tell which tokens can't begin an alias: 8 kB at any size of the dictionary.
FIRST_BITS = 1 << 16


def _bit(token: Column) -> Column:
    return F.xxhash64(_lower(token)).bitwiseAND(F.lit(FIRST_BITS - 1).cast("long"))


def first_bits(leaves_: DataFrame) -> list[int]:
    """64-bit words of the bits of all first tokens. A full set costs time and loses nothing: what it lets through still meets the first level."""
    b = leaves_.select(_bit(F.col("first")).alias("b"))
    rows = b.select(F.shiftright("b", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("bit"))
    found = {r.word: r.bits for r in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()}
    return [found.get(w, 0) for w in range(FIRST_BITS // 64)]


def places(docs: DataFrame, longest: int, bits: list[int], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, token, start, window, gaps): tokens that may begin an alias, with their place and the tokens from there on, ``longest`` at most."""
    body = F.coalesce(F.col(text), F.lit(""))
    known = F.array(*(F.lit(b).cast("long") for b in bits))

    def able(x: Column) -> Column:
        return let(_bit(x), lambda b: F.call_function("getbit", F.get(known, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)

    def rows(t: Column) -> Column:
        gaps = F.split(body, TOKEN, -1)
        lengths = lambda g: F.transform(t, lambda x, i: F.length(x) + F.length(F.get(g, i)))
        return let(gaps, lambda g: sums_before(lengths(g), lambda sums: F.transform(F.filter(F.transform(t, lambda x, i: F.when(able(x), i)), lambda i: i.isNotNull()), lambda i: F.struct(i.alias("token"), (sums(i) + F.length(F.get(g, i))).alias("start"), F.slice(t, i + 1, F.lit(longest)).alias("window"), F.slice(g, i + 2, F.lit(longest)).alias("gaps")))))

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.inline(let(tokens(F.col(text)), rows)))


def matches(docs: DataFrame, leaves_: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, token, n, start, text, entity_id, priority): all matches, overlapping ones too."""
    longest = leaves_.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    at = places(docs, longest, first_bits(leaves_), id_col, text)
    met = at.join(first_level(leaves_), _lower(F.get("window", F.lit(0))) == F.col("first"))
    down = F.filter("lengths", lambda n: n <= F.size("window"))
    cut = lambda n: F.struct(F.concat_ws(" ", F.slice("window", F.lit(1), n)).alias("word"), n.alias("len"))
    down = met.select("doc_id", "text_hash", "token", "start", "window", "gaps", F.inline(F.transform(down, cut)))
    hit = down.join(leaves_.drop("first"), (_lower(F.col("word")) == F.col("key")) & (F.col("len") == F.col("n")) & (F.col("exact").isNull() | (F.col("exact") == F.col("word"))))
    body = F.array_join(F.transform(F.slice("window", F.lit(1), F.col("n")), lambda x, i: F.concat(F.when(i > 0, F.get("gaps", i - 1)).otherwise(F.lit("")), x)), "")
    return hit.select("doc_id", "text_hash", "token", "n", "start", body.alias("text"), "entity_id", "priority")


def resolve(found: DataFrame) -> DataFrame:
    """Of overlapping matches the leftmost, longest, most important one; the same columns."""
    ordered = found.distinct().repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "token", F.col("n").desc(), F.col("priority").desc(), "entity_id")
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, end = None, 0
        for b in batches:
            keep = []
            for row, (d, h, t, n) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
                if (d, h) != doc:
                    doc, end = (d, h), 0
                if t >= end:
                    keep.append(row)
                    end = t + n
            yield b.take(pa.array(keep, pa.int64()))

    return ordered.mapInArrow(run, found.schema).select(*names)


def entities(docs: DataFrame, entries: DataFrame, case_sensitive: str | None = None, priority: str | None = None, overlaps: bool = False, entity: str = "entity_id", alias: str = "alias", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, text, entity_id, token, n): the dictionary's entities in the texts, with ``overlaps`` all of them."""
    found = matches(docs, leaves(entries, entity, alias, case_sensitive, priority), id_col, text)
    found = found.distinct() if overlaps else resolve(found)
    return found.select("doc_id", "start", (F.col("start") + F.length("text")).alias("end"), "text", "entity_id", "token", "n")
