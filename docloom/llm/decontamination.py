"""Benchmark decontamination by size-partitioned MinHash containment search [native].

A test item leaks into a document when the document holds at least ``threshold`` of the item's distinct
5-word shingles. Items are partitioned by size (powers of two of their number of shingles). An item's
sketch has as many shingles as a leaking document can lack in the partition's largest item, plus one. So a
document that leaks an item always meets its sketch, however long the document is: the search loses nothing.
The sketch takes the shingles that the fewest items hold, among those the lowest hashes: a phrase that many
items share (“which of the following ...”) is in a sketch only where an item has nothing rarer. Candidates
are then verified by exact containment of the shingle strings.

Plan: documents' shingle hashes are exploded inside the scan's stage and meet the sketches by a hash
join; Spark broadcasts those only when their measured size is under its threshold. A document's candidates
are numbered and dealt out in rows of at most ``ROW_ITEMS`` items, so no row gathers items without bound; its
text meets each of those rows in one join without a hint, which Spark plans by measured size as well.

Defined results: words are split at ASCII white space and compared without the case of A-Z. Items with
fewer than five words have one shingle, their whole sequence; items without words never leak. Null or
empty texts hold nothing. Repeated rows are reported each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, columns, cut, pinned, shingle_hashes, words_of

SHINGLE = 5
#: Candidate items of one document in one row; a document with more has several rows.
ROW_ITEMS = 64


def _shingles(words: str, size: int) -> str:
    parts = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return f"IF(size({words}) >= {size}, transform(sequence(0, size({words}) - {size}), i -> concat_ws(' ', {parts})), cast(array() AS array<string>))"


def sketches(items: DataFrame, threshold: float, id_col: str, text: str) -> DataFrame:
    """(item, item_id, k, shingles, n, sketch) of the items that have words; ``k`` is the shingle's size."""
    key = F.xxhash64(id_col, text).alias("item")  # repeated rows of items share it
    w = items.select(key, F.col(id_col).alias("item_id"), words_of(ascii_lower(F.col(text))).alias("w")).filter("size(w) > 0")
    own = F.when(F.size("w") < SHINGLE, F.array(F.concat_ws(" ", "w"))).otherwise(F.expr(_shingles("w", SHINGLE)))
    s = w.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE))).withColumn("shingles", F.array_distinct(own)).withColumn("n", F.size("shingles").cast("long"))
    largest = F.pow(2.0, F.floor(F.log2("n")) + 1) - 1  # of the item's size partition
    length = (largest - F.ceil(largest * threshold - 1e-9) + 1).cast("int")
    s = s.withColumn("length", length)
    each = s.dropDuplicates(["item"]).select("item", "length", F.explode(F.array_distinct(F.transform("shingles", lambda x: F.xxhash64(x)))).alias("h"))
    held = each.join(each.groupBy("h").agg(F.count(F.lit(1)).alias("held")), "h")  # by how many items
    rarest = F.transform(F.sort_array(F.collect_list(F.struct("held", "h"))), lambda x: x["h"])  # bounded by one item's shingles
    own = held.groupBy("item").agg(rarest.alias("hs"), F.first("length").alias("len")).select("item", F.slice("hs", 1, F.least("len", F.size("hs"))).alias("sketch"))
    return s.select("item", "item_id", "k", "shingles", "n").join(own, "item")


#: The bits that mark documents with candidates: at most 2^19 words of 64 bits are broadcast, at any size of the corpus.
FILTER_BITS = 1 << 25


def _marked(rows: DataFrame, key: Column, found: DataFrame) -> DataFrame:
    """Adds ``__d_maybe``: the row's key has the bit of a document of ``found``. Others can't have candidates, so their texts
    needn't move. A full filter costs time and loses nothing: rows that it lets through still meet the exact join."""
    word = lambda k: F.shiftright(k.bitwiseAND(F.lit(FILTER_BITS - 1)), 6)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    own = F.xxhash64("doc_id", "text_hash")
    words = found.select(word(own).alias("__d_w"), bit(own).alias("__d_b")).groupBy("__d_w").agg(F.bit_or("__d_b").alias("__d_bits"))
    return rows.withColumns({"__d_word": word(key), "__d_bit": bit(key)}).join(F.broadcast(words), F.col("__d_word") == F.col("__d_w"), "left").withColumn("__d_maybe", F.coalesce(F.col("__d_bits").bitwiseAND(F.col("__d_bit")) != 0, F.lit(False)))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, n_item_shingles, n_shared, containment) per leaking pair of rows."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("body"))
    found, sk, sizes = _candidates(own, items, threshold, item_id, item_text)
    near = _marked(own, F.xxhash64("doc_id", "text_hash"), found).filter("__d_maybe")
    both = near.join(found.toDF("__d_id", "__d_hash", "__d_met"), F.col("doc_id").eqNullSafe(F.col("__d_id")) & (F.col("text_hash") == F.col("__d_hash")))
    leaks = _leaks(both, "body", sizes, threshold).select("doc_id", "text_hash", F.inline("__d_leaks")).withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
    return leaks.join(sk.select("item", "item_id"), "item").select("doc_id", "text_hash", "item_id", "n_item_shingles", "n_shared", "containment")  # a row per repeated item row


def _candidates(own: DataFrame, items: DataFrame, threshold: float, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """((doc_id, text_hash, met): items whose sketch a document of ``own(doc_id, text_hash, body)`` meets, with their shingles; the sketches; the shingles' sizes)."""
    sk = cut(sketches(items, threshold, item_id, item_text))
    sizes = sorted({SHINGLE, *(r.k for r in sk.select("k").distinct().collect())})  # at most five values
    words = own.select("doc_id", "text_hash", words_of(ascii_lower(F.col("body"))).alias("w"))
    hashes = F.expr(f"concat({', '.join(shingle_hashes('w', k) for k in sizes)})")
    met = words.select("doc_id", "text_hash", F.explode_outer(hashes).alias("h")).join(sk.dropDuplicates(["item"]).select("item", F.explode("sketch").alias("h")), "h")
    pairs = met.select("doc_id", "text_hash", "item").distinct().withColumn("row", F.floor((F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("item")) - 1) / ROW_ITEMS))
    rows = pairs.join(sk.groupBy("item").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "item")
    found = cut(rows.groupBy("doc_id", "text_hash", "row").agg(F.collect_list(F.struct("item", "n", "shingles")).alias("met")).drop("row"))  # at most ROW_ITEMS
    return found, sk, sizes


def _leaks(both: DataFrame, text: str, sizes: list[int], threshold: float) -> DataFrame:
    """Adds ``__d_leaks``: of the items ``__d_met``, those that the text holds by exact containment of their shingles."""
    w = words_of(ascii_lower(F.col(text)))
    both = pinned(both, __d_words=F.when(F.col("__d_met").isNotNull(), w))
    both = pinned(both, __d_own=F.expr(f"IF(__d_met IS NOT NULL, concat({', '.join(_shingles('__d_words', k) for k in sizes)}), NULL)"))
    shared = "transform(__d_met, x -> named_struct('item', x.item, 'n_item_shingles', x.n, 'n_shared', cast(size(array_intersect(x.shingles, __d_own)) AS long)))"
    return pinned(both, __d_shared=F.expr(shared)).withColumn("__d_leaks", F.expr(f"filter(__d_shared, x -> x.n_shared >= x.n_item_shingles * {threshold!r}D - 1e-9)"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that leak no item, all columns kept. Leaking ones are found first; only texts that carry one's mark meet them in a join."""
    found = contaminated(docs, items, threshold, id_col, text).select("doc_id", "text_hash").distinct()
    leaking = cut(found)
    marked = _marked(docs, F.xxhash64(F.col(id_col), F.xxhash64(F.col(text))), leaking)
    gone = leaking.toDF("__d_id", "__d_hash")
    judged = marked.filter("__d_maybe").join(gone, F.col(id_col).eqNullSafe(F.col("__d_id")) & (F.xxhash64(F.col(text)) == F.col("__d_hash")), "left_anti")
    return marked.filter("NOT __d_maybe").select(*columns(docs)).union(judged.select(*columns(docs)))


def decontamination_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items).drop("text_hash")


SQL = r"""
WITH lw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT row_number() OVER () AS b, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT b, item_id, least(5, len(w)) AS k, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0)),
d AS (SELECT DISTINCT r, doc_id, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM lw, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
n AS (SELECT b, count(*) AS n FROM i GROUP BY b),
m AS (SELECT r, doc_id, b, item_id, count(*) AS c FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n::BIGINT AS n_item_shingles, c::BIGINT AS n_shared, c / n AS containment FROM m JOIN n USING (b) WHERE c >= n * 0.8 - 1e-9
"""
