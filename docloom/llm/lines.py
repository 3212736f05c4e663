"""Line dedup: lines that many documents share stay in one of them.

Each document's lines are normalised and hashed once (96 bits of MD5; only keys of ``least_chars`` code
points or more). The hashes are exploded, distinct documents per hash counted with map-side combine, and
hashes over the threshold meet the documents' hashes again; what crosses the shuffle there are ids, positions
and hashes, never lines. Documents that lose lines meet their positions by a join and are put together again by
position; all others are kept back from that join by a filter of fixed size (``key_filter``), so they don't move.

Defined results: a null or empty text is one empty line, never dropped. Rows are documents: repeated rows
count and are cut each. A null doc_id is the largest only where every holder's is null. Extra columns
are kept by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, columns, cut, forget, key_filter, passes


def _hashes(text: str, least_chars: int):
    """Per line the hash of its key, or null for a short key."""
    key = lambda x: ascii_lower(F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return F.transform(F.transform(lines, lambda x: F.when(F.length(x) >= least_chars, key(x))), lambda k: F.when(F.length(k) >= least_chars, F.substring(F.md5(k.cast("binary")), 1, 24)))


def dropped_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_hash, drop): positions (from 0) of the lines to go, for the texts that lose any."""
    hashed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), _hashes(text, least_chars).alias("hs"))
    hashed = cut(hashed.filter(F.exists("hs", lambda h: h.isNotNull())))
    per_doc = hashed.select("doc", F.explode(F.array_distinct("hs")).alias("h")).filter("h IS NOT NULL")
    shared = cut(per_doc.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= least_docs).select("h", "last"))
    lines = hashed.select("doc", "text_hash", F.posexplode("hs").alias("pos", "h")).filter("h IS NOT NULL")
    gone = lines.join(shared, "h").filter(~F.col("doc").eqNullSafe(F.col("last")))
    drop = cut(gone.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("drop")))  # bounded by one document's lines
    forget(hashed, shared)
    return drop


def cut_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, with ``__l_lines`` (array), ``__l_drop`` (positions or null) and ``__l_text`` (what stays)."""
    drop = dropped_lines(docs, least_chars, least_docs, id_col, text).toDF("__l_doc", "__l_hash", "__l_drop")
    known = key_filter(drop.select(F.xxhash64("__l_doc", "__l_hash")))
    asked = docs.withColumn("__l_key", F.xxhash64(F.col(text))).withColumn("__l_maybe", passes(known, F.xxhash64(F.col(id_col), F.col("__l_key"))))
    hit = asked.filter("__l_maybe").join(drop, F.col(id_col).eqNullSafe(F.col("__l_doc")) & (F.col("__l_key") == F.col("__l_hash")), "left")
    df = asked.filter("NOT __l_maybe").select(*columns(docs), F.lit(None).cast("array<int>").alias("__l_drop")).union(hit.select(*columns(docs), "__l_drop"))
    df = df.withColumn("__l_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__l_lines") - 1), F.col("__l_drop"))
    return df.withColumn("__l_text", F.when(F.col("__l_drop").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__l_lines"), i)), "\n")))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text: str = "text", chars: str | None = None) -> DataFrame:
    """The documents with their remaining lines; ``chars`` names a column of text lengths to bring up to date."""
    df = cut_lines(docs, least_chars, least_docs, id_col, text)
    new = {text: F.col("__l_text")} | ({chars: F.when(F.col("__l_drop").isNull(), F.col(chars)).otherwise(F.length("__l_text").cast(dict(docs.dtypes)[chars]))} if chars else {})
    return df.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def lines_query(docs: DataFrame) -> DataFrame:
    df = cut_lines(docs.select("doc_id", "text"))
    return df.select("doc_id", F.size("__l_lines").cast("long").alias("n_lines"), F.when(F.col("__l_drop").isNull(), 0).otherwise(F.size("__l_drop")).cast("long").alias("n_dropped"), F.sha2(F.coalesce("__l_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS s FROM d),
k AS (SELECT *, translate(regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM x),
c AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
f AS (SELECT k.*, c.k IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN c USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(s, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY r, doc_id
"""
