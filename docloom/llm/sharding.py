"""Sharding by a two-pass external shuffle [native].

Pass one scatters records uniformly over buckets by a seeded hash of the whole record; the number of buckets
follows from the rows and their bytes, so a bucket fits in memory at any size. Pass two runs Fisher-Yates inside
each bucket: the draw of a step is a hash of (seed, bucket, part, step), so a bucket that is computed again, on
whatever executor, comes out the same. A record's place in the whole permutation is its bucket's offset plus its
place in the bucket; shard = place mod shards, slot = place div shards. So the law is ``rows``: shard sizes
differ by one row at most, and each shard is a uniform sample of the corpus.

The order depends on the records and the seed alone, not on partitions, tasks or the session's settings. A bucket
beyond ``bucket_rows`` rows or ``bucket_bytes`` bytes (a record repeated in full shares one) is shuffled in
several parts below those limits; a single record may be larger. Defined results: a null text has no bytes: size 1,
checksum 0; repeated rows take a place each; nulls and extra columns are part of the record; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _row_bytes(docs: DataFrame) -> Column:
    """Bytes of a record: its strings and binaries, and 16 for each other column."""
    wide = [c for c, kind in docs.dtypes if kind in ("string", "binary")]
    return sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("long") for c in wide), F.lit(16 * len(docs.columns)).cast("long"))


def _record(docs: DataFrame) -> Column:
    """What identifies a record: a hash of all its columns (maps and variants, which have no hash, by their text)."""
    plain = lambda c, kind: F.to_json(f"`{c}`") if "map<" in kind else F.col(f"`{c}`").cast("string") if "variant" in kind else F.col(f"`{c}`")
    return F.xxhash64(*(plain(c, kind) for c, kind in docs.dtypes))


#: Fisher-Yates over the positions of array ``a``: step i swaps the last open place with a drawn one.
_FISHER_YATES = """
aggregate(
  IF(size(a) > 1, sequence(size(a) - 1, 1), cast(array() AS array<int>)),
  sequence(0, size(a) - 1),
  (p, i) -> transform(
    array(named_struct('i', i, 'j', cast(pmod(xxhash64({seed}, bucket, part, i), i + 1) AS int))),
    d -> transform(p, (x, k) -> CASE WHEN k = d.i THEN p[d.j] WHEN k = d.j THEN p[d.i] ELSE x END))[0])
"""


def shuffled(docs: DataFrame, seed: int = 42, bucket_rows: int = 512, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Struct column ``row`` (the record) and ``place`` (long, 0 to n - 1, a seeded permutation)."""
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(docs)).alias("b")).first()
    buckets = max(1, -(-total.n // bucket_rows), -(-(total.b or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), _record(docs)), F.lit(buckets)).alias("bucket")
    rows = docs.select(bucket, F.xxhash64(F.lit(seed + 1), _record(docs)).alias("tie"), _row_bytes(docs).alias("bytes"), F.struct("*").alias("row"))
    ids = docs.select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # offsets in two levels: within 1024 buckets each, then over the few groups of buckets
    ids = ids.withColumn("group", F.floor(F.col("bucket") / 1024))
    inner = ids.withColumn("before", F.sum("n").over(W.partitionBy("group").orderBy("bucket")) - F.col("n"))
    groups = ids.groupBy("group").agg(F.sum("n").alias("m"))
    groups = groups.select("group", (F.sum("m").over(W.orderBy("group")) - F.col("m")).alias("base"))
    offsets = inner.join(groups, "group").select("bucket", (F.col("before") + F.col("base")).alias("offset"))
    order = W.partitionBy("bucket").orderBy("tie")
    rows = rows.withColumn("nth", F.row_number().over(order) - 1).withColumn("ahead", F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, -1)))
    part = F.struct(F.floor(F.col("nth") / bucket_rows).alias("r"), F.floor(F.coalesce("ahead", F.lit(0)) / bucket_bytes).alias("b"))
    parts = rows.withColumn("part", part).groupBy("bucket", "part").agg(F.array_sort(F.collect_list(F.struct("nth", "row")), lambda x, y: x["nth"] - y["nth"]).alias("a"))
    first = F.col("offset") + F.get("a", F.lit(0))["nth"]
    mixed = parts.join(offsets, "bucket").select(first.alias("first"), "a", F.expr(_FISHER_YATES.format(seed=int(seed))).alias("order"))
    moved = F.transform("order", lambda at: F.get("a", at)["row"])
    return mixed.select("first", F.posexplode(moved).alias("i", "row")).select("row", (F.col("first") + F.col("i")).alias("place"))


def assign(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_rows: int = 512, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Struct column ``row``, ``shard`` (int) and ``slot`` (long)."""
    s = shuffled(docs, seed, bucket_rows, bucket_bytes)
    return s.select("row", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42, bucket_rows: int = 512, bucket_bytes: int = 32 << 20) -> None:
    """Whole records as Parquet, a folder ``__shard=n`` per shard, in slot order within each file."""
    cols = [F.col(f"row.`{c}`") for c in docs.columns]
    out = assign(docs, shards, seed, bucket_rows, bucket_bytes).select(F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), *cols)
    out.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").drop("__slot").write.partitionBy("__shard").parquet(path)


def sharding_query(docs: DataFrame) -> DataFrame:
    """Whole records are shuffled; sizes and checksums are read from the texts where they land."""
    body = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return assign(docs, 8).select("row.doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
