"""Text quality by language profiles: how close a text's pairs of adjoining characters are to those of its language.

Characters outside printable ASCII are dropped first; a pair is two adjoining letters or digits, upper and lower case apart.
A language's profile is the mean of its texts' pair shares over texts of ``LEAST`` characters or more that have a pair.
A text's cosine with its language's profile (that of the default language, where its own has none) gives two ratings, 0 to 10.

Defined results: null, empty and pairless texts have cosine and ratings 0, as have all where neither profile exists. Pairs
are counted inside a row, whatever its length; what moves are shares summed per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.tables import written

#: Texts of fewer characters don't shape a profile.
LEAST = 100

# The quadratic rating of a cosine in per cent, and where it begins.
SQUARE, LINEAR, CONSTANT = 0.00219033, -0.1239173, 1.1268522
LOWEST = 50

_PRINTABLE = np.zeros(128, bool)
_PRINTABLE[[*range(9, 14), *range(32, 127)]] = True
_WORD = np.zeros(128, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def pair_counts(texts: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """(id_col, *others, pairs, ns): codes of the pairs of each text (128 times the first character plus the second) and their numbers."""
    kept = [id_col, *others]
    types = dict(texts.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, ns, ends = [], [], [0]
            for text in b.column(len(kept)):
                a = np.frombuffer((text.as_py() or "").encode("ascii", "ignore"), np.uint8)
                a = a[_PRINTABLE[a]].astype(np.int32)
                word = _WORD[a]
                own, n = np.unique((a[:-1] * 128 + a[1:])[word[:-1] & word[1:]], return_counts=True)
                codes.append(own)
                ns.append(n)
                ends.append(ends[-1] + len(own))
            flat = lambda parts, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), flat(codes, pa.int32()), flat(ns, pa.int64())], [*kept, "pairs", "ns"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", pairs array<int>, ns array<bigint>"
    return texts.select(*kept, text_col).mapInArrow(count, schema)


def _exploded(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.select(*keys, F.explode(F.arrays_zip("pairs", "ns")).alias("x")).select(*keys, F.col("x.pairs").alias("pair"), F.col("x.ns").alias("n"))


def language_profiles(texts: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, pair, share) of ``texts(lang_col, text_col)``; rows without a language shape no profile."""
    own = texts.filter(F.col(lang_col).isNotNull() & (F.length(text_col) >= LEAST)).select(F.col(lang_col).alias("lang"), text_col)
    counts = pair_counts(own, "lang", text_col).filter(F.size("pairs") > 0)
    shares = counts.withColumn("total", F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x))
    summed = _exploded(shares, "lang", "total").groupBy("lang", "pair").agg(F.sum(F.col("n") / F.col("total")).alias("s"))
    # the sums of a language's shares are its number of texts
    return summed.join(summed.groupBy("lang").agg(F.sum("s").alias("n_texts")), "lang").select("lang", "pair", (F.col("s") / F.col("n_texts")).alias("share"))


def text_ratings(texts: DataFrame, profiles: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", default: str = "en") -> DataFrame:
    """(id_col, cosine, rating, rating_quadratic) of texts with unique ids against ``profiles(lang, pair, share)``."""
    known = profiles.groupBy("lang").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("z"))
    named = texts.select(id_col, F.col(lang_col).alias("lang"), text_col).join(known.select("lang", F.lit(True).alias("has")), "lang", "left")
    named = named.select(id_col, F.when(F.col("has"), F.col("lang")).otherwise(default).alias("lang"), text_col)
    counts = pair_counts(named, id_col, text_col, "lang").withColumn("norm", F.sqrt(F.aggregate("ns", F.lit(0.0), lambda s, x: s + x * x)))
    dots = _exploded(counts, id_col, "lang", "norm").join(profiles, ["lang", "pair"]).groupBy(id_col, "lang", "norm").agg(F.sum(F.col("n") * F.col("share")).alias("dot"))
    cosines = dots.join(known, "lang").select(id_col, F.round(F.col("dot") / (F.col("norm") * F.col("z")), 9).alias("cosine"))
    cos = F.coalesce("cosine", F.lit(0.0))
    x = cos * 100
    curved = F.least(F.bround(SQUARE * x * x + LINEAR * x + CONSTANT), F.lit(10.0))
    return texts.select(id_col).join(cosines, id_col, "left").select(id_col, cos.alias("cosine"), F.bround(F.floor(x) / 10).alias("rating"), F.when(x < LOWEST, 0.0).otherwise(curved).alias("rating_quadratic"))


def rated_by_own_language(texts: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``text_ratings`` against profiles of the same texts; the profiles are a written table, so Spark knows their size."""
    return text_ratings(texts, written(language_profiles(texts, lang_col, text_col)), id_col, lang_col, text_col)
