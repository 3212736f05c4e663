"""Inverted index: one written table of postings, term statistics as DataFrames over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import clean_tokens, cumulative_ngrams, let
from docloom.sources.tables import written


def term_counts(words: Column) -> Column:
    """array<struct<term, tf>> of a row's words, counted inside the row: sorted, cut where the word changes."""
    starts = lambda t: F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1) != x), i)), lambda i: i.isNotNull())
    ends = lambda t, b: lambda s, k: F.struct(F.get(t, s).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(t)) - s).cast("long").alias("tf"))
    return let(F.sort_array(words), lambda t: let(starts(t), lambda b: F.transform(b, ends(t, b))))


def postings(docs: DataFrame, id_col: str, text: str = "text", ngram: int = 1, tokens: Column | None = None, weight: Column | None = None, unique: bool = False) -> DataFrame:
    """(id, term, tf, dl, maxtf). ``dl`` counts all terms of the document, ``maxtf`` is its largest count.

    ``unique`` states that every row has an id of its own: then nothing is shuffled, each row counts its own terms.
    Otherwise several rows may share an id (fields) and only ids with words and counts are, summed before they move;
    ``weight`` is what a term of a row counts. ``tokens`` replaces the clean words of ``text``.
    """
    words = cumulative_ngrams(clean_tokens(F.col(text)), ngram) if tokens is None else tokens
    if unique and weight is None:
        counted = docs.select(id_col, F.inline(F.array(F.struct(term_counts(words).alias("terms")))))
        sums = F.aggregate("terms", F.struct(F.lit(0).cast("long").alias("dl"), F.lit(0).cast("long").alias("top")), lambda s, x: F.struct((s["dl"] + x["tf"]).alias("dl"), F.greatest(s["top"], x["tf"]).alias("top")))
        counted = counted.select(id_col, "terms", F.inline(F.array(sums)))
        return counted.select(id_col, F.inline("terms"), F.col("dl"), F.col("top").alias("maxtf")).select(id_col, "term", "tf", "dl", "maxtf")
    terms = docs.select(id_col, (F.lit(1) if weight is None else weight).alias("n"), F.explode(words).alias("term"))
    doc = W.partitionBy(id_col)
    return terms.groupBy(id_col, "term").agg(F.sum("n").alias("tf")).withColumns({"dl": F.sum("tf").over(doc), "maxtf": F.max("tf").over(doc)})


@dataclass
class TermIndex:
    """``postings`` is stored, of a built index ``terms`` and ``size`` as well; ``kept`` holds what scorers derive once an index and write (norms)."""

    postings: DataFrame  # doc_id, term, tf, dl, maxtf
    terms: DataFrame  # term, df
    size: DataFrame  # n_docs, avgdl (one row)
    kept: dict[tuple, DataFrame] = field(default_factory=dict)

    @classmethod
    def build(cls, docs: DataFrame, ngram: int = 1, min_df: int = 1, max_df: float = 1.0, tokens: Column | None = None, unique: bool = True) -> TermIndex:
        """``unique``: no two rows share a doc_id."""
        index = cls.over(written(postings(docs, "doc_id", ngram=ngram, tokens=tokens, unique=unique)), docs, min_df, max_df)
        index.size = written(index.size)
        index.terms = written(index.terms)
        return index

    @classmethod
    def over(cls, stored: DataFrame, docs: DataFrame, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> TermIndex:
        """The index of postings that are stored already; terms outside the bounds leave the vocabulary, and of the rest those beyond the ``max_features`` most frequent."""
        size = docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(stored.agg(F.sum("tf").alias("total"))).select("n_docs", (F.col("total") / F.col("n_docs")).alias("avgdl"))  # one row each
        terms = stored.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        if min_df > 1 or max_df < 1:
            terms = terms.crossJoin(F.broadcast(size.select("n_docs"))).filter((F.col("df") >= min_df) & (F.col("df") <= F.floor(F.col("n_docs") * max_df))).drop("n_docs")
        if max_features:
            terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
        return cls(stored, terms.drop("total"), size)
