"""Ranking functions over an inverted index. Every scorer returns a run (query_id, doc_id, score).

The query side decides which postings are read: its terms are sent to the index (``hits``), so only
non-zero products are formed. Scores are rounded before anything ranks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.index import TermIndex, postings
from docloom.sources.tables import written

IDF = {
    "smooth": lambda n, df: F.log((n + 1) / (df + 1)) + 1,
    "robertson": lambda n, df: F.log((n - df + 0.5) / (df + 0.5) + 1),
    "minus1": lambda n, df: F.log((n + 1) / (df + 1)),
}
TF = {
    "raw": lambda tf, top: tf.cast("double"),
    "log": lambda tf, top: 1 + F.log(tf),
    "binary": lambda tf, top: F.lit(1.0),
    "augmented": lambda tf, top: 0.5 + 0.5 * tf / top,
    "log1p": lambda tf, top: F.log1p(tf),
    "sublinear": lambda tf, top: F.log(1 + F.log(1 + tf)),
    "saturation": lambda tf, top: tf / (tf + 1.0),
    "pivot": lambda tf, top: (1 + F.log(1 + F.log(tf))) / (1 - 0.3 + 0.3 * F.col("dl") / F.col("avgdl")),
}


def known(index: TermIndex, q: DataFrame) -> DataFrame:
    """Rows of ``q(term, ...)``, a stated query set, whose term the vocabulary holds, with its ``df``; the vocabulary stays where it is."""
    return index.terms.join(F.broadcast(q), "term")


def hits(index: TermIndex, q: DataFrame) -> DataFrame:
    """Postings joined with ``q(query_id, term, ...)``, a stated query set.

    Postings of other terms stay where they are, the rest move once, to their document, before they are joined: what
    is summed by query and document needs no shuffle of the joined rows.
    """
    near = index.postings.join(F.broadcast(q.select("term").distinct()), "term", "left_semi")
    return near.repartition("doc_id").join(F.broadcast(q), "term")


def _bm25(kind: str, tf: Column, norm: Column, k1: float, delta: float) -> Column:
    if kind == "l":
        c = tf / norm
        return (k1 + 1) * (c + delta) / (k1 + c + delta)
    if kind == "plus":  # delta inside the numerator
        return ((k1 + 1) * tf + delta) / (tf + k1 * norm)
    return tf * (k1 + 1) / (tf + k1 * norm)


def bm25(index: TermIndex, queries: DataFrame, kind: str = "okapi", k1: float = 1.2, b: float = 0.75, delta: float = 1.0, idf: str = "robertson", tokens: Column | None = None) -> DataFrame:
    """BM25 (okapi, l, plus) of ``queries(query_id, text)``: distinct query terms, documents with a common term."""
    q = postings(queries, "query_id", tokens=tokens).select("query_id", "term")
    found = hits(index, known(index, q)).crossJoin(F.broadcast(index.size))  # one row
    norm = 1 - b + b * F.col("dl") / F.col("avgdl")
    part = IDF[idf](F.col("n_docs"), F.col("df")) * _bm25(kind, F.col("tf"), norm, k1, delta)
    return found.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def doc_weights(index: TermIndex, scheme: str = "log", idf: str = "smooth") -> DataFrame:
    """(doc_id, term, w): TF-IDF weights of the vocabulary's terms, not normalised."""
    return index.postings.join(index.terms, "term").crossJoin(F.broadcast(index.size)).select("doc_id", "term", _weight(scheme, idf).alias("w"))  # one row


def query_weights(index: TermIndex, queries: DataFrame, scheme: str = "log", idf: str = "smooth", tokens: Column | None = None) -> DataFrame:
    """(query_id, term, df, w) of the query terms in the vocabulary."""
    q = known(index, postings(queries, "query_id", tokens=tokens)).crossJoin(F.broadcast(index.size))  # one row
    return q.select("query_id", "term", "df", _weight(scheme, idf).alias("w"))


def _weight(scheme: str, idf: str) -> Column:
    return TF[scheme](F.col("tf"), F.col("maxtf")) * IDF[idf](F.col("n_docs"), F.col("df"))


def norms(weights: DataFrame, key: str) -> DataFrame:
    return weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(f"norm_{key}"))


def doc_norms(index: TermIndex, scheme: str = "log", idf: str = "smooth") -> DataFrame:
    """(doc_id, norm_doc_id) of the whole index, written once for each index and weighting."""
    key = ("norms", scheme, idf)
    if key not in index.kept:
        index.kept[key] = written(norms(doc_weights(index, scheme, idf), "doc_id"))
    return index.kept[key]


def cosine(index: TermIndex, q: DataFrame, scheme: str = "log", idf: str = "smooth") -> DataFrame:
    """Run of sparse vectors ``q(query_id, term, df, w)``, a stated query set, against the index; zero products are not formed.

    Only the norms, stored with the index, read all postings.
    """
    asked = q.select("query_id", "term", "df", F.col("w").alias("wq")).join(norms(q, "query_id"), "query_id")
    found = hits(index, asked).crossJoin(F.broadcast(index.size))  # one row
    dots = found.groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * _weight(scheme, idf)).alias("dot"), F.first("norm_query_id").alias("norm_query_id"))
    both = dots.join(doc_norms(index, scheme, idf), "doc_id")
    return both.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("norm_doc_id") * F.col("norm_query_id")), 6).alias("score"))


def tfidf(index: TermIndex, queries: DataFrame, scheme: str = "log", idf: str = "smooth", tokens: Column | None = None) -> DataFrame:
    """Cosine of TF-IDF vectors; terms outside the index's vocabulary don't count."""
    return cosine(index, query_weights(index, queries, scheme, idf, tokens), scheme, idf)


def dense_top(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine (query_id, doc_id, score) of every pair of a bounded set ``queries(query_id, v)`` against ``vectors(doc_id, v)``; ``dense.best`` finds the best k without listing all pairs."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = queries.select("query_id", F.col("v").alias("q"), F.sqrt(dot(F.col("v"), F.col("v"))).alias("nq"))
    d = vectors.select("doc_id", "v", F.sqrt(dot(F.col("v"), F.col("v"))).alias("nd"))
    return d.crossJoin(q).select("query_id", "doc_id", F.round(dot(F.col("q"), F.col("v")) / (F.col("nq") * F.col("nd") + 1e-10), 6).alias("score"))  # a stated query set against all rows


def bm25_floor(index: TermIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """BM25 whose idf is ln((n - df + 0.5) / (df + 0.5)); a negative one becomes ``eps`` times the mean over the vocabulary."""
    raw = index.terms.crossJoin(F.broadcast(index.size)).withColumn("idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # one row
    mean = raw.agg(F.avg("idf").alias("mean"))
    q = raw.join(F.broadcast(postings(queries, "query_id").select("query_id", "term", F.col("tf").alias("qtf"))), "term").crossJoin(F.broadcast(mean))  # one row
    found = hits(index, q)
    weight = F.when(F.col("idf") < 0, eps * F.col("mean")).otherwise(F.col("idf"))
    part = F.col("qtf") * weight * _bm25("okapi", F.col("tf"), 1 - b + b * F.col("dl") / F.col("avgdl"), k1, 0.0)
    return found.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
