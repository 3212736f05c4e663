"""Incremental index (an extension): new documents append their postings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.index import postings


def append_postings(docs: DataFrame, path: str, checkpoint: str, ngram: int = 1) -> StreamingQuery:
    """Write the postings of a stream of documents (each arriving once) below ``path``, a folder per batch.

    A batch that is retried overwrites its own folder, so each document is indexed exactly once. Term
    statistics are taken over all folders when the index is opened (``TermIndex.over``).
    """

    def one(batch: DataFrame, number: int) -> None:
        postings(batch, "doc_id", ngram=ngram).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
