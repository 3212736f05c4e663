"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proven before any text is read (``ByteBPE.whole``);
a pre-token found there counts 1, only the rest are merged. One Arrow pass over the scan, no shuffle.

Defined results: a null text counts as empty (0 bytes, 0 tokens, not over the limit). Special strings
inside a text count one token each, as the library does by default. Repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bpe import Counter, loaded, shipped
from docloom.llm.common import small_batches


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit); ``tokenizer`` is the path of a byte-level BPE definition."""
    spark = docs.sparkSession
    small_batches(spark)
    definition = shipped(spark, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(loaded(definition.value))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean")
