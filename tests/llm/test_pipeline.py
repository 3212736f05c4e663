"""The corpus pipeline's stages, each judged on its own input."""

from collections import Counter

import corpus_pipeline as P
from docloom.llm import decontamination, quality
from tests.llm.test_llm import check_packing, jaccard, lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import os

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120").cache()
    seen = [docs]
    for _, f in P.STAGES:
        seen.append(f(spark, seen[-1], SF).cache())
    assert all(d.columns == docs.columns and dict(d.dtypes) == dict(docs.dtypes) for d in seen[:-1])
    good = {r.doc_id for r in quality.quality_query(docs).filter("kept").collect()}
    assert {r.doc_id for r in seen[1].collect()} == good
    assert [r.n_chars for r in seen[2].collect()] == [len(r.text) for r in seen[2].collect()]
    assert Counter(r.n_dropped for r in lines.lines_query(seen[2]).collect()) == {0: seen[2].count()}
    texts = {r.doc_id: r.text for r in seen[2].collect()}
    ids = sorted(texts)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if jaccard(texts[a], texts[b]) >= 0.8]
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id for r in seen[3].collect()} == {i for i in ids if root[i] == i}
    bad = {r.doc_id for r in decontamination.contaminated(seen[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in seen[4].collect()} == {r.doc_id for r in seen[3].collect()} - bad
    library = Tokenizer.from_file(P.tokenizer_path())
    check_packing(seen[5].collect(), [(r.doc_id, r.text) for r in seen[4].collect()], library, 2048)
    assert os.path.isdir(SF) and P.run(spark, SF).count() > 0
