"""Registered queries of the operators, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import automaton, decontamination, filter_audit, lexical_search, lines, lm_scoring, packing, quality, secret_scan, sharding, simhash, token_counts, token_output


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(f):
    return lambda spark, sf_dir: f(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": _on_documents(quality.quality_query),
    "op2_simhash": _on_documents(simhash.simhash_query),
    "op3_best_fit_packing": _on_documents(lambda d: packing.pack(d, tokenizer_path())),
    "op4_sharding": _on_documents(sharding.sharding_query),
    "op5_decontamination": lambda spark, sf_dir: decontamination.decontamination_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
    "op6_secret_scan": _on_documents(secret_scan.secrets),
    "op7_lm_scoring": _on_documents(lm_scoring.lm_query),
    "op8_token_counts": _on_documents(lambda d: token_counts.token_counts(d, tokenizer_path())),
    "op9_token_output": _on_documents(lambda d: token_output.packed_ids(d, tokenizer_path())),
    "op10_line_dedup": _on_documents(lines.lines_query),
    "op11_bpe_automaton": _on_documents(lambda d: automaton.automaton_query(d, tokenizer_path())),
    "op12_filter_audit": lambda spark, sf_dir: filter_audit.audit_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
    "op13_lexical_search": lambda spark, sf_dir: lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
}
ORACLES = {"op1_quality_rules": quality.SQL, "op5_decontamination": decontamination.SQL, "op10_line_dedup": lines.SQL, "op12_filter_audit": filter_audit.SQL, "op13_lexical_search": lexical_search.SQL}
