"""The queries of this package by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm import debruijn, decontaminate, license_scan, mixture, near_vectors, ngram_join, periodic_runs, privacy, quality, suffix_dedup, token_align, token_output, toxicity
from llm.oracles import ORACLE_SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_token_output": token_output.op2_token_output,
    "op3_pii": privacy.op3_pii,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_embedding_near_dedup": near_vectors.op5_embedding_near_dedup,
    "op6_mixing_sources": mixture.op6_mixing_sources,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_substring_dedup": debruijn.op9_substring_dedup,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_license_scans": license_scan.op11_license_scans,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_token_alignment": token_align.op13_token_alignment,
}
