"""Registered queries of this package: ``opN_<name>`` for each operator and
``pipeline``, with DuckDB text where SQL can express the result."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, fingerprints, hard_negatives, language_id, packing, preferences, quality_rules, source_mix, substring_dedup, suffix_dedup, token_files,
    tree_bpe, trie_join,
)

_FUNCTIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1,
    "op2_preference_format": preferences.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_packing": packing.op4,
    "op5_ngram_jaccard_join": trie_join.op5,
    "op6_source_mix": source_mix.op6,
    "op7_fingerprints": fingerprints.op7,
    "op8_token_files": token_files.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_suffix_array_dedup": suffix_dedup.op10,
    "op11_bpe_codec": tree_bpe.op11,
    "op12_token_alignment": alignment.op12,
    "op13_hard_negatives": hard_negatives.op13,
}

ORACLES: dict[str, str] = {
    "op2_preference_format": preferences.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op5_ngram_jaccard_join": trie_join.ORACLE,
    "op6_source_mix": source_mix.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_suffix_array_dedup": suffix_dedup.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}


def code_path(spark: SparkSession) -> None:
    """Let Python workers that run from another folder import this package."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def _with_code(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        code_path(spark)
        return fn(spark, sf_dir)

    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {name: _with_code(fn) for name, fn in (_FUNCTIONS | {"pipeline": _pipeline}).items()}
