"""Queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, fingerprints, jaccard_join, language_model, licenses, oracles, packing, quality, quality_trees, spelling
from tessella.llm import substrings, toxicity, url_filters, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_packing": packing.op2_packing,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_substring_dedup": substrings.op5_substring_dedup,
        "op6_lm_scoring": language_model.op6_lm_scoring,
        "op7_bpe": bpe.op7_bpe,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_url_filters": url_filters.op9_url_filters,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_quality_trees": quality_trees.op11_quality_trees,
        "op12_whitening": whitening.op12_whitening,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
