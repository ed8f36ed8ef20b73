"""The registered queries of the ten operators and the pipeline, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, decontaminate, infill, language_id, lexical_search, lm_scoring, minhash_dedup, quality_rules, substring_dedup, suffix_dedup, toxicity, url_filters, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": minhash_dedup.op1_minhash_near_dedup,
        "op2_language_id": language_id.op2_language_id,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_adaptive_quality": quality_rules.op6_adaptive_quality,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_lm_score": lm_scoring.op8_lm_score,
        "op9_url_filter": url_filters.op9_url_filter,
        "op10_warc_round_trip": warc.op10_warc_round_trip,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_fill_in_middle": infill.op12_fill_in_middle,
        "op13_substring_dedup": substring_dedup.op13_substring_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_decontaminate": decontaminate.OP5_SQL,
        "op9_url_filter": url_filters.OP9_SQL,
        "op10_warc_round_trip": warc.OP10_SQL,
        "op11_lexical_search": lexical_search.OP11_SQL,
        "op12_fill_in_middle": infill.OP12_SQL,
        "op13_substring_dedup": substring_dedup.OP13_SQL,
    }
