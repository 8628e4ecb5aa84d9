"""Queries of the subpackage, op1 to op13, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codebooks, decontamination, jaccard_join, language, lm_scoring, media, packing, quality, secrets, toxicity, url_filter, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": lm_scoring.op1_lm_scoring,
        "op2_jaccard_join": jaccard_join.op2_jaccard_join,
        "op3_secrets": secrets.op3_secrets,
        "op4_telephony": media.op4_telephony,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_packing": packing.op6_packing,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_warc": warc.op9_warc,
        "op10_quality": quality.op10_quality,
        "op11_language": language.op11_language,
        "op12_vector_codes": codebooks.op12_vector_codes,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return url_filter.SQL | warc.SQL | codebooks.SQL
