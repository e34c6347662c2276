"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import exact_dedup, langid, line_dedup, lm, mixing, outliers, pieces, quality, simhash, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_sentencepiece": pieces.query,
        "op3_simhash_near_dedup": simhash.query,
        "op4_source_mixing": mixing.query,
        "op5_warc": warc.query,
        "op6_language_id": langid.query,
        "op7_line_dedup": line_dedup.query,
        "op8_lm_scoring": lm.query,
        "op9_quality_classifier": quality.query,
        "op10_quality_rules": outliers.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op5_warc": warc.SQL, "op7_line_dedup": line_dedup.SQL}
