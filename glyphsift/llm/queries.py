"""One query per training-data operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language_id, license_scan, mixing, order_minhash, quality, simhash, suffix_dedup, token_files, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": suffix_dedup.query,
        "op2_order_minhash": order_minhash.query,
        "op3_quality_rules": quality.query,
        "op4_mixing": mixing.query,
        "op5_url_filter": url_filter.query,
        "op6_simhash": simhash.query,
        "op7_token_files": token_files.query,
        "op8_language_id": language_id.query,
        "op9_license_scan": license_scan.query,
        "op10_bpe": bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.SQL, "op5_url_filter": url_filter.SQL}
