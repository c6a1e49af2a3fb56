"""Queries of this subpackage for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, leaks, licences, lines, near, pii, quality, secrets, substrings, token_counts
from .common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lambda spark, d: lines.op1(documents(spark, d)),
        "op2_secret_scan": lambda spark, d: secrets.op2(documents(spark, d)),
        "op3_minhash_near_dedup": lambda spark, d: near.op3(documents(spark, d)),
        "op4_byte_bpe": lambda spark, d: bpe.op4(documents(spark, d)),
        "op5_decontamination": lambda spark, d: leaks.op5(documents(spark, d), documents(spark, d, "benchmark")),
        "op6_token_counts": lambda spark, d: token_counts.op6(documents(spark, d)),
        "op7_licence_scan": lambda spark, d: licences.op7(documents(spark, d)),
        "op8_pii": lambda spark, d: pii.op8(documents(spark, d)),
        "op9_suffix_dedup": lambda spark, d: substrings.op9(documents(spark, d)),
        "op10_quality_rules": lambda spark, d: quality.op10(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": lines.SQL,
        "op2_secret_scan": secrets.SQL,
        "op3_minhash_near_dedup": near.SQL,
        "op5_decontamination": leaks.SQL,
        "op9_suffix_dedup": substrings.SQL,
        "op10_quality_rules": quality.SQL,
    }
