"""Sinks: reports, exports and ledgers. Writers are Spark's, whose commits are atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.formatting import duration_clock, size_catalog


def pair_export(pairs: DataFrame) -> DataFrame:
    """Duplicate pairs as they are shown: sizes and durations as text."""
    size = lambda c: size_catalog(F.col(c))
    return pairs.select(
        "original", "duplicate", size("original_size").alias("original_size"), size("duplicate_size").alias("duplicate_size"),
        F.concat_ws("x", "original_width", "original_height").alias("original_resolution"), F.concat_ws("x", "duplicate_width", "duplicate_height").alias("duplicate_resolution"),
        F.format_string("%.2f%%", "similarity").alias("similarity"), duration_clock(F.abs("offset_s")).alias("offset"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_ledger(entries: DataFrame, path: str) -> None:
    """Appends (key, status, reason, ts); readers take the latest entry of each key."""
    entries.select("key", "status", "reason", "ts").write.mode("append").parquet(path)


def append_lines(lines: DataFrame, path: str) -> None:
    lines.select(F.col("line").alias("value")).write.mode("append").text(path)


def write_srt(documents: DataFrame, path: str) -> None:
    documents.select(F.col("srt").alias("value")).write.mode("overwrite").option("lineSep", "").text(path)
