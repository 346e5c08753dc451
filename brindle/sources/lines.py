"""Text sources: lists of lines, records with passwords, subtitle lines with their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.binary import decode_text


def line_set(spark: SparkSession, path: str) -> DataFrame:
    """(line): the different trimmed lines that aren't empty."""
    return distinct_lines(spark.read.text(path))


def distinct_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.trim(column).alias("line")).where("line != ''").distinct()


def links_with_passwords(spark: SparkSession, path: str) -> DataFrame:
    """(url, password): a password may follow after a space."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, 0).alias("url"), F.get(parts, 1).alias("password"))


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line) of whole files in any of the usual encodings."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decode_text(F.col("content")).alias("text"))
    return files.select("file", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("ord", "line"))
