"""A session with the settings that the library is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "brindle", **settings: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | settings
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
