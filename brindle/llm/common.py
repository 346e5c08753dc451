"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is unset (tests, a laptop) a temporary folder takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="brindle-"))
    return (configured or context.getCheckpointDir()).rstrip("/")


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows to a table in the shared folder and read them back.

    Columns can be pruned on reading, and a lost executor costs nothing already written.
    """
    path = f"{shared_dir(spark)}/brindle-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession, units: float, per_partition: float, most: int = 1 << 20) -> int:
    """Partitions for so many units: the session's number at least, more as the input grows."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(min(most, max(least, -(-units // per_partition))))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
