"""Connected components by alternating stars."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut_lineage(spark: SparkSession, df: DataFrame) -> DataFrame:
    """checkpoint() in the folder of spark.checkpoint.dir; in one of our own where that is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="brindle-"))
    return df.checkpoint()


def _star(edges: DataFrame) -> DataFrame:
    """One large star, then one small star: every node moves to the smallest node that it sees."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(spark: SparkSession, edges: DataFrame, a: str | Column = "a", b: str | Column = "b") -> DataFrame:
    """(node, component) for every node of an edge that joins two nodes; component: its smallest node.

    Needs a logarithmic number of rounds, each with shuffles on nodes and partial aggregates. A
    node with very many neighbours only meets the join, which Spark can split. Null ends and
    loops are ignored.
    """
    pair = edges.select((F.col(a) if isinstance(a, str) else a).alias("a"), (F.col(b) if isinstance(b, str) else b).alias("b"))
    now = cut_lineage(spark, pair.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        now = cut_lineage(spark, _star(now))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with places from 1 in the order: sorted in ranges, numbered in each, with what the ranges before hold."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut_lineage(spark, ranged.withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("__range").count()  # a row for each range
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))
    return placed.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__range", "__place", "__before")
