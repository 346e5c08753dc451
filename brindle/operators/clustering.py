"""Clusters of sorted values, groups of equal ones, keepers of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.graph import numbered


def chained_clusters(df: DataFrame, by: list[str], value: Column, tolerance: float, order: list[str]) -> DataFrame:
    """df with cluster (from 1 within by) and cluster_size: a new one where the gap to the value before is over the tolerance."""
    w = Window.partitionBy(*by).orderBy(value, *order)
    gap = F.when(value - F.lag(value).over(w) <= tolerance, 0).otherwise(1)
    told = df.withColumn("cluster", F.sum(gap).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.withColumn("cluster_size", F.count("*").over(Window.partitionBy(*by, "cluster")))


def anchored_clusters(df: DataFrame, by: list[str], value: str, order: str, tolerance: float) -> DataFrame:
    """(by, value, order, cluster): a new cluster where the value is over the tolerance from the cluster's first.

    An ordered fold over each group: rows arrive sorted and only the open cluster's base is kept, so
    groups of any size stream through.
    """
    import pyarrow as pa

    columns = [*by, value, order]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def fold(batches):
        key = base = None
        cluster = 0
        for batch in batches:
            out = []
            for *k, v in zip(*(batch.column(i).to_pylist() for i in range(len(by) + 1)), strict=True):
                if k != key:
                    key, base, cluster = k, v, 1
                elif v - base > tolerance:
                    base, cluster = v, cluster + 1
                out.append(cluster)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*columns, "cluster"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.where(F.col(value).isNotNull()).select(*columns).repartition(n, *by).sortWithinPartitions(*by, value, order)
    return dealt.mapInArrow(fold, f"{kinds}, cluster long")


def keepers(members: DataFrame, group: str, strategy: list[Column], item: str) -> DataFrame:
    """(group, keeper, members): the greatest by the strategy; ties go to the greatest item."""
    rank = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(strategy)), F.col(item).alias("item"))
    return members.groupBy(group).agg(F.max(rank)["item"].alias("keeper"), F.count("*").alias("members"))


def reclaimable(members: DataFrame, group: str, item: str, size: str, keeper: DataFrame) -> DataFrame:
    """(group, reclaimable): bytes of all members but the keeper."""
    return members.join(keeper, group).groupBy(group).agg(F.sum(F.when(F.col(item) != F.col("keeper"), F.col(size)).otherwise(0)).alias("reclaimable"))


def equal_groups(df: DataFrame, key: Column, item: str, name: Column) -> DataFrame:
    """(key, n, first, number): groups of two and more, numbered by count and then name, descending."""
    groups = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(F.struct(F.col(item).alias("item"), name.alias("name"))).alias("f")).where("n > 1")
    named = groups.select("key", "n", F.col("f.item").alias("first"), F.col("f.name").alias("__name"))
    return numbered(named, [F.desc("n"), F.desc("__name"), F.desc("key")]).drop("__name")


def local_maxima(value: Column, by: list[str], order: list[str], least: float) -> Column:
    """Not under either neighbour and at least so much; beyond the ends is -1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return (value >= F.lag(value, 1, -1.0).over(w)) & (value >= F.lead(value, 1, -1.0).over(w)) & (value >= least)


def top_with_margin(df: DataFrame, by: list[str], value: Column, order: list[str], k: int, margin: float) -> DataFrame:
    """The k greatest of each group, and all within a margin of the greatest."""
    w = Window.partitionBy(*by).orderBy(value.desc(), *order)
    ranked = df.withColumns({"rank": F.row_number().over(w), "best": F.max(value).over(Window.partitionBy(*by))})
    return ranked.where((F.col("rank") <= k) | (value >= F.col("best") - margin)).drop("best")
