"""Trees of folders, and shortest constrained paths in grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.graph import cut_lineage

LINKING = 3


def expand(spark: SparkSession, nodes: DataFrame, roots: Column) -> DataFrame:
    """(node_id, depth, path, sort_key) of all nodes below the roots, level by level, in pre-order by sort_key.

    nodes: (parent_id, node_id, ord, name). The roots' own names aren't part of the paths. Each level is
    a join of the last level with the edges, to any depth; a node that is its own ancestor is an error.
    """
    edges = nodes.select("parent_id", F.col("node_id").alias("child"), "ord", "name")
    level = nodes.where(roots).select("node_id", F.lit(0).alias("depth"), F.lit("").alias("path"), F.array(F.col("ord").cast("long")).alias("sort_key"), F.array("node_id").alias("__above"))
    out = None
    while True:
        level = cut_lineage(spark, level)
        if level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
        if not level.where(F.array_contains(F.slice("__above", F.lit(1), F.size("__above") - 1), F.col("node_id"))).isEmpty():
            raise ValueError("a node is its own ancestor")
        below = level.withColumnRenamed("node_id", "parent_id").join(edges, "parent_id")
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("/"), "name"))
        level = below.select(F.col("child").alias("node_id"), (F.col("depth") + 1).alias("depth"), path.alias("path"), F.concat("sort_key", F.array(F.col("ord").cast("long"))).alias("sort_key"), F.concat("__above", F.array("child")).alias("__above"))
    return (out if out is not None else level).drop("__above")


def shortest_path(spark: SparkSession, grid: DataFrame, targets: list[list[str]], max_length: int | None = None) -> list[tuple[int, int]] | None:
    """The first shortest path that holds every target in a row, or None.

    grid: (row, col, val). It starts in row 0, then goes by columns and rows in turn and never comes
    back. Paths grow by one cell a round, as rows of a DataFrame; of equally long ones the first in
    the order of starts and moves counts. A round without new paths ends the search, and so does a length
    of max_length: by default the targets one after the other with LINKING moves before each, as any
    cell is at most three moves from any other.
    """
    cells = cut_lineage(spark, grid.select("row", "col", "val"))
    values = {v for t in targets for v in t}
    if cells.where(F.col("val").isin(list(values))).select("val").distinct().count() < len(values):
        return None
    limit = max_length or sum(map(len, targets)) + LINKING * len(targets)
    wanted = [F.concat(F.lit("\x1f"), *(F.lit(v + "\x1f") for v in t)) for t in targets]
    paths = cells.where("row = 0").select("row", "col", F.array(F.struct("row", "col")).alias("path"), F.concat(F.lit("\x1f"), "val", F.lit("\x1f")).alias("vals"))
    step = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("val").alias("v"))
    for length in range(1, limit + 1):
        paths = cut_lineage(spark, paths)
        hit = F.lit(True)
        for t in wanted:
            hit = hit & F.contains("vals", t)
        found = paths.where(hit).agg(F.min("path")).first()[0]
        if found:
            return [tuple(p) for p in found]
        if paths.isEmpty():
            return None
        moved = paths.join(step, F.col("col" if length % 2 else "row") == F.col("c" if length % 2 else "r"))
        fresh = moved.where(~F.array_contains("path", F.struct(F.col("r").alias("row"), F.col("c").alias("col"))))
        paths = fresh.select(F.col("r").alias("row"), F.col("c").alias("col"), F.concat("path", F.array(F.struct(F.col("r").alias("row"), F.col("c").alias("col")))).alias("path"), F.concat("vals", "v", F.lit("\x1f")).alias("vals"))
    return None


def best_targets(spark: SparkSession, grid: DataFrame, targets: list[list[str]]) -> tuple[list[list[str]], list[tuple[int, int]]] | None:
    """The most targets that one path holds, and the path: subsets from large to small, in order."""
    from itertools import combinations

    for k in range(len(targets), 0, -1):
        for chosen in combinations(targets, k):
            if path := shortest_path(spark, grid, list(chosen)):
                return list(chosen), path
    return None
