"""Names without collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.graph import cut_lineage, numbered

#: How a name gets its number: pattern, and the number of the second one.
STYLES = {"copy": ("{stem} ({n}){ext}", 1), "index": ("{stem}({n}){ext}", 0), "encoded": ("{stem}_encoded_{n}{ext}", 2), "plain": ("{stem}_{n}{ext}", 2)}


def _formatted(style: str, stem: Column, ext: Column, n: Column) -> Column:
    parts = {"stem": stem, "ext": ext, "n": n.cast("string")}
    out, rest = [], STYLES[style][0]
    while rest:
        head, _, tail = rest.partition("{")
        if head:
            out.append(F.lit(head))
        name, _, rest = tail.partition("}")
        if name:
            out.append(parts[name])
    return F.concat(*out)


def without_collisions(df: DataFrame, folder: str, stem: str, ext: str, order: list[str], style: str = "plain", taken: DataFrame | None = None) -> DataFrame:
    """df with target: the first of a name keeps it, the others get numbers; names compare in lower case.

    taken: (folder, name) that are there already. Each round numbers what still collides from the next
    free number on, until nothing does.
    """
    own = df.withColumn("__ord", F.row_number().over(Window.partitionBy(folder).orderBy(*order)))
    key = lambda c: F.lower(c)
    start = STYLES[style][1]
    wanted = Window.partitionBy(folder, key(F.concat(stem, ext))).orderBy("__ord")
    own = own.withColumn("__n", F.row_number().over(wanted) - 1)
    used = taken.select(F.col(folder).alias("__f"), key(F.col("name")).alias("__name"), F.lit(True).alias("__taken")).distinct() if taken is not None else None
    while True:
        name = F.when(F.col("__n") == 0, F.concat(stem, ext)).otherwise(_formatted(style, F.col(stem), F.col(ext), F.col("__n") - 1 + start))
        named = own.withColumn("target", name)
        first = F.row_number().over(Window.partitionBy(folder, key(F.col("target"))).orderBy("__n", "__ord")) == 1
        told = named.withColumn("__first", first)
        if used is not None:
            told = told.join(used, (told[folder] == F.col("__f")) & (key(F.col("target")) == F.col("__name")), "left").withColumn("__clash", F.coalesce("__taken", F.lit(False))).drop("__f", "__name", "__taken")
        else:
            told = told.withColumn("__clash", F.lit(False))
        told = cut_lineage(df.sparkSession, told.withColumn("__again", ~F.col("__first") | F.col("__clash")))
        if told.where("__again").isEmpty():
            return told.drop("__ord", "__n", "__first", "__clash", "__again")
        step = F.when(F.col("__again"), F.col("__n") + 1).otherwise(F.col("__n"))
        own = told.withColumn("__n", step).drop("target", "__first", "__clash", "__again")


def prefixed_on_collision(df: DataFrame, name: str, parents: str, order: list[str]) -> DataFrame:
    """df with target: the plain name; parent__name for the second; numbered after that."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    with_parents = F.concat(F.regexp_replace(parents, "[/\\\\]+", "__"), F.lit("__"), F.col(name))
    again = F.row_number().over(Window.partitionBy(F.lower("__p")).orderBy(*order))
    told = df.withColumn("__n", n).withColumn("__p", F.when(F.col("__n") == 1, F.col(name)).otherwise(with_parents)).withColumn("__m", again)
    return told.withColumn("target", F.when(F.col("__m") == 1, F.col("__p")).otherwise(F.concat("__p", F.lit("_"), F.col("__m").cast("string")))).drop("__n", "__p", "__m")


def file_register(nodes: DataFrame, order: list[str], shown: int = 100) -> DataFrame:
    """nodes with file_id in order of discovery and the last characters of the name."""
    told = numbered(nodes, [F.col(c) for c in order], "file_id")
    return told.withColumn("file_id", F.col("file_id") - 1).withColumn("shown", F.right("name", F.lit(shown)))
