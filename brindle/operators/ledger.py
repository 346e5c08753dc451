"""Ledgers of what is done, caches and their validity, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 2


def pending(items: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Items whose key isn't done."""
    return items.join(done.select(*on).distinct(), on, "left_anti")


def latest_status(ledger: DataFrame, key: str, at: str) -> DataFrame:
    """(key, status): the last entry of each key; a success counts over all else."""
    rank = F.struct((F.col("status") == "success").alias("done"), F.col(at).alias("at"), F.col("status").alias("status"))
    return ledger.groupBy(key).agg(F.max(rank)["status"].alias("status"))


def cache_state(files: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """(key, state) of files (key, file_size, mtime_ns, fast_sig) against the cache: hit, miss, or why it is stale."""
    c = cache.select(F.col(key), *(F.col(x).alias(f"c_{x}") for x in ("file_size", "mtime_ns", "fast_sig", "schema_version", "hashes")))
    near = F.abs(F.col("mtime_ns") - F.col("c_mtime_ns")) <= 2_000_000_000
    same = F.when(F.col("c_fast_sig").isNotNull(), F.col("fast_sig").eqNullSafe(F.col("c_fast_sig"))).otherwise(F.coalesce(near, F.lit(False)))
    state = (
        F.when(F.col("c_file_size").isNull(), "miss").when(F.col("c_file_size") != F.col("file_size"), "size_changed").when(F.coalesce(F.col("c_schema_version"), F.lit(0)) != SCHEMA_VERSION, "schema_changed")
        .when(~same, "content_changed").when(F.coalesce(F.size("c_hashes"), F.lit(0)) <= 0, "no_payload").otherwise("hit")
    )
    return files.join(c, key, "left").select(key, state.alias("state"))


def upserted(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """cache with new's rows in place of its own of the same key: a snapshot to write."""
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def stale(cache: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return cache.join(valid.select(key).distinct(), key, "left_anti")


def queued(items: DataFrame, key: str, order: str) -> DataFrame:
    """items with added: true for the first of each key."""
    return items.withColumn("added", F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1)


def collected_late(results: DataFrame, late: DataFrame, key: str) -> DataFrame:
    """results, and of the late ones those whose key isn't there yet."""
    return results.unionByName(late.join(results.select(key), key, "left_anti"))


def symmetric_distinct(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row for each unordered pair."""
    return pairs.withColumn("__p", F.array_sort(F.array(a, b))).dropDuplicates(["__p"]).drop("__p")


def deltas(at: Column, by: list[str], order: str, wait_s: float) -> Column:
    """Seconds to wait so that items of a key are so far apart."""
    gap = at.cast("double") - F.lag(at.cast("double")).over(Window.partitionBy(*by).orderBy(order))
    return F.greatest(F.lit(0.0), wait_s - F.coalesce(gap, F.lit(float(wait_s))))


def open_failures(entries: DataFrame, key: str) -> DataFrame:
    """Failed entries whose key has no success."""
    done = entries.where("status = 'success'").select(key).distinct()
    return entries.where("status = 'failed'").join(done, key, "left_anti")


def chosen(items: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted items; all if none is wanted."""
    return items if wanted.isEmpty() else items.join(wanted.select(key).distinct(), key, "left_semi")


def prepared(paths: DataFrame, path: str, folded: Column) -> DataFrame:
    """One row for each path as it compares, the first by code point, in order."""
    return paths.groupBy(folded.alias("__folded")).agg(F.min(path).alias(path)).orderBy("__folded").select(path)


def with_new(listed: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """A sorted list of different values with new ones put in."""
    return listed.select(column).unionByName(new.select(column)).distinct().orderBy(column)


def distinct_orders(df: DataFrame, items: str) -> DataFrame:
    """One row for each set of items, whatever their order: the least order."""
    return df.groupBy(F.array_sort(items).alias("__set")).agg(F.min(items).alias(items)).select(items)
