"""Incremental ingest as streams: skip what is done, space out what goes to one site."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_keys(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; later ones are dropped and the state is bounded."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, ledger_path: str, checkpoint: str, key: str, handle: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Handles the rows of each micro-batch whose key isn't in the ledger, and appends their status.

    handle: rows to (key, status, reason). A batch that is run again finds its keys done.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        try:
            done = spark.read.parquet(ledger_path).where("status = 'success'").select(F.col("key").alias("__done")).distinct()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = spark.createDataFrame([], "__done string")
        fresh = batch.dropDuplicates([key]).join(done, F.col(key) == F.col("__done"), "left_anti")
        handle(fresh).select("key", "status", "reason", F.current_timestamp().alias("ts")).write.mode("append").parquet(ledger_path)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spaced(stream: DataFrame, site: str, item: str, at: str, gap_s: float = 2.0) -> DataFrame:
    """(site, item, start_s): when each item may start, in order of arrival, items of a site so far apart. Nothing sleeps."""
    kind = stream.schema[site].dataType.simpleString()

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (float("-inf"),)
        rows = pd.concat(list(frames)).sort_values(["at_s", "item"])
        out = []
        for t, x in zip(rows["at_s"], rows["item"], strict=True):
            last = max(float(t), last + gap_s)
            out.append((key[0], x, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["site", "item", "start_s"])

    timed = stream.select(F.col(site).alias("site"), F.col(item).cast("string").alias("item"), F.col(at).cast("double").alias("at_s"))
    return timed.groupBy("site").applyInPandasWithState(decide, f"site {kind}, item string, start_s double", "last double", "append", GroupStateTimeout.NoTimeout)
