"""Uniform sharding by a hypergeometric communication matrix.

Entry (b, s) of the matrix says how many rows of block b (a partition of the input) go to shard s. It
is drawn so that every row sum is the block's size and every column sum the shard's size, with the
law that a uniform permutation of all rows would give. Each block permutes its rows locally and deals
them out by its row of the matrix, one exchange brings them to their shards, and each shard permutes
again: a uniform shuffle with exact shard sizes, in one exchange of the rows.

A shard of many rows is permuted in cells, ranges of the random keys that it sorts by: a row's cell
is known before the exchange, so the cells' sizes are counted first and a cell's slots follow those of the
cells before it. So the number of tasks grows with the rows and not with the shards.

Everything on the rows is DataFrame operations; the driver draws the matrix, which has
MAX_ENTRIES entries at most, whatever the input: beyond, blocks are several partitions each.

Rows: nulls in any column, repeated rows and empty texts are rows like any other, as a row's
key is its place in its block; an empty table gives an empty table. Columns of the input named
shard or slot are replaced.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import read_table, written

#: Entries of the matrix: 32 MB when sent to each executor, and the driver's work.
MAX_ENTRIES = 4_000_000
#: Rows that one task of the last permutation sorts, on average.
CELL_ROWS = 200_000


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Marked rows among so many drawn without replacement, by inversion outwards from the mode."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    u, up, down, k_up, k_down = rng.random() - p, p, p, mode, mode
    while u > 0 and (k_up < high or k_down > low):
        if k_up < high:
            up *= (good - k_up) * (drawn - k_up) / ((k_up + 1) * (bad - drawn + k_up + 1))
            k_up += 1
            u -= up
            if u <= 0:
                return k_up
        if k_down > low:
            down *= k_down * (bad - drawn + k_down) / ((good - k_down + 1) * (drawn - k_down + 1))
            k_down -= 1
            u -= down
            if u <= 0:
                return k_down
    return mode


def communication_matrix(blocks: list[int], cells: list[int], rng: random.Random) -> list[list[int]]:
    """Counts of rows from each block to each cell; both sums are as given."""
    left, matrix = list(cells), []
    for rows in blocks:
        counts, rest = [], sum(left)
        for j, room in enumerate(left):
            n = hypergeometric(rng, room, rest - room, rows)
            counts.append(n)
            rest -= room
            rows -= n
            left[j] -= n
        matrix.append(counts)
    return matrix


def split_evenly(n: int, parts: int) -> list[int]:
    """Sizes at most one apart."""
    return [n * (k + 1) // parts - n * k // parts for k in range(parts)]


def hypergeometric_shuffle(spark: SparkSession, docs: DataFrame, n_shards: int, seed: int = 42, cell_rows: int = CELL_ROWS, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """All rows and columns of docs, with shard and slot: the place in a uniform permutation.

    Shard sizes are at most one apart, slots are gapless from 0. The rows are
    written once with their blocks and places, and counted and dealt from there, as another scan could cut other blocks.
    """
    rows = docs.drop("shard", "slot").coalesce(max(1, max_entries // n_shards))
    ids = {"__block": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}
    permuted = rows.withColumns(ids).withColumn("__key", F.xxhash64(F.lit(seed), F.col("__row"))).sortWithinPartitions("__key", "__row")
    placed = written(spark, permuted.withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop("__key"), "placed")
    counts = {r[0]: r[1] for r in placed.groupBy("__block").count().collect()}
    blocks, total = sorted(counts), sum(counts.values())
    matrix = communication_matrix([counts[b] for b in blocks], split_evenly(total, n_shards), random.Random(seed))

    def literal(x, kind: str):
        return F.from_json(F.lit(json.dumps(x)), kind)

    bounds = [list(accumulate(counts_b)) for counts_b in matrix]
    # One row for each block, MAX_ENTRIES numbers in all: a proven bound for the broadcast.
    lookup = spark.range(1).select(F.posexplode(literal(bounds, "array<array<bigint>>")).alias("at", "__bounds"), literal(blocks, "array<int>").alias("blocks")).select(F.element_at("blocks", F.col("at") + 1).alias("__block"), "__bounds")
    parts = max(1, -(-total // (n_shards * cell_rows)))
    key = F.xxhash64(F.lit(seed + 1), F.col("__row"))
    # The key's upper bits, as a share of the parts: cells are ranges of keys.
    cell = F.col("shard") * parts + F.shiftrightunsigned(F.shiftrightunsigned(key, 33) * parts, 31).cast("int")
    dealt = placed.join(F.broadcast(lookup), "__block").withColumn("shard", _cell_of(F.col("__bounds"), F.col("__place"), n_shards)).drop("__bounds", "__place", "__block")
    keyed = dealt.withColumns({"__key": F.shiftrightunsigned(key, 1), "__cell": cell})
    # One row for each CELL_ROWS rows or each shard: 1 MB for ten billion rows.
    sizes = keyed.groupBy("shard", "__cell").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(F.col("__cell").alias("__c"), before.alias("__first"))
    again = keyed.repartitionById(n_shards * parts, F.col("__cell")).sortWithinPartitions("__cell", "__key", "__row")
    slotted = again.withColumn("slot", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).join(F.broadcast(firsts), F.col("__cell") == F.col("__c"))
    return slotted.withColumn("slot", F.col("slot") + F.col("__first")).drop("__cell", "__key", "__row", "__c", "__first")


def _cell_of(bounds: Column, place: Column, n: int) -> Column:
    """The first shard whose bound is over the place: a binary search."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        left = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        right = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.get(bounds, mid) > place, left).otherwise(right)

    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi")), halve, lambda s: s["lo"])


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hypergeometric_shuffle(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
