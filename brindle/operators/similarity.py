"""Similarity joins and time-series alignment.

A join on a Hamming radius has no equality to join on. Where the rows have something that partners
must share (a duration band, a group), join on that with `block`; else rows are dealt into a grid of
blocks, so that each task meets a bounded number of rows of either side, and each pair meets
once. The number of blocks follows the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the duplicate search.
BASE_SIMILARITY, PREFILTER_SIMILARITY, RADIUS_FLOOR = 0.85, 0.75, 14
#: Rows of a block of the grid.
GRID_ROWS = 4096
#: The duplicate search: ratio of bands of durations, tasks at most, rows compared with a block at once, pairs and hashes aligned at once.
BAND, SEARCH_TASKS, CHUNK_ROWS, PAIRS, ALIGNED = 1.14, 1000, 64, 20_000, 1 << 20


def prefilter_radius(frames: Column, similarity: float = PREFILTER_SIMILARITY) -> Column:
    """Bits that may differ, more for short series."""
    base = max(round((1 - similarity) * 64), RADIUS_FLOOR)
    return F.least(F.lit(64), F.when(frames < 30, base + 4).when(frames < 90, base + 2).otherwise(base))


def comparable_durations(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(60.0), 0.12 * F.greatest(a, b, F.lit(0.0)))


def rates_differ(a: Column, b: Column) -> Column:
    return F.greatest(a, b) / F.least(a, b) > 1.25


def required_similarity(overlap: Column, base: float = BASE_SIMILARITY) -> Column:
    at_least = lambda x: F.lit(max(base, x))
    return F.when(overlap <= 0, 1.0).when(overlap < 3, at_least(0.995)).when(overlap < 5, at_least(0.97)).when(overlap < 10, at_least(0.92)).otherwise(base)


def effective_fps(fps: Column, max_frames: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.greatest(F.lit(0.001), F.least(fps, max_frames / duration))).otherwise(fps)


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns))


def pairs_in_grid(df: DataFrame, order: str, near: Column, n_rows: int) -> DataFrame:
    """All pairs (a_*, b_*) with a_order < b_order for which `near` holds, in blocks of rows."""
    blocks = max(1, -(-n_rows // GRID_ROWS))
    if blocks == 1:
        return _prefixed(df, "a_").join(_prefixed(df, "b_"), (F.col(f"a_{order}") < F.col(f"b_{order}")) & near)
    own = df.withColumn("__block", F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int"))
    cells = F.sequence(F.lit(0), F.lit(blocks - 1))
    cell = lambda x, y: F.least(x, y) * blocks + F.greatest(x, y)
    left = _prefixed(own, "a_").withColumn("__other", F.explode(cells)).withColumn("__cell", cell(F.col("a___block"), F.col("__other")))
    right = _prefixed(own, "b_").withColumn("__mine", F.explode(cells)).withColumn("__cell", cell(F.col("b___block"), F.col("__mine")))
    same = (F.col("__other") == F.col("b___block")) & (F.col("__mine") == F.col("a___block"))
    joined = left.join(right, (left["__cell"] == right["__cell"]) & same & (F.col(f"a_{order}") < F.col(f"b_{order}")) & near)
    return joined.drop("__cell", "__other", "__mine", "a___block", "b___block")


def hamming_join(df: DataFrame, order: str, hash_column: str, radius: Column | int, block: list[str] | None = None, n_rows: int | None = None) -> DataFrame:
    """Pairs a before b within the radius, which may depend on b's columns (b_*), with their distance."""
    distance = F.bit_count(F.col(f"a_{hash_column}").bitwiseXOR(F.col(f"b_{hash_column}")))
    near = distance <= (F.lit(radius) if isinstance(radius, int) else radius)
    if block:
        same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in block]
        out = _prefixed(df, "a_").join(_prefixed(df, "b_"), [*same, F.col(f"a_{order}") < F.col(f"b_{order}"), near])
    else:
        out = pairs_in_grid(df, order, near, df.count() if n_rows is None else n_rows)
    return out.withColumn("distance", distance)


def banded_join(df: DataFrame, order: str, value: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs a before b (in value, then order) whose values are within the width: an equality join on buckets."""
    by = by or []
    bucket = F.floor(F.col(value) / width)
    a = _prefixed(df, "a_").withColumn("__k", F.floor(F.col(f"a_{value}") / width))
    b = _prefixed(df.withColumn("__b", bucket), "b_").withColumn("__k", F.explode(F.array(F.col("b___b"), F.col("b___b") - 1)))
    before = (F.col(f"a_{value}") < F.col(f"b_{value}")) | ((F.col(f"a_{value}") == F.col(f"b_{value}")) & (F.col(f"a_{order}") < F.col(f"b_{order}")))
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in by]
    joined = a.join(b, [a["__k"] == b["__k"], *same, before, F.col(f"b_{value}") - F.col(f"a_{value}") <= width])
    return joined.drop("__k", "b___b")


def similarity_of(a: Column, b: Column, bits: int = 64) -> Column:
    """1 less the share of differing bits of two equally long arrays; 0 for empty ones."""
    n = F.size(a)
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, 1 - differing / (n * float(bits))).otherwise(0.0)


def best_shift(a: Column, b: Column, min_overlap: int = 1, max_offset: int = 600, bits: int = 64) -> Column:
    """struct(similarity, overlap, offset) of the best alignment over all offsets.

    Higher similarity first, then more overlap, then the smaller absolute offset, then the smaller one.
    """
    la, lb = F.size(a), F.size(b)
    m = F.greatest(F.lit(1), F.least(F.lit(min_overlap), la, lb))
    offsets = F.sequence(F.greatest(m - la, F.lit(-max_offset)), F.least(lb - m, F.lit(max_offset)))

    def at(o: Column) -> Column:
        i, j = F.greatest(F.lit(0), -o), F.greatest(F.lit(0), o)
        n = F.least(la - i, lb - j)
        s = similarity_of(F.slice(a, i + 1, n), F.slice(b, j + 1, n), bits)
        return F.struct(F.round(s * 1e12).cast("long").alias("rank"), n.alias("overlap"), (-F.abs(o)).alias("near"), (-o).alias("back"), s.alias("similarity"))

    best = F.when((la > 0) & (lb > 0), F.array_max(F.transform(offsets, at)))
    return F.struct(best["similarity"].alias("similarity"), best["overlap"].alias("overlap"), (-best["back"]).alias("offset"))


def majority_bits(hashes: Column) -> Column:
    """Bits set in over half of the hashes of an array; 0 for an empty one."""
    n = F.size(hashes)
    bit = lambda h, i: F.call_function("shiftrightunsigned", h, i).bitwiseAND(1)
    set_in = lambda i: F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + bit(h, i))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda out, i: F.when(set_in(i) * 2 > n, out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(out))


def consensus_hash(df: DataFrame, by: str, hash_column: str) -> DataFrame:
    """(by, n, consensus): for each group the bits set in over half of its hashes, by partial sums."""
    h = F.col(hash_column)
    sums = [F.sum(F.call_function("shiftrightunsigned", h, F.lit(i)).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]
    counted = df.groupBy(by).agg(F.count(hash_column).alias("n"), *sums)
    out = F.lit(0).cast("long")
    for i in range(64):
        out = out.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return counted.select(by, "n", out.alias("consensus"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of lists: where each begins, its length (0 for null), all values as unsigned, and whether they are null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = np.asarray(column.offsets, np.int64)[:-1]
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    null = np.asarray(pc.is_null(column.values), bool)
    values = np.asarray(pc.fill_null(column.values, 0)).astype(np.int64).view(np.uint64)
    return starts, sizes, values, null


def best_shifts(hashes: pa.Array, a: np.ndarray, b: np.ndarray, min_overlap: int = 1, max_offset: int = 600, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What best_shift says of the rows a and b of an array of lists: similarity (NaN for null), overlap, offset.

    Pairs with the same lengths are aligned together, an offset at a time.
    """
    return _aligned(_lists(hashes), a, b, min_overlap, max_offset, bits)


def _aligned(lists: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, min_overlap: int, max_offset: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, sizes, values, null = lists
    broken_any = bool(null.any())
    similarity, overlap, offset = np.full(len(a), np.nan), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    shape = sizes[a] << 32 | sizes[b]
    order = np.argsort(shape, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1) if len(a) else []:
        la, lb = int(sizes[a[rows[0]]]), int(sizes[b[rows[0]]])
        if not la or not lb:
            continue
        m = max(1, min(min_overlap, la, lb))
        for part in np.array_split(rows, -(-len(rows) * (la + lb) // ALIGNED)):
            ia, ib = starts[a[part]] + np.arange(la)[:, None], starts[b[part]] + np.arange(lb)[:, None]
            x, y = values[ia], values[ib]
            gone = (null[ia], null[ib]) if broken_any else None
            best = np.full(len(part), -(1 << 62), np.int64)
            for o in sorted(range(max(m - la, -max_offset), min(lb - m, max_offset) + 1), key=lambda o: (abs(o), o)):
                i, j = max(0, -o), max(0, o)
                n = min(la - i, lb - j)
                s = 1 - np.bitwise_count(x[i : i + n] ^ y[j : j + n]).sum(axis=0, dtype=np.int64) / (n * float(bits))
                rank = np.floor(s * 1e12 + 0.5).astype(np.int64)
                if gone:
                    broken = (gone[0][i : i + n] | gone[1][j : j + n]).any(axis=0)
                    s[broken], rank[broken] = np.nan, -(1 << 62) + 1
                # from the nearest offset on, so that equal rank and overlap keep what was found first
                better = (rank > best) | ((rank == best) & (n > overlap[part]))
                best[better] = rank[better]
                similarity[part[better]], overlap[part[better]], offset[part[better]] = s[better], n, o
    return similarity, overlap, offset


def _marked(mask: np.ndarray) -> np.ndarray:
    """Where a flat mask of a multiple of eight bytes is set, by eights: few are."""
    eights = np.flatnonzero(mask.view(np.uint64))
    k, at = np.nonzero(mask.reshape(-1, 8)[eights])
    return eights[k] * 8 + at


def _close_pairs(h: np.ndarray, radius: np.ndarray, order: np.ndarray, d: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a left and a right row (the same rows: each pair once) within the radius of the later one, that first.

    Both sides are sorted by duration, so that each part of the left meets the right rows whose durations may be comparable, and few others.
    """
    widest, own = int(radius.max(initial=-1)), left is right
    left = left[np.argsort(d[left], kind="stable")]
    right = left if own else right[np.argsort(d[right], kind="stable")]
    g, e, finite = h[right], d[right], bool(np.isfinite(d).all())
    room = CHUNK_ROWS * len(right)
    differing, count, mask = np.empty(room, np.uint64), np.empty(room, np.uint8), np.zeros(room + 8, bool)
    for at in range(0, len(left), CHUNK_ROWS):
        rows = left[at : at + CHUNK_ROWS]
        first, end = 0, len(right)
        if finite:
            low, high = d[rows[0]], d[rows[-1]]
            low, high = min(low - 60.0, 0.88 * low), max(high + 60.0, high / 0.88)
            first = int(np.searchsorted(e, low - 1e-6 - 1e-9 * abs(low), "left"))
            end = int(np.searchsorted(e, high + 1e-6 + 1e-9 * abs(high), "right"))
        first = max(first, at) if own else first
        n = len(rows) * (end - first)
        if n <= 0:
            continue
        shape = (len(rows), end - first)
        np.bitwise_xor(h[rows][:, None], g[None, first:end], out=differing[:n].reshape(shape))
        np.bitwise_count(differing[:n], out=count[:n])
        np.less_equal(count[:n], widest, out=mask[:n])
        mask[n : n + 8] = False
        x, y = np.divmod(_marked(mask[: -(-n // 8) * 8]), end - first)
        a, b = rows[x], right[first + y]
        swap = order[a] > order[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        kept = (order[a] < order[b]) & (np.bitwise_count(h[a] ^ h[b]) <= radius[b])
        if own:
            kept &= (x + at < first + y)
        yield a[kept], b[kept]


def _searched(columns: list[str], min_overlap: int, max_offset: int):
    """Rows sorted by cell to the aligned pairs of each cell, of which one at a time is held."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block, order, radius, d, fps = (rows[c].to_numpy() for c in ("__block", "ord", "__radius", "__d", "__fps"))
        h, lists = rows["consensus_hash"].to_numpy().view(np.uint64), _lists(rows["hashes"])
        left = np.flatnonzero(block == block.min())
        right = left if rows["__other"][0].as_py() == block[0] else np.flatnonzero(block != block.min())

        def aligned(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(a), PAIRS):
                i, j = a[k : k + PAIRS], b[k : k + PAIRS]
                similarity, overlap, offset = _aligned(lists, i, j, min_overlap, max_offset)
                told = [pa.array(similarity, from_pandas=True), pa.array(overlap, pa.int32()), pa.array(offset, pa.int32())]
                sides = [rows[c].take(pa.array(at)).combine_chunks() for at in (i, j) for c in columns]
                yield pa.RecordBatch.from_arrays([*sides, *told], names=[*(f"{p}{c}" for p in ("a_", "b_") for c in columns), "similarity", "overlap", "offset"])

        held, n = [], 0
        for a, b in _close_pairs(h, radius, order, d, left, right):
            with np.errstate(all="ignore"):
                far = np.abs(d[a] - d[b]) > np.maximum(60.0, 0.12 * np.maximum(np.maximum(d[a], d[b]), 0.0))
                apart = np.maximum(fps[a], fps[b]) / np.minimum(fps[a], fps[b]) > 1.25
            held.append((a[~(far | apart)], b[~(far | apart)]))
            n += len(held[-1][0])
            if n >= PAIRS:
                yield from aligned(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from aligned(*map(np.concatenate, zip(*held, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            cells = batch.column("__cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at < end and held and cells[at] != last:
                    yield from pairs(pa.Table.from_batches(held).combine_chunks())
                    held = []
                if at < end:
                    held.append(batch.slice(at, end - at))
                    last = cells[at]
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return run


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with __block, __other and __cell, once for each block that has comparable durations; and the number of cells.

    Comparable durations, with 500 more, have a ratio under 1 / 0.88, so they lie in the same band of ratio BAND or in the next.
    """
    spark = rows.sparkSession
    banded = rows.withColumn("__band", F.floor(F.ln(F.greatest("__d", F.lit(1.0)) + 500) / F.lit(math.log(BAND))))
    blocks = {r[0]: -(-r[1] // GRID_ROWS) for r in banded.groupBy("__band").count().collect()}  # a row for each band
    first, total = {}, 0
    for band in sorted(blocks):
        first[band], total = total, total + blocks[band]
    ends = {band: first[band] + n for band, n in blocks.items()}
    grid = [(band, first[band], n, first.get(band - 1, first[band]), ends.get(band + 1, ends[band])) for band, n in blocks.items()]
    kinds = pa.schema([(c, pa.int64()) for c in ("__band", "__first", "__n", "__low", "__end")])
    bands = spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, row, strict=True)) for row in grid], kinds))  # without Python workers
    dealt = banded.join(F.broadcast(bands), "__band").withColumn("__block", F.col("__first") + F.pmod(F.xxhash64("ord"), F.col("__n")))
    each = dealt.repartition("ord").withColumn("__other", F.explode(F.sequence("__low", F.col("__end") - 1)))  # however few tasks read the rows
    cell = F.least("__block", "__other") * total + F.greatest("__block", "__other")
    cells = sum(n * (n + 1) // 2 + n * blocks.get(band + 1, 0) for band, n in blocks.items())
    return each.withColumn("__cell", cell).drop("__band", "__first", "__n", "__low", "__end"), cells


def duplicate_pairs(prints: DataFrame, min_overlap: int = 1, max_offset: int = 600, base: float = BASE_SIMILARITY) -> DataFrame:
    """The duplicate search: fingerprints (ord, path, duration_s, hashes, consensus_hash, file_size, width, height, sample_fps) to pairs.

    Comparable durations, the consensus radius of the later row and sampling rates make candidates, in blocks of rows of
    comparable bands of durations; then the best alignment and the threshold for its overlap. Nulls have no
    pairs. The kept side has more pixels, then bytes, then the smaller path; the offset is negative if that is the later row.
    """
    columns = ["path", "duration_s", "file_size", "width", "height"]
    whole = [F.col(c).isNotNull() for c in ("ord", "duration_s", "consensus_hash", "sample_fps", "hashes")]  # dropna would evaluate all of them once more
    known = prints.where(reduce(and_, [*whole, ~F.isnan("duration_s"), ~F.isnan("sample_fps")]))
    rows = known.select("ord", *columns, F.col("consensus_hash").cast("long").alias("consensus_hash"), F.col("hashes").cast("array<long>").alias("hashes"), prefilter_radius(F.size("hashes")).alias("__radius"), F.col("duration_s").cast("double").alias("__d"), F.col("sample_fps").cast("double").alias("__fps"))
    dealt, cells = _dealt(rows)
    sorted_rows = dealt.repartition(max(1, min(cells, SEARCH_TASKS)), "__cell").sortWithinPartitions("__cell")
    kinds = ", ".join(f"`{p}{c}` {prints.schema[c].dataType.simpleString()}" for p in ("a_", "b_") for c in columns)
    found = sorted_rows.mapInArrow(_searched(columns, min_overlap, max_offset), f"{kinds}, similarity double, overlap int, offset int")
    aligned = found.where(F.col("similarity") >= required_similarity(F.col("overlap"), base))
    rank = lambda p: F.struct((F.col(f"{p}_width") * F.col(f"{p}_height")).alias("area"), F.col(f"{p}_file_size").alias("size"))
    first = (rank("a") > rank("b")) | ((rank("a") == rank("b")) & (F.col("a_path") <= F.col("b_path")))
    side = lambda keep, c: F.when(F.col("__first") == keep, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    sides = [side(keep, c).alias(f"{who}_{name}" if name else who) for c, name in (("path", ""), ("file_size", "size"), ("duration_s", "duration_s"), ("width", "width"), ("height", "height")) for keep, who in ((True, "original"), (False, "duplicate"))]
    return aligned.withColumn("__first", first).select(*sides, (F.col("similarity") * 100).alias("similarity"), F.when(F.col("__first"), F.col("offset")).otherwise(-F.col("offset")).cast("double").alias("offset_s"), F.col("overlap").alias("overlap_frames"))
