"""The duplicate search and the matching: blocks, alignment and choices against plain loops."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brindle import catalog_queries, queries
from brindle.operators import similarity, summary


def _prints(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        hashes = [rng.choice([0, 1, -1, rng.getrandbits(63)]) for _ in range(rng.choice([0, 1, 2, 3, 9]))]
        if k % 11 == 0 and hashes:
            hashes[0] = None
        h = sum(1 << b for b in rng.sample(range(63), rng.choice([2, 9, 12])))
        rows.append((k, f"p{k:03d}", rng.choice([0.0, 1.0, 59.0, 100.0, 600.0, 700.0, 4000.0, None]), hashes if k % 13 else None, h if k % 17 else None, k % 5, 640, 360 + k % 3, rng.choice([1.0, 2.0])))
    return spark.createDataFrame(rows, "ord long, path string, duration_s double, hashes array<long>, consensus_hash long, file_size long, width int, height int, sample_fps double")


def test_search_in_blocks_equals_columns(spark, monkeypatch):
    """Many blocks of a few rows, against the same conditions as columns on all pairs."""
    monkeypatch.setattr(similarity, "GRID_ROWS", 7)
    prints = _prints(spark, 150, 1).cache()
    a, b = (prints.select(*(F.col(c).alias(p + c) for c in prints.columns)) for p in ("a_", "b_"))
    radius = F.bit_count(F.col("a_consensus_hash").bitwiseXOR(F.col("b_consensus_hash"))) <= similarity.prefilter_radius(F.size("b_hashes"))
    near = a.crossJoin(b).where(F.col("a_ord") < F.col("b_ord")).where(similarity.comparable_durations(F.col("a_duration_s"), F.col("b_duration_s")) & radius & ~similarity.rates_differ(F.col("a_sample_fps"), F.col("b_sample_fps")))
    told = near.withColumn("s", similarity.best_shift(F.col("a_hashes"), F.col("b_hashes"))).where("s.similarity is not null").select("a_path", "b_path", "s.*").collect()
    want = {frozenset((x, y)): (s, n, abs(o)) for x, y, s, n, o in told if s >= (1.0 if n <= 0 else 0.995 if n < 3 else 0.97 if n < 5 else 0.92 if n < 10 else 0.85)}
    got = {frozenset((r.original, r.duplicate)): (r.similarity / 100, r.overlap_frames, abs(r.offset_s)) for r in similarity.duplicate_pairs(prints).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1:] == want[k][1:] for k in got)


def test_search_deals_equal_durations_out(spark, monkeypatch):
    """All durations in one band: no task meets more than two blocks of rows."""
    monkeypatch.setattr(similarity, "GRID_ROWS", 50)
    rows = spark.range(1000).select(F.col("id").alias("ord"), F.lit(600.0).alias("__d"))
    dealt, cells = similarity._dealt(rows)
    sizes = [r[1] for r in dealt.groupBy("__cell").count().collect()]
    assert len(sizes) == cells == 210 and max(sizes) < 250


def test_search_of_nothing(spark):
    assert similarity.duplicate_pairs(_prints(spark, 30, 2).limit(0)).count() == 0


def test_files_of_pairs_in_one_pass(spark):
    """Both sides of a pair come from the same rows, which are expensive to find."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kinds = "original string, duplicate string, " + ", ".join(f"{p}_{c} long" for p in ("original", "duplicate") for c in ("size", "duration_s", "width", "height"))
    pairs = spark.createDataFrame([("a", "b", 5, 1, 2, 3, 4, 1, 2, 3), ("a", "c", 6, 1, 2, 3, 4, 1, 2, 4)], kinds).mapInArrow(count, kinds)
    assert {tuple(r) for r in summary.largest_by_path(pairs).collect()} == {("a", 6, 6, 2), ("b", 4, 6, 1), ("c", 4, 8, 1)}
    assert seen.value == 2


def _cell(n, durations, seed=4):
    """Two blocks of n rows as a task gets them."""
    rng = np.random.default_rng(seed)
    side = np.repeat([0, 1], n)
    h = rng.integers(0, 1 << 6, 2 * n)
    lists = pa.ListArray.from_arrays(np.arange(0, 4 * n + 2, 2, dtype=np.int32), pa.array(rng.integers(0, 1 << 62, 4 * n)))
    some = {c: pa.array(np.arange(2 * n)) for c in ("ord", "path")}
    return pa.table(some | {"hashes": lists, "consensus_hash": pa.array(h), "__radius": pa.array(rng.integers(0, 3, 2 * n, dtype=np.int32)), "__d": pa.array(rng.choice(durations, 2 * n)), "__fps": pa.array(rng.choice([1.0, 1.2, 2.0], 2 * n)), "__block": pa.array(side), "__other": pa.array(1 - side), "__cell": pa.array(np.ones(2 * n, int))}).combine_chunks()


def test_cell_is_aligned_at_once():
    """Candidates of many parts of a block make a few batches, not one or more each."""
    rows = _cell(1000, [600.0, 640.0, 900.0])
    batches = list(similarity._searched(["path"], 1, 600)(iter(rows.to_batches())))
    total = sum(b.num_rows for b in batches)
    assert total > 20_000 and len(batches) <= total // similarity.PAIRS + 1 + total // 20_000


def test_durations_bound_what_is_compared(monkeypatch):
    """Rows sorted by duration meet comparable ones only: half the comparisons of a cell are of durations far apart."""
    h, d = np.zeros(400, np.uint64), np.repeat([100.0, 1000.0], 200)
    compared = []
    marked = similarity._marked
    monkeypatch.setattr(similarity, "_marked", lambda mask: compared.append(len(mask)) or marked(mask))
    left, right = np.arange(0, 400, 2), np.arange(1, 400, 2)
    found = list(similarity._close_pairs(h, np.ones(400, np.int32), np.arange(400), d, left, right))
    assert sum(len(a) for a, _ in found) >= 20_000 and sum(compared) < 30_000


def test_close_pairs_of_odd_durations():
    """Negative, endless, unknown and tiny durations, within a block and across two, as plain comparisons find them."""
    rng = np.random.default_rng(6)
    for durations in ([-500.0, -60.0, 0.0, 59.9, 60.0, 120.0, 500.0, 568.0, 1e6, 1.1e6, 1.14e6], [1.0, np.inf, np.nan, 700.0]):
        h, d, radius, order = rng.integers(0, 16, 300).astype(np.uint64), rng.choice(durations, 300), rng.integers(0, 3, 300).astype(np.int32), rng.permutation(300)
        with np.errstate(all="ignore"):
            near = ~(np.abs(d[:, None] - d) > np.maximum(60.0, 0.12 * np.maximum(np.maximum(d[:, None], d), 0.0)))
        close = near & (order[:, None] < order) & (np.bitwise_count(h[:, None] ^ h) <= radius)
        for left, right in ((np.arange(300),) * 2, (np.arange(0, 300, 3), np.setdiff1d(np.arange(300), np.arange(0, 300, 3)))):
            split = np.zeros((300, 300), bool)
            split[np.ix_(left, right)] = split[np.ix_(right, left)] = True
            got = [(x, y) for a, b in similarity._close_pairs(h, radius, order, d, left, left if len(left) == 300 else right) for x, y in zip(a.tolist(), b.tolist(), strict=True) if near[x, y]]
            assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(close & split)), strict=True)) and got


def test_signs_of_odd_vectors(spark, tmp_path):
    """Null, short, long and unknown values have the bits that the columns of the other queries give them."""
    rng = random.Random(8)
    vectors = [[rng.choice([-1.0, 0.0, 1.0, None, float("nan")]) for _ in range(n)] for n in (0, 1, 7, 63, 64, 64, 70)] + [None, [1.0] * 64, [-1.0] * 64]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    bit = lambda k: F.when(F.get("embedding", F.lit(k)) > 0, 1 << k % 8).otherwise(0).cast("long")
    words = F.array(*(sum((bit(w * 8 + i) for i in range(8)), F.lit(0)).cast("long") for w in range(8)))
    want = spark.read.parquet(str(tmp_path / "embeddings.parquet")).select("vec_id", words, queries.sign_hash(F.col("embedding"))).collect()
    got = catalog_queries.prints(spark, str(tmp_path)).select("ord", "hashes", "consensus_hash").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 10
