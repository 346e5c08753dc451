"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at a few differing bits. Bits that go together are grouped into the
same partition, so that what is skewed lies in few partitions. Partition i gets a threshold t_i
of its own, -1 or more, such that the thresholds add up to ``radius - partitions + 1``: then any
two fingerprints within the radius are within t_i on some partition. Dynamic programming over the
partitions picks the thresholds with the fewest estimated candidates. Each fingerprint probes
every partition with the values within t_i of its own, and candidates are verified on all bits.

Equal fingerprints are one node from the start. What is dense is linked before it is paired: in
each bucket, every fingerprint is verified against two pivots, and the components of these
links are labels; a bucket in which all have one label makes no pairs, and no pair within a label is
made. Buckets that are still large are split on the remaining bits by the pigeonhole principle
again. So no link that joins two components is lost, and groups of copies cost little.

Rows: a null text has no words, as an empty one: fingerprint zero, which links as any other.
A null doc_id is carried along and is never a component's id unless all are null. Repeated rows
fall into one component. An empty table gives no rows, and a table of one fingerprint no links; neither is planned for.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import read_table, shared_dir, written
from brindle.operators.graph import connected_components

BITS = 64
SEED = 42
#: A bucket of more fingerprints of different labels is split on the remaining bits.
LARGE = 256
#: What a probe costs, in pairs to verify: a row that is shuffled against a comparison.
PROBE_COST = 25


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Of each run of so many words, or of all words if they are fewer; none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII white space
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    n = max(1, len(tokens) - words + 1)
    firsts = [0, *(ends[: n - 1] + 1).tolist()]
    lasts = ends[len(tokens) - n :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(firsts, lasts, strict=True)), np.uint64, n)


def fingerprint(text: str | None, words: int) -> int:
    """As a signed 64-bit number."""
    hashes = shingle_hashes(text, words)
    n = len(hashes)
    if not n:
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints, pa.int64())], names=[*batch.schema.names[1:], "fp"])

    return run


def with_fingerprint(docs: DataFrame, words: int) -> DataFrame:
    """The columns of docs but the text, which comes first, and fp."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:])
    return docs.mapInArrow(_fingerprints(words), f"{kept}, fp long")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are both set, in this partition."""
    both = np.zeros((BITS, BITS), np.int64)
    n = 0
    for batch in batches:
        fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += (bits.T @ bits).astype(np.int64)
        n += len(fps)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.ravel()], pa.list_(pa.int64()))], names=["n", "together"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Fingerprints, and the 64 x 64 counts of bits that are set together, over all of them."""
    sums = fps.select("fp").mapInArrow(_together, "n long, together array<long>")
    rows = sums.select(F.posexplode("together").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    n = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    both = np.zeros(BITS * BITS)
    for k, v in rows:
        both[k] = v
    return n, both.reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits in groups of equal size: from the most correlated bit on, the ones that go with the group."""
    p = both.diagonal() / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(strength, 0)
    left, groups = set(range(BITS)), []
    for k in range(partitions):
        size = BITS * (k + 1) // partitions - BITS * k // partitions
        rest = sorted(left)
        group = [max(rest, key=lambda b: strength[b, rest].sum())]  # noqa: B023
        while len(group) < size:
            group.append(max((b for b in rest if b not in group), key=lambda b: strength[b, group].sum()))  # noqa: B023
        left -= set(group)
        groups.append(sorted(group))
    return groups


def growth(p: np.ndarray, group: list[int], most: int) -> list[float]:
    """By threshold: candidates of a partition over those with equal values, for independent bits."""
    equal = p[group] ** 2 + (1 - p[group]) ** 2
    poly = np.array([1.0])
    for r in (1 - equal) / np.maximum(equal, 1e-9):
        poly = np.convolve(poly, [1, r])[: most + 1]
    return np.cumsum(np.pad(poly, (0, max(0, most + 1 - len(poly))))).tolist()


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds from -1 with the given total and the least cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                if used + t not in after or cost + c < after[used + t][0]:
                    after[used + t] = (cost + c, [*chosen, t])
        best = after
    return best[total][1]


def plan(spark: SparkSession, fps: DataFrame, radius: int) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds, for the least estimated work."""
    counted, both = bit_statistics(fps)
    n, p = max(2, counted), both.diagonal() / max(1, counted)  # with no work at all, any thresholds would be cheapest

    def costs(groups: list[list[int]], equal: list[float]) -> list[list[float]]:
        """Pairs to verify and values to probe."""
        return [[0.0, *(e * g + PROBE_COST * n * sum(comb(len(group), k) for k in range(t + 1)) for t, g in enumerate(growth(p, group, radius)))] for group, e in zip(groups, equal, strict=True)]

    def guess(groups: list[list[int]]) -> list[float]:
        return [n * n / 2 * float(np.prod(p[g] ** 2 + (1 - p[g]) ** 2)) for g in groups]

    def work(m: int) -> float:
        groups = correlated_groups(counted, both, m)
        table = costs(groups, guess(groups))
        return sum(c[t + 1] for c, t in zip(table, allocate(table, radius - m + 1), strict=True))

    groups = correlated_groups(counted, both, min(range(2, radius + 2), key=work))
    keys = fps.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), value(F.col("fp"), g).alias("v")) for i, g in enumerate(groups)))).alias("k")).groupBy("k.i", "k.v").count()
    measured = {r[0]: float(r[1]) for r in keys.groupBy("i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect()}
    table = costs(groups, [measured.get(i, 0.0) for i in range(len(groups))])
    return groups, allocate(table, radius - len(groups) + 1)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def value(fp: Column, group: list[int]) -> Column:
    """A partition's value: the fingerprint with the other bits cleared."""
    return fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))


def _flips(group: list[int], threshold: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(threshold + 1) for c in combinations(group, k)]


def _links(index: DataFrame, probes: DataFrame, on: list[str], radius: int) -> DataFrame:
    a, b = probes.alias("a"), index.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]
    near = (F.col("a.label") != F.col("b.label")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    return a.join(b, [*same, near]).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def link(spark: SparkSession, fps: DataFrame, radius: int) -> DataFrame:
    """(node, component) of distinct fingerprints (fp) that have a partner within the radius."""
    groups, thresholds = plan(spark, fps, radius)
    used = [(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]

    def keyed(df: DataFrame, probing: bool) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("i"), value(F.col("fp"), g).bitwiseXOR(F.lit(x)).alias("v")) for i, g, t in used for x in (_flips(g, t) if probing else [0])]
        return df.withColumn("k", F.explode(F.array(*keys))).select("*", "k.i", "k.v").drop("k")

    index = keyed(fps.select("fp"), False)
    order = [F.struct(F.xxhash64(F.lit(s), "fp").alias("h"), "fp") for s in (1, 2)]
    pivots = index.groupBy("i", "v").agg(F.count("*").alias("n"), *(F.min(o).alias(f"p{k}") for k, o in enumerate(order))).where("n > 1")
    stars = index.join(pivots, ["i", "v"]).select("fp", F.explode(F.array("p0.fp", "p1.fp")).alias("pivot")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= radius)
    first = written(spark, connected_components(spark, stars, "fp", "pivot"), "stars")
    labelled = written(spark, fps.select("fp").join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("label")), "labels")

    index, probes = keyed(labelled, False), keyed(labelled, True)
    mixed = probes.groupBy("i", "v").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("i", "v", (F.col("n") > LARGE).alias("large"))
    index, probes = index.join(mixed, ["i", "v"]), probes.join(mixed, ["i", "v"])
    found = _links(index.where("not large"), probes.where("not large"), ["i", "v"], radius)

    def split(df: DataFrame) -> DataFrame:
        """On the bits outside the partition: within the radius, one of radius + 1 blocks is equal."""
        blocks = {i: [[b for b in range(BITS) if b not in g][k :: radius + 1] for k in range(radius + 1)] for i, g, _ in used}
        subs = None
        for i, parts in blocks.items():
            keys = F.array(*(F.struct(F.lit(k).alias("j"), value(F.col("fp"), part).alias("u")) for k, part in enumerate(parts)))
            subs = keys if subs is None else F.when(F.col("i") == i, keys).otherwise(subs)
        return df.where("large").withColumn("s", F.explode(subs)).select("fp", "label", "i", "v", "s.j", "s.u")

    fine_index, fine_probes = split(index), split(probes)
    still = fine_probes.groupBy("i", "v", "j", "u").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("i", "v", "j", "u")
    on = ["i", "v", "j", "u"]
    found = found.unionAll(_links(fine_index.join(still, on, "left_semi"), fine_probes.join(still, on, "left_semi"), on, radius))
    edges = found.distinct().unionAll(first.select("node", "component"))
    return connected_components(spark, edges)


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, fp, component_id.

    component_id: the smallest doc_id that links lead to.
    """
    shared_dir(spark)
    rows = written(spark, with_fingerprint(docs.select("text", "doc_id"), words), "prints")
    fps = written(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    linked = written(spark, link(spark, fps, radius), "linked") if fps.limit(2).count() > 1 else spark.createDataFrame([], "node long, component long")
    member = fps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(member.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark, read_table(spark, sf_dir, "documents"), words=4, radius=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
