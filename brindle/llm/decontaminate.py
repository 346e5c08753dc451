"""Benchmark decontamination by the q-gram lemma over diagonal bands.

Benchmark items are cut into probes of at most PROBE characters, half of it apart. A passage within e edits
of a probe of m characters shares at least ``m - q + 1 - q * e`` of its q-grams with it, all on
diagonals that are at most e apart. So the q-grams that a text and a probe share are counted in
overlapping bands of diagonals, bands with fewer are dropped, and what is left is verified by
an alignment within the band, the ends of the text being free.

Texts and items are compared in lower case, with white space as one space. The benchmark is
sent to the executors in blocks of at most BLOCK_CHARS characters, each of which meets all rows
once; there is no other bound on it.

Rows: null and empty texts match nothing; null and repeated doc_ids are carried along; items
that are null or hold no characters are ignored; items shorter than a q-gram are sought as they are; an
empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import read_table

Q = 8
#: Edits allowed, as a share of the characters.
EDITS = 0.08
#: Characters of a probe: any 96 that a text takes from an item hold a whole one.
PROBE = 64
BLOCK_CHARS = 2_000_000
#: Characters of texts that are searched at once.
CHUNK = 1 << 20
BASE = np.uint64(0x100000001B3)
FILTER_BITS, COUNT_BITS = 22, 22
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    """A hash for each q-gram; Q is a power of two."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size, base = 1, BASE
    while size < Q:
        if len(h) <= size:
            return np.empty(0, np.uint64)
        h = h[:-size] * base + h[size:]
        size, base = 2 * size, np.uint64(int(base) ** 2 % 2**64)
    return h


def budget(m: int) -> int:
    """Edits allowed for a probe of m characters: at most those that leave a shared q-gram."""
    return max(0, min(int(EDITS * m), (m - Q) // Q))


def probes_of(item: str) -> list[tuple[int, str]]:
    """(start, probe) of a normalised item."""
    last = max(0, len(item) - PROBE)
    return [(a, item[a : a + PROBE]) for a in (*range(0, last, PROBE // 2), last)]


class Index:
    """The q-grams of a block of the benchmark."""

    def __init__(self, items: list[tuple[object, str]]):
        self.probes = [(i, a, p) for i, t in items for a, p in probes_of(t) if len(p) >= Q]
        self.short = [(i, t) for i, t in items if 0 < len(t) < Q]
        grams = [codes(p) for _, _, p in self.probes]
        sizes = [len(g) for g in grams]
        all_codes = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(all_codes, kind="stable")
        self.probe = np.repeat(np.arange(len(grams)), sizes)[order]
        self.place = np.concatenate([np.arange(n) for n in sizes])[order] if grams else np.empty(0, np.int64)
        self.codes, self.first, self.count = np.unique(all_codes[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.codes * SPREAD) >> np.uint64(64 - FILTER_BITS)] = True
        self.budgets = np.array([budget(len(p)) for _, _, p in self.probes], np.int64)
        self.needed = np.array([len(p) - Q + 1 - Q * budget(len(p)) for _, _, p in self.probes], np.int64)
        #: Bands are this wide, and each reaches into the next by the edits allowed.
        self.width = 1 << max(3, int(self.budgets.max(initial=1)).bit_length())

    def bands(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(probe, first and last diagonal) of the bands that have q-grams enough."""
        h = codes(text)
        at = np.flatnonzero(self.filter[(h * SPREAD) >> np.uint64(64 - FILTER_BITS)])
        if not len(at) or not len(self.codes):
            return
        k = np.minimum(np.searchsorted(self.codes, h[at]), len(self.codes) - 1)
        real = self.codes[k] == h[at]
        at, k = at[real], k[real]
        n = self.count[k]
        rows = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        probe, diagonal = self.probe[rows], np.repeat(at, n) - self.place[rows] + PROBE
        band = diagonal // self.width
        spill = np.flatnonzero(diagonal % self.width < self.budgets[probe])
        probe, band = np.append(probe, probe[spill]), np.append(band, band[spill] - 1)
        key = (probe << 32) + band
        slot = ((key.astype(np.uint64) * SPREAD) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
        many = np.bincount(slot, minlength=1 << COUNT_BITS)[slot] >= self.needed[probe]  # an upper bound
        found, counts = np.unique(key[many], return_counts=True)
        for x, c in zip(found.tolist(), counts.tolist(), strict=True):
            if c >= self.needed[p := x >> 32]:
                low = (x & 0xFFFFFFFF) * self.width - PROBE
                yield p, low, low + self.width + int(self.budgets[p])


def align(probe: str, text: str, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the probe in the text on the diagonals low to high, within the edits."""
    left, n, m, one = low - edits, high - low + 2 * edits + 1, len(probe), 1 << 32
    p = np.frombuffer(probe.encode("utf-32-le", "surrogatepass"), "<u4")
    t = np.full(n + m, 0xFFFFFFFF, np.uint32)  # the text from left on; a value that no character has outside it
    a, b = max(0, left), min(len(text), left + n + m)
    if a >= b:
        return None
    t[a - left : b - left] = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), "<u4")
    # A cost is in the upper half, the diagonal that it began on in the lower half.
    step = np.arange(n, dtype=np.int64) * one
    cost = np.arange(n, dtype=np.int64)
    cost[: max(0, -left)] += one * (edits + 1)
    for j in range(m):
        new = cost + np.where(t[j : j + n] == p[j], 0, one)
        new[:-1] = np.minimum(new[:-1], cost[1:] + one)
        cost = np.minimum.accumulate(new - step) + step
    k = int(cost.argmin())
    found, start = divmod(int(cost[k]), one)
    return (found, left + start, left + k + m) if found <= edits else None


def search(index: Index, texts: list[str]) -> Iterator[tuple[int, object, int, int, int]]:
    """(number of the text, item, edits, start, end) of the probes found in normalised texts."""
    joined = "\n".join(texts)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for k, low, high in index.bands(joined):
        item, _, probe = index.probes[k]
        edits = int(index.budgets[k])
        first = max(0, int(np.searchsorted(begins, low - edits, "right")) - 1)
        last = int(np.searchsorted(begins, high + edits + len(probe), "left"))
        for d in range(first, min(last, len(texts))):
            at = int(begins[d])
            if hit := align(probe, texts[d], low - at, high - at, edits):
                yield d, item, *hit
    for item, short in index.short:
        for d, t in enumerate(texts):
            if (at := t.find(short)) >= 0:
                yield d, item, 0, at, at + len(short)


FOUND = "item_id {}, edits int, start long, end long, probes int"


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.value
        for batch in batches:
            texts = [normal(t.as_py()) for t in batch.column(1)]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                    size += len(texts[hi])
                    hi += 1
                best: dict[tuple[int, object], list[int]] = {}
                for d, item, edits, start, end in search(index, texts[lo:hi]):
                    old = best.setdefault((lo + d, item), [edits, start, end, set()])
                    old[:3] = [min(old[0], edits), min(old[1], start), max(old[2], end)]
                    old[3].add(start)
                lo = hi
                if best:
                    rows = pa.array([d for d, _ in best], pa.int32())
                    columns = [[v[0] for v in best.values()], [v[1] for v in best.values()], [v[2] for v in best.values()], [len(v[3]) for v in best.values()]]
                    items = pa.array([i for _, i in best])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), items, *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True))], names=["doc_id", "item_id", "edits", "start", "end", "probes"])

    return run


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end, probes): the items that each text holds passages of.

    start and end: from the first to the last passage found, in the normalised text; edits: of the
    best passage.
    """
    sizes = benchmark.where("text is not null").agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n"))
    blocks = max(1, -(-sizes.first()[0] // BLOCK_CHARS))
    kind, key = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    out = None
    for k in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).where("text is not null")
        index = spark.sparkContext.broadcast(Index([(r[0], normal(r[1])) for r in own.select("item_id", "text").collect()]))
        found = docs.select("doc_id", "text").mapInArrow(_search(index), f"doc_id {kind}, {FOUND.format(key)}")
        out = found if out is None else out.unionAll(found)
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "edits", "start", "end", "probes")
