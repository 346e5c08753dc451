"""Repeated passages by super-k-mer partitioning.

A window is so many consecutive words. Each window has a minimiser, the least hash among its
runs of three words; consecutive windows with the same minimiser form a super-k-mer, which
travels as one packed string to the minimiser's bucket. Equal windows have equal minimisers, so
a bucket sees every occurrence of its windows, and sorting them there gives, exactly, the
smallest doc_id that each starts in.

Blocks of rows pack what they send: equal super-k-mers of a block are one entry, and the entries
for a bucket are one compressed blob. So a passage in a third of all rows reaches its bucket
once for each block. The bucket answers a blob with the entries whose windows start in an
earlier document; answers are dealt out evenly and only there spread over the occurrences.

Windows compare by 128-bit hashes of their bytes.

Rows: a null text has no words; a null doc_id is neither smaller nor larger than any other, so
such a row keeps its words and removes none; repeated rows give equal results, as an equal
doc_id isn't smaller; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import n_partitions, read_table

#: Words in the runs whose least hash is a window's minimiser.
RUN = 3
#: Bytes of text in a block of rows, and in a bucket.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def minimisers(words: list[bytes], window: int) -> np.ndarray:
    """One for each window."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    n = len(words) - RUN + 1
    t = h[:n].copy()
    for k in range(1, RUN):
        t = (t * MIX ^ t >> np.uint64(29)) + h[k : n + k]
    t = (t ^ t >> np.uint64(32)) * MIX
    t ^= t >> np.uint64(29)
    width, size = window - RUN + 1, 1
    while 2 * size <= width:
        t = np.minimum(t[:-size], t[size:])
        size *= 2
    if rest := width - size:
        t = np.minimum(t[:-rest], t[rest:])
    return t


class _Block:
    """What a block of rows sends: by bucket, packed strings with the places they occur in."""

    def __init__(self, window: int, buckets: int):
        self.window, self.buckets, self.bytes = window, np.uint64(buckets), 0
        #: by bucket: packed string -> [doc_id, checksum, place, doc_id, ...]
        self.entries: dict[int, dict[bytes, list[int]]] = {}

    def add(self, doc_id: int, text: str) -> None:
        raw = text.encode()
        words = raw.split()
        if len(words) < self.window:
            return
        self.bytes += len(raw)
        check, joined = zlib.crc32(raw), b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        least = minimisers(words, self.window)
        firsts = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
        lasts = np.append(firsts[1:] - 1, len(least) - 1)
        a = np.where(firsts > 0, ends[firsts - 1] + 1, 0).tolist()
        b = ends[lasts + self.window - 1].tolist()
        for bucket, place, lo, hi in zip((least[firsts] % self.buckets).tolist(), firsts.tolist(), a, b, strict=True):
            self.entries.setdefault(bucket, {}).setdefault(joined[lo:hi], []).extend((doc_id, check, place))

    def rows(self) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        buckets, strings, places = [], [], []
        for bucket, entries in self.entries.items():
            buckets.append(bucket)
            strings.append(pack(b"\n".join(entries)))
            sizes = np.fromiter(map(len, entries.values()), np.int64, len(entries)) // 3
            flat = np.array([x for v in entries.values() for x in v], np.int64).reshape(-1, 3)
            places.append(pack(_pack_places(sizes, flat)))
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(strings, pa.binary()), pa.array(places, pa.binary())], names=["bucket", "strings", "places"])


def _pack_places(sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """Columns one after the other; ids as differences, which compress."""
    ids = np.diff(flat[:, 0], prepend=0)
    return np.array([len(sizes), len(flat)], "<i8").tobytes() + sizes.astype("<i4").tobytes() + ids.astype("<i8").tobytes() + flat[:, 1].astype("<u4").tobytes() + flat[:, 2].astype("<i4").tobytes()


def _unpack_places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    entries, n = np.frombuffer(raw, "<i8", 2).tolist()
    at, out = 16, []
    for kind, count in (("<i4", entries), ("<i8", n), ("<u4", n), ("<i4", n)):
        out.append(np.frombuffer(raw, kind, count, at).astype(np.int64))
        at += count * int(kind[2])
    sizes, ids, checks, places = out
    return sizes, np.cumsum(ids), checks, places


def _send(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(window, buckets)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc_id, text.as_py())
                if block.bytes >= BLOCK_BYTES:
                    yield block.rows()
                    block = _Block(window, buckets)
        if block.entries:
            yield block.rows()

    return run


def _hashes(strings: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of packed strings: 128-bit hashes (n, 2), and windows in each string."""
    raw = np.frombuffer(strings, np.uint8)
    gaps = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
    closing = np.append(np.flatnonzero(raw[gaps[:-1]] == 10), len(gaps) - 1)
    words = np.diff(closing, prepend=-1)
    counts = words - window + 1
    first = np.repeat(closing - words + 1, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = np.append(0, gaps[:-1] + 1)
    digest = xxhash.xxh3_128_digest
    out = b"".join([digest(strings[a:b]) for a, b in zip(begins[first].tolist(), gaps[first + window - 1].tolist(), strict=True)])
    return np.frombuffer(out, "<u8").reshape(-1, 2), counts


def _answer(window: int):
    """In a bucket: for each blob, its entries with windows that start in an earlier document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, hashes, docs = [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, counts = _hashes(unpack(packed), window)
                sizes, ids, _, _ = _unpack_places(unpack(places))
                least = np.minimum.reduceat(ids, np.cumsum(sizes) - sizes)
                blobs.append((counts, places))
                hashes.append(h)
                docs.append(np.repeat(least, counts))
        if not blobs:
            return
        h, doc = np.concatenate(hashes), np.concatenate(docs)
        del hashes, docs
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
        h = h[order]
        new = np.append(True, (h[1:] != h[:-1]).any(axis=1))
        earliest = np.empty_like(doc)
        earliest[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        del h, order, new, doc
        at, pack = 0, zstandard.ZstdCompressor(level=1).compress
        for counts, places in blobs:
            sizes, ids, checks, where = _unpack_places(unpack(places))
            own = earliest[at : at + counts.sum()]
            at += len(own)
            most = np.maximum.reduceat(ids, np.cumsum(sizes) - sizes)
            hit = np.minimum.reduceat(own, np.cumsum(counts) - counts) < most
            if hit.any():
                rows, windows = np.repeat(hit, sizes), np.repeat(hit, counts)
                flat = np.stack([ids[rows], checks[rows], where[rows]], axis=1)
                answer = np.array([len(flat)], "<i8").tobytes() + counts[hit].astype("<i4").tobytes() + own[windows].astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([pack(_pack_places(sizes[hit], flat))], pa.binary()), pa.array([pack(answer)], pa.binary())], names=["places", "answer"])

    return run


def _spread(window: int):
    """Stretches of words to remove, for each occurrence in an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sizes, ids, checks, places = _unpack_places(unpack(packed))
                raw = unpack(answer)
                counts = np.frombuffer(raw, "<i4", len(sizes), 8).astype(np.int64)
                earliest = np.frombuffer(raw, "<i8", counts.sum(), 8 + 4 * len(sizes))
                entry = np.repeat(np.arange(len(sizes)), sizes)
                n = counts[entry]
                row = np.repeat(np.arange(len(ids)), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hit = earliest[(np.cumsum(counts) - counts)[entry][row] + k] < ids[row]
                row, k = row[hit], k[hit]
                if not len(row):
                    continue
                first = np.append(True, (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1))
                last = np.append(first[1:], True)
                at = row[first]
                start = places[at] + k[first]
                arrays = (ids[at], checks[at], start, places[at] + k[last] + window - start)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["doc_id", "check", "start", "length"])

    return run


def repeated_stretches(spark: SparkSession, docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, check, start, length): stretches of words of windows that start in earlier documents.

    check: CRC-32 of the text, which tells rows of one doc_id apart. Stretches may overlap.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = n_partitions(spark, total, BUCKET_BYTES)
    sent = rows.mapInArrow(_send(window, buckets), "bucket int, strings binary, places binary").repartitionById(buckets, "bucket")
    answers = sent.mapInArrow(_answer(window), "places binary, answer binary")
    return answers.repartition(buckets, F.xxhash64("places")).mapInArrow(_spread(window), "doc_id long, check long, start long, length long")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, stretches in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in stretches or ():
                gone[s["start"]] += 1
                gone[s["start"] + s["length"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words))
        arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeated(spark: SparkSession, docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that repeat earlier ones."""
    stretches = repeated_stretches(spark, docs, window).groupBy("doc_id", "check").agg(F.collect_list(F.struct("start", "length")).alias("stretches"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("check"))
    return keyed.join(stretches, ["doc_id", "check"], "left").select("doc_id", "text", "stretches").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept string")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated(spark, read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
