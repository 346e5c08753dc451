"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token ids. A window of ``WINDOW_SEQUENCES`` sequences takes from each
queue its share of the target mixture; what a queue gets in whole tokens differs from its
exact share by a deficit, which the next window carries. With cumulative shares in whole
numbers the state of the round-robin at any window has a closed form: after t tokens of a
phase the first j queues have given ``floor(t * S_j / S)``, S_j being their cumulative amounts.
So deficits stay under one token for ever, and any partition takes up the round-robin at the
window that its documents reach, with the deficits that all windows before it have left. When
a queue of a mixture other than the proportional one runs dry, a new phase begins with the
weights of the queues that remain.

Rows: null texts are empty documents (their end id alone); null sources are a queue of their
own; null and repeated ids are carried along, every row is a document of its own; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import read_table, written

SEQUENCE = 4096
END_ID = 2
#: A window is this many sequences.
WINDOW_SEQUENCES = 32
#: Queues without a weight are summed in so many groups, whose sums are summed in turn.
GROUPS = 1024
#: Words, and parts of words, whose ids a Python worker keeps.
CACHED = 600_000
#: Characters that Python's split() takes for white space and the tokenizer doesn't.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Words with such characters, or the start of a special token, are encoded by the tokenizer as they are.
ODD_LETTER = regex.compile("[^\x00-\u024f]|<[|]")
#: Fixed value: the pre-tokens of the public tokenizer file.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordTokenizer:
    """Ids of whole texts; words, and the pre-tokens in them, are encoded once.

    Pre-tokens never span white space, so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # its threads would compete with other tasks
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids of a whole text."""
        if ODD_SPACE.search(text):
            return self._whole(text)
        words = text.split()
        if new := set(words).difference(self.words):
            self._learn(words, list(new))
        return b"".join(map(self.words.__getitem__, words))

    def _whole(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, words: list[str], new: list[str]) -> None:
        if len(self.words) + len(new) > CACHED:
            self.words.clear()
            new = list(set(words))
        plain, joined = new, " ".join(new)
        if ODD_LETTER.search(joined):
            plain = [w for w in new if not ODD_LETTER.search(w)]
            self.words |= {w: self._whole(w) for w in set(new).difference(plain)}
            joined = " ".join(plain)
        # A word of letters alone is one pre-token.
        cut = [[w] if w.isalpha() else PRE_TOKEN.findall(w) for w in self.inner.normalizer.normalize_str(joined).split(" ")] if plain else []
        if len(self.parts) > CACHED:
            self.parts.clear()
        if fresh := list({p for w in cut for p in w}.difference(self.parts)):
            e = self.inner.encode(" ".join(fresh), add_special_tokens=False)
            at = np.array(e.word_ids)
            bounds = (2 * np.searchsorted(at, np.arange(len(fresh) + 1))).tolist()
            raw = np.array(e.ids, "<u2").tobytes()
            self.parts.update(zip(fresh, [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], strict=True))
        parts = self.parts
        self.words.update(zip(plain, [parts[w[0]] if len(w) == 1 else b"".join([parts[p] for p in w]) for w in cut], strict=True))


class Mixture:
    """Where the tokens of each queue go.

    totals: tokens by queue. weights: target weights in whole numbers; None: as the queues are
    filled. Once a queue can't fill its share of a window, a window takes what it has left and a
    new phase begins with the weights that remain. Queues without a weight are one pool, which comes
    last; a queue of it only needs its span in the pool, (tokens of the queues before, with it), so
    the pool can be kept elsewhere: rest is what it holds beyond totals, with spans from there on.
    Phases but the last are whole windows, so only the stream's end is left unfilled.
    """

    def __init__(self, totals: dict[str, int], window: int, weights: dict[str, int] | None = None, rest: int = 0):
        self.window, self.spans, self.pool, left = window, {}, 0, {}
        live = {q: int(w) for q, w in (weights or {}).items() if int(w) > 0}
        for q, n in sorted(totals.items()):
            if n > 0 and q in live:
                left[q] = n
            elif n > 0:
                self.spans[q] = (self.pool, self.pool + n)
                self.pool += n
        self.pool += rest
        done, start, given = dict.fromkeys(left, 0), 0, 0
        #: (start in the stream, tokens, {queue: (taken before, amounts up to it, with it)}, tokens of the pool before and after)
        self.phases: list[tuple[int, int, dict[str, tuple[int, int, int]], int, int]] = []
        while left or given < self.pool:
            here = {q: live[q] for q in left}
            taken = (self._whole_windows(left, here) or self._mixed_window(left, here)) if left else {}
            sums, places = 0, {}
            for q, n in taken.items():
                places[q] = (done[q], sums, sums + n)
                sums += n
                done[q] += n
                left[q] -= n
            left = {q: n for q, n in left.items() if n}
            before = given
            if not left:  # the pool fills the window up, or is all that there is
                given = self.pool if not taken else min(self.pool, given + -sums % window)
            self.phases.append((start, sums + given - before, places, before, given))
            start += sums + given - before
        self.tokens = start

    @staticmethod
    def _shares(amount: int, live: dict[str, int]) -> dict[str, int]:
        total, sums, out = sum(live.values()), 0, {}
        for q, w in live.items():
            out[q] = amount * (sums + w) // total - amount * sums // total
            sums += w
        return out

    def _whole_windows(self, left: dict[str, int], live: dict[str, int]) -> dict[str, int]:
        total = sum(live.values())
        n = min(left[q] * total // (w * self.window) for q, w in live.items())
        while n:
            taken = self._shares(n * self.window, live)
            if all(taken[q] <= left[q] for q in live):
                return taken
            n -= 1
        return {}

    def _mixed_window(self, left: dict[str, int], live: dict[str, int]) -> dict[str, int]:
        """One window: queues that can't fill their shares give all they have, the others share the room."""
        taken, room = {}, self.window
        while live:
            want = self._shares(room, live)
            short = [q for q in live if left[q] <= want[q]]
            if not short:
                return taken | want
            for q in short:
                taken[q] = left[q]
                room -= left[q]
            live = {q: w for q, w in live.items() if q not in taken}
        return taken

    def places(self, queue: str, start: int, length: int, span: tuple[int, int] | None = None) -> Iterator[tuple[int, int, int]]:
        """(place in the stream, offset in the stretch, length) for a stretch of a queue; span: in the pool."""
        at, end = start, start + length
        span = span or self.spans.get(queue)
        for first, total, places, given, after in self.phases:
            if at >= end:
                return
            if queue in places:
                base, lo, hi = places[queue]
            elif span and after > given:
                own = total - (after - given)  # tokens of the weighted queues, which come before the pool
                (g0, h0), (g1, h1) = ([n * s // self.pool for n in (given, after)] for s in span)
                base, lo, hi = g1 - g0, own + h0 - g0, own + h1 - g1
            else:
                continue
            if at >= base + hi - lo:
                continue

            def before(k: int, total=total, lo=lo, hi=hi) -> tuple[int, int, int]:
                """At window k of the phase: its place, tokens of the queues before, of this one."""
                t = min(k * self.window, total)
                return t, t * lo // total, t * hi // total - t * lo // total

            k = max(0, (at - base) * total // ((hi - lo) * self.window) - 1)
            here, there = before(k), before(k + 1)
            while at < min(end, base + hi - lo):
                while base + there[2] <= at:
                    k, here, there = k + 1, there, before(k + 2)
                stop = min(end, base + there[2])
                yield first + here[0] + there[1] - here[1] + at - base - here[2], at - start, stop - at
                at = stop


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which runs many tasks: what it has learnt is kept."""
    return WordTokenizer(path)


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokenizer, given = TaskContext.get().partitionId(), word_tokenizer(path), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                doc_ids, texts, queues = (batch.column(k).slice(lo, 512) for k in range(3))
                blobs, tokens, before = [], [], []
                for text, queue in zip(texts.to_pylist(), queues.to_pylist(), strict=True):
                    blobs.append(tokenizer.ids(text))
                    tokens.append(len(blobs[-1]) // 2 + 1)
                    before.append(given.get(queue, 0))
                    given[queue] = before[-1] + tokens[-1]
                arrays = [doc_ids, queues, pa.array([part] * len(blobs), pa.int32()), pa.array(before, pa.int64()), pa.array(tokens, pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "queue", "part", "before", "doc_tokens", "ids"])

    return run


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(mixture: Mixture, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, ids = [], [[] for _ in range(6)], []
            columns = [batch.column(k).to_pylist() for k in range(1, 7)]
            for i, (queue, at, tokens, blob, low, high) in enumerate(zip(*columns, strict=True)):
                all_ids = np.append(np.frombuffer(blob, "<u2").astype("<u4"), np.uint32(END_ID)).tobytes()
                for place, start, length in mixture.places(queue, at, tokens, None if low is None else (low, high)):
                    while length:
                        offset = place % SEQUENCE
                        n = min(length, SEQUENCE - offset)
                        piece = all_ids[4 * start : 4 * (start + n)]
                        rows.append(i)
                        for column, x in zip(out, (start, n, zlib.crc32(piece), tokens, place // SEQUENCE, offset), strict=True):
                            column.append(x)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                        place, start, length = place + n, start + n, length - n
            arrays = [batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(x, pa.int64()) for x in out)]
            names = ["doc_id", *(x.split()[0] for x in PIECES.split(", "))]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, weights: dict[str, int] | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents (doc_id, text, source) in full sequences; ids too if asked for.

    weights: target tokens by source, in any whole-number unit; a source without a weight
    comes after the others. The driver keeps one number for each source with a weight, and one for
    all others, whose cumulative amounts are a table: any number of sources has exact shares.
    """
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("none"))
    given = {f"={k}": int(v) for k, v in (weights or {}).items() if int(v) > 0}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), queue.alias("queue"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = written(spark, rows.mapInArrow(_tokenise(tokenizer_path), f"doc_id {kind}, queue string, part int, before long, doc_tokens long, ids binary"), "tokens")
    sums = written(spark, tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n")), "sums")
    weighted = F.col("queue").isin(list(given)) if given else F.lit(False)
    totals = {r[0]: r[1] for r in sums.where(weighted).groupBy("queue").agg(F.sum("n")).collect()}
    pool = sums.where(~weighted)
    rest = pool.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mixture = Mixture(totals, SEQUENCE * WINDOW_SEQUENCES, given, rest)
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_queue = pool.groupBy("queue").agg(F.sum("n").alias("n")).withColumn("group", F.pmod(F.xxhash64("queue"), F.lit(GROUPS)))
    groups = by_queue.groupBy("group").agg(F.sum("n").alias("n")).select("group", upto(Window.orderBy("group")).alias("earlier"))  # GROUPS rows at most
    within = upto(Window.partitionBy("group").orderBy("queue"))
    spans = by_queue.withColumn("within", within).join(F.broadcast(groups), "group").select("queue", (F.col("earlier") + F.col("within")).alias("low"), (F.col("earlier") + F.col("within") + F.col("n")).alias("high"))
    bases = sums.select("queue", "part", upto(Window.partitionBy("queue").orderBy("part")).alias("base")).join(spans, "queue", "left")
    placed = tokens.join(bases, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "doc_tokens", "ids", "low", "high")
    return placed.mapInArrow(_cut(mixture, with_ids), f"doc_id {kind}, {PIECES}" + ", ids array<int>" * with_ids)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read_table(spark, sf_dir, "documents"), tokenizer_file())
