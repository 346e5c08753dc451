"""Media columns: MPEG transport streams (ISO/IEC 13818-1) in binary columns.

``store`` puts payloads into streams: a program table (PAT) and a map (PMT), then elementary
packets (PES) with time stamps, cut into packets of 188 bytes with continuity counters; every
tenth access unit is a random-access point. ``parse`` reads any such stream back: it assembles
the tables and checks their checksums, finds the elementary streams, checks the continuity
counters (one repeated packet is dropped, a gap is counted unless it is announced), reassembles
the elementary packets and keeps each one's time stamp, size and random-access flag.

Rows: a null or empty text is an empty payload, padded like any other; repeated rows give equal
values; null ids are carried along; an empty table gives no rows; further columns of the input
are ignored. Damaged streams never raise: packets without sync byte are counted and skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import read_table, written

PACKET, SYNC = 188, 0x47
#: Payloads are padded with spaces to a multiple of this.
UNIT = 192
PMT_PID, MEDIA_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0101, 1, 0x06
#: The first packet of an access unit has room for 176 bytes beside its clock, the others for 184.
FIRST_ROOM, ROOM, PES_HEADER = 176, 184, 14
ACCESS_UNIT = FIRST_ROOM + 84 * ROOM - PES_HEADER
CLOCK, SAMPLES = 90_000, 48_000
RANDOM_ACCESS_EVERY = 10


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """A packet with one section."""
    length = len(body) + 9
    section = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table(0, 0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255])) + _table(PMT_PID, 2, PROGRAM, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0]))


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream with the payload as 8-bit samples of one elementary stream."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        unit = payload[at : at + ACCESS_UNIT]
        t = at * CLOCK // SAMPLES & (1 << 33) - 1
        data = b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t) + unit
        n = 1 + max(0, -(-(len(data) - FIRST_ROOM) // ROOM))
        packets = np.full((n, PACKET), 255, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        first = data[:FIRST_ROOM]
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4:12] = list(bytes([PACKET - 5 - len(first), 0x10 | 0x40 * (k % RANDOM_ACCESS_EVERY == 0)]) + (t << 15 | 0x7E00).to_bytes(6, "big"))
        packets[0, PACKET - len(first) :] = np.frombuffer(first, np.uint8)
        full = max(0, len(data) - FIRST_ROOM) // ROOM
        packets[1 : 1 + full, 4:] = np.frombuffer(data, np.uint8, full * ROOM, min(FIRST_ROOM, len(data))).reshape(full, ROOM)
        if rest := data[FIRST_ROOM + full * ROOM :]:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = PACKET - 5 - len(rest)
            if len(rest) < ROOM - 1:
                packets[-1, 5] = 0
            packets[-1, PACKET - len(rest) :] = np.frombuffer(rest, np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    packets: int = 0
    damaged: int = 0
    repeated: int = 0
    gaps: int = 0
    bad_tables: int = 0
    #: (pid, presentation time or None, decoding time or None, random access, payload)
    units: list[tuple[int, int | None, int | None, bool, bytes]] = field(default_factory=list)


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _sections(out: Stream, packets: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """Whole sections with right checksums."""
    held = b""
    for row, start, at in zip(packets, starts, offsets, strict=True):
        body = row[at:].tobytes()
        if start and body:
            tail, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            parts = [held + tail, body] if held else [body]
        else:
            parts = [held + body] if held else []
        held = b""
        for part in parts:
            while len(part) >= 3 and part[0] != 0xFF and len(part) >= (n := 3 + ((part[1] & 15) << 8 | part[2])):
                if crc32_mpeg(part[:n]):
                    out.bad_tables += 1
                else:
                    yield part[:n]
                part = part[n:]
            held = part if part and part[0] != 0xFF else b""


def demux(data: bytes) -> Stream:
    out = Stream()
    packets = np.frombuffer(data, np.uint8, len(data) // PACKET * PACKET).reshape(-1, PACKET)
    good = (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0)
    out.packets, out.damaged = len(packets), int((~good).sum()) + (len(data) % PACKET > 0)
    packets = packets[good]
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    starts, control, counters = packets[:, 1] & 0x40 > 0, packets[:, 3] >> 4 & 3, packets[:, 3] & 15
    adapted = control & 2 > 0
    lengths = np.where(adapted, packets[:, 4], 0).astype(np.int64)
    flags = np.where(adapted & (lengths > 0), packets[:, 5], 0)
    offsets = np.minimum(4 + adapted + lengths, PACKET)
    filled = control & 1 > 0

    def of(pid: int) -> np.ndarray:
        return np.flatnonzero((pids == pid) & filled)

    at = of(0)
    maps: dict[int, int] = {}
    for s in _sections(out, packets[at], starts[at], offsets[at]):
        if s[0] == 0:
            for k in range(8, len(s) - 4, 4):
                if number := s[k] << 8 | s[k + 1]:
                    maps[(s[k + 2] & 31) << 8 | s[k + 3]] = number
    for pid in maps:
        at = of(pid)
        for s in _sections(out, packets[at], starts[at], offsets[at]):
            if s[0] != 2:
                continue
            k, streams = 12 + ((s[10] & 15) << 8 | s[11]), out.programs.setdefault(s[3] << 8 | s[4], {})
            while k + 5 <= len(s) - 4:
                streams[(s[k + 1] & 31) << 8 | s[k + 2]] = s[k]
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    for pid in dict.fromkeys(pid for streams in out.programs.values() for pid in streams):
        _units(out, pid, of(pid), packets, starts, counters, flags, offsets)
    return out


def _units(out: Stream, pid: int, at: np.ndarray, packets: np.ndarray, starts: np.ndarray, counters: np.ndarray, flags: np.ndarray, offsets: np.ndarray) -> None:
    """Check the counters of an elementary stream and reassemble its elementary packets."""
    if len(at) > 1:
        step = (counters[at[1:]].astype(np.int16) - counters[at[:-1]]) & 15
        again = (step == 0) & (packets[at[1:]] == packets[at[:-1]]).all(axis=1)
        out.repeated += int(again.sum())
        out.gaps += int(((step != 1) & ~again & (flags[at[1:]] & 0x80 == 0)).sum())
        at = at[np.append(True, ~again)]
    begins = np.flatnonzero(starts[at])
    if not len(begins):
        return
    at = at[begins[0] :]
    begins = begins - begins[0]
    own = offsets[at]
    body = packets[at][np.arange(PACKET) >= own[:, None]].tobytes()
    ends = np.append(0, np.cumsum(PACKET - own))
    bounds = [*ends[begins].tolist(), len(body)]
    for first, a, b in zip(at[begins].tolist(), bounds, bounds[1:], strict=False):
        head = body[a : a + 19]
        if len(head) < 9 or head[:3] != b"\x00\x00\x01":
            out.damaged += 1
            continue
        size = head[4] << 8 | head[5]
        end = min(b, a + 6 + size) if size else b
        stamps = head[7] >> 6
        pts = _time(head[9:14]) if stamps & 2 and len(head) >= 14 else None
        dts = _time(head[14:19]) if stamps == 3 and len(head) >= 19 else pts
        out.units.append((pid, pts, dts, bool(flags[first] & 0x40), body[a + 9 + head[8] : end]))


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            doc_ids, texts = (c.slice(lo, 256) for c in batch.columns)
            texts = texts.to_pylist()
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text in a transport stream."""
    return docs.select("doc_id", "text").mapInArrow(_store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


UNITS = "array<struct<pid:int,pts:bigint,dts:bigint,random_access:boolean,size:bigint>>"
PARSED = f"programs map<int,map<int,int>>, packets long, damaged long, repeated long, gaps long, bad_tables long, units {UNITS}, payload binary"


def _parse(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.map_(pa.int32(), pa.int32())
        unit = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("size", pa.int64())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [demux(m.as_py() or b"") for m in part.column(0)]
                counts = [pa.array([getattr(s, k) for s in found], pa.int64()) for k in ("packets", "damaged", "repeated", "gaps", "bad_tables")]
                programs = pa.array([[(k, list(v.items())) for k, v in s.programs.items()] for s in found], pa.map_(pa.int32(), numbers))
                units = pa.array([[dict(zip(("pid", "pts", "dts", "random_access", "size"), (*u[:4], len(u[4])), strict=True)) for u in s.units] for s in found], pa.list_(unit))
                payloads = pa.array([b"".join(u[4] for u in s.units) for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, programs, *counts, units, payloads], names=[*names, "programs", "packets", "damaged", "repeated", "gaps", "bad_tables", "units", "payload"])

    return run


def parse(streams: DataFrame, media: str = "media") -> DataFrame:
    """The columns of streams, and programs, counts of packets and faults, units and payload."""
    names = [media, *(c for c in streams.columns if c != media)]
    kept = ", ".join(f"`{c}` {streams.schema[c].dataType.simpleString()}" for c in names)
    return streams.select(*names).mapInArrow(_parse(names), f"{kept}, {PARSED}")


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(spark, store(read_table(spark, sf_dir, "documents")), "media")
    rows = parse(media)
    feature = F.format_string(
        "programs=%d;packets=%d;damaged=%d;gaps=%d;units=%d;random_access=%d;pts=%d-%d",
        F.size("programs"), "packets", "damaged", "gaps", F.size("units"), F.size(F.filter("units", lambda u: u["random_access"])), F.array_min(F.transform("units", lambda u: u["pts"])), F.array_max(F.transform("units", lambda u: u["pts"])),
    )
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
