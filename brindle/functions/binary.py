"""Kernels on bytes: signatures, perceptual hashes, image containers. Arrow UDFs where bytes are walked."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 64 * 1024


def signature(content: bytes, size: int | None = None) -> str:
    """A digest of the size and of a chunk at the start, the end and, beyond two chunks, the middle."""
    size = len(content) if size is None else size
    h = hashlib.blake2b(size.to_bytes(8, "little"), digest_size=16)
    starts = [0, max(0, size - CHUNK), *([size // 2 - CHUNK // 2] if size > 2 * CHUNK else [])]
    for at in dict.fromkeys(starts):
        h.update(at.to_bytes(8, "little") + content[at : at + CHUNK])
    return h.hexdigest()


@F.pandas_udf(T.StringType())
def fast_signature(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else signature(bytes(b)))


def _dct() -> np.ndarray:
    k, n = np.arange(32)[:, None], np.arange(32)[None, :]
    return (np.sqrt(np.where(k == 0, 1, 2) / 32) * np.cos(np.pi * (2 * n + 1) * k / 64)).astype(np.float32)


DCT = _dct()


def perceptual_hash(pixels: bytes) -> int:
    """Of 32 x 32 grey pixels: low frequencies over the median of all but the first, as signed 64 bits."""
    grid = np.frombuffer(pixels, np.uint8, 1024).reshape(32, 32).astype(np.float32)
    low = (DCT @ grid @ DCT.T)[:8, :8].ravel()
    return int(np.packbits(low > np.median(low[1:]), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def phash(pixels: pd.Series) -> pd.Series:
    return pixels.map(lambda b: None if b is None or len(b) != 1024 else perceptual_hash(bytes(b))).astype("Int64")


def average_hash(pixels: Column) -> Column:
    """Four longs with a bit for each of 256 pixels (an array of numbers) over their mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / F.size(pixels)
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: F.when(F.get(pixels, i + 64 * w) > mean, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(s))
    return F.array(*(word(w) for w in range(4)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def jpeg_segments(data: bytes) -> list[tuple[int, bytes]]:
    """(marker, body) up to the start of the scan; the scan and the rest under its marker. ValueError if damaged."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not_jpeg")
    at, out = 2, []
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("bad_marker")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA:
            if data[-2:] != b"\xff\xd9" and b"\xff\xd9" not in data[at:]:
                raise ValueError("no_end")
            return [*out, (marker, data[at + 2 :])]
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("bad_length")
        out.append((marker, data[at + 4 : at + 2 + size]))
        at += 2 + size


ICC_JPEG = b"ICC_PROFILE\x00"


def _kept(marker: int, body: bytes) -> bool:
    """Everything but comments and application data; of that, 0xE0, 0xEE and colour profiles stay."""
    return marker not in (0xFE, *range(0xE1, 0xF0)) or marker == 0xEE or (marker == 0xE2 and body.startswith(ICC_JPEG))


def sanitized_jpeg(data: bytes) -> tuple[bytes | None, bool, bool, str | None]:
    """(bytes, changed, has a profile, error) without metadata."""
    try:
        parts = jpeg_segments(data)
    except ValueError as e:
        return None, False, False, str(e)
    out = [b"\xff\xd8"]
    for marker, body in parts[:-1]:
        if _kept(marker, body):
            out.append(bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body)
    clean = b"".join(out) + b"\xff\xda" + parts[-1][1]
    return clean, clean != data, any(m == 0xE2 and b.startswith(ICC_JPEG) for m, b in parts), None


@F.pandas_udf(T.StructType().add("bytes", T.BinaryType()).add("changed", T.BooleanType()).add("has_icc", T.BooleanType()).add("error", T.StringType()))
def sanitize_jpeg(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sanitized_jpeg(bytes(b)) if b is not None else (None, False, False, "missing") for b in content], columns=["bytes", "changed", "has_icc", "error"])


def icc_profile(data: bytes) -> bytes | None:
    """The colour profile in a JPEG, PNG or WebP; None if there is none. ValueError if damaged."""
    if data[:2] == b"\xff\xd8":
        chunks = {b[12]: (b[13], b[14:]) for m, b in jpeg_segments(data) if m == 0xE2 and b.startswith(ICC_JPEG) and len(b) > 14}
        if not chunks:
            return None
        if sorted(chunks) != list(range(1, next(iter(chunks.values()))[0] + 1)):
            raise ValueError("icc_chunks")
        return b"".join(chunks[k][1] for k in sorted(chunks))
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
                raise ValueError("png_crc")
            if kind == b"iCCP":
                return zlib.decompress(body.partition(b"\x00")[2][1:])
            if kind in (b"IDAT", b"IEND"):
                return None
            at += 12 + size
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"ICCP":
                return data[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
    return None


@F.pandas_udf(T.StructType().add("sha256", T.StringType()).add("error", T.StringType()))
def icc_sha256(content: pd.Series) -> pd.DataFrame:
    def one(b: bytes | None) -> tuple[str | None, str | None]:
        try:
            profile = icc_profile(bytes(b)) if b is not None else None
        except (ValueError, zlib.error) as e:
            return None, str(e)
        return (hashlib.sha256(profile).hexdigest() if profile is not None else None), None

    return pd.DataFrame([one(b) for b in content], columns=["sha256", "error"])


def decoded_text(data: bytes) -> str:
    """In the first encoding that fits: UTF-8 with or without mark, UTF-16, code page 1252, Latin-1."""
    for name in ("utf-8-sig", "utf-16", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeError:
            continue
    return data.decode("latin-1")


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else decoded_text(bytes(b)))


def keyed_xor(key: bytes):
    """A UDF: bytes XORed with a repeating key."""

    @F.pandas_udf(T.BinaryType())
    def xor(content: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> bytes | None:
            if b is None:
                return None
            x = np.frombuffer(bytes(b), np.uint8)
            return (x ^ np.resize(np.frombuffer(key, np.uint8), len(x))).tobytes()

        return content.map(one)

    return xor
