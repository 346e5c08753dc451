"""Sizes, durations and dimensions as columns. Halves round to even; in sizes only those that are exact in binary are halves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(x: Column, decimals: int) -> Column:
    """A double with so many decimals, by its exact binary value as C and Python print it: 1.015 is under its tie.

    bround and format_string go by the shortest decimal text, in which 1.015 is a tie.
    """
    return F.call_function("format_number", x, F.lit("0." + "0" * decimals))


def _scaled(size: Column, step: int, units: tuple[str, ...], decimals: int, whole_bytes: bool, signed: bool) -> Column:
    """The first unit in which the size is under one step; the last one holds the rest."""
    n = size.cast("double")
    magnitude = F.abs(n) if signed else n
    out = None
    for k in reversed(range(len(units))):
        text = F.format_string("%d " + units[k], n.cast("long")) if k == 0 and whole_bytes else F.concat(_fixed(n / F.lit(float(step**k)), decimals), F.lit(f" {units[k]}"))
        out = text if out is None else F.when(magnitude < float(step ** (k + 1)), text).otherwise(out)
    return out


def size_catalog(size: Column) -> Column:
    """1024 steps to PB, whole bytes, two decimals; under zero counts as zero."""
    return _scaled(F.greatest(size, F.lit(0)), 1024, ("B", "KB", "MB", "GB", "TB", "PB"), 2, True, False)


def size_remux(size: Column) -> Column:
    """KiB steps to TiB, one decimal, bytes too."""
    return _scaled(size, 1024, ("B", "KiB", "MiB", "GiB", "TiB"), 1, False, True)


def size_budget(size: Column) -> Column:
    """KiB steps to PiB, two decimals, bytes too."""
    return _scaled(size, 1024, ("B", "KiB", "MiB", "GiB", "TiB", "PiB"), 2, False, True)


def size_image(size: Column, binary: bool = False) -> Column:
    """Decimal or binary steps to TB, whole bytes; a minus sign before negative sizes; n/a for null."""
    units = ("B", "KiB", "MiB", "GiB", "TiB") if binary else ("B", "KB", "MB", "GB", "TB")
    text = _scaled(F.abs(size), 1024 if binary else 1000, units, 2, True, False)
    return F.when(size.isNull(), "n/a").when(size < 0, F.concat(F.lit("-"), text)).otherwise(text)


def size_converter(size: Column) -> Column:
    """1024 steps to TB, two decimals, bytes too."""
    return _scaled(size, 1024, ("B", "KB", "MB", "GB", "TB"), 2, False, False)


def _parts(total: Column) -> tuple[Column, Column, Column]:
    return F.floor(total / 3600), F.floor(total / 60) % 60, total % 60


def duration_clock(seconds: Column) -> Column:
    """HH:MM:SS or MM:SS of the rounded seconds; negative counts as zero."""
    h, m, s = _parts(F.greatest(F.bround(seconds.cast("double")).cast("long"), F.lit(0)))
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def duration_truncated(seconds: Column) -> Column:
    """HH:MM:SS or MM:SS of the whole seconds; --:-- for negative ones."""
    h, m, s = _parts(seconds.cast("long"))
    return F.when(seconds < 0, "--:--").when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def duration_words(seconds: Column) -> Column:
    """12.3s, 2m 03s or 1h 02m 03s."""
    x = F.greatest(seconds.cast("double"), F.lit(0.0))
    h, m, s = _parts(x.cast("long"))
    return F.when(x < 60, F.format_string("%.1fs", F.bround(x, 1))).when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).otherwise(F.format_string("%dm %02ds", m, s))


def eta(seconds: Column) -> Column:
    h, m, s = _parts(F.greatest(F.bround(seconds.cast("double")).cast("long"), F.lit(0)))
    text = F.when(h > 0, F.format_string("ETA: ~%dh %02dm", h, m)).when(m > 0, F.format_string("ETA: ~%dm %02ds", m, s)).otherwise(F.format_string("ETA: ~%ds", s))
    return F.coalesce(text, F.lit("ETA: --"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def even_dimension(x: Column) -> Column:
    """At least 2; halves to even, then odd numbers up to even ones."""
    n = F.greatest(F.lit(2), F.bround(x.cast("double")).cast("int"))
    return n + n % 2


def parse_dimensions(text: Column) -> Column:
    """struct(width, height) of WxH, made even; null if it isn't one."""
    pattern = "^\\s*(\\d+)\\s*[xX]\\s*(\\d+)\\s*$"
    sides = [F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2)]
    good = text.rlike(pattern) & (sides[0] > 0) & (sides[1] > 0)
    return F.when(good, F.struct(even_dimension(sides[0]).alias("width"), even_dimension(sides[1]).alias("height")))


#: Bytes that a website's limit loses to headroom, and the target to safety.
LIMIT_HEADROOM, LIMIT_SAFETY = 50_000, 10_000


def parse_size_limit(text: Column) -> Column:
    """struct(strict_max_bytes, preferred_target_bytes) of a limit in MB; null if it isn't one."""
    pattern = "(?i)^\\s*(\\d+(?:[.,]\\d+)?)\\s*(?:mb)?\\s*$"
    mb = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("decimal(20,6)")
    strict = F.floor(mb * 1_000_000).cast("long") - LIMIT_HEADROOM
    return F.when(text.rlike(pattern), F.struct(strict.alias("strict_max_bytes"), (strict - LIMIT_SAFETY).alias("preferred_target_bytes")))


def content_size(content_length: Column, content_range: Column) -> Column:
    """The total after the slash of a range, else the length."""
    return F.coalesce(F.element_at(F.split(content_range, "/"), -1).try_cast("long"), content_length.try_cast("long"))
