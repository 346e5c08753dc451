"""Size and quality policies, estimates and bitrate budgets as columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.formatting import clamp

#: The default limit of 5 MB, thresholds and tables of the policies.
STRICT_MAX, PREFERRED = 4_950_000, 4_940_000
CODEC_EFFICIENCY = {"h264": 1.0, "avc": 1.0, "hevc": 1.8, "h265": 1.8, "av1": 2.5, "vp9": 2.2, "vp8": 1.3, "mpeg4": 0.7, "mpeg2video": 0.5}
H264 = ["h264", "avc", "avc1", "avc3"]
AUDIO_COPY = ["aac", "alac", "mp3", "ac3", "eac3", "opus"]
SUBTITLE_COPY = ["mov_text", "tx3g", "webvtt"]
SUBTITLE_TEXT = ["subrip", "srt", "ass", "ssa", "webvtt", "mov_text", "tx3g", "text", "microdvd", "mpl2", "sami", "realtext", "subviewer"]
SUBTITLE_IMAGE = ["hdmv_pgs_subtitle", "dvd_subtitle", "dvdsub", "pgssub", "xsub", "dvb_subtitle"]
QUALITY_STEPS = [(95, 2), (90, 3), (85, 4), (80, 5), (75, 6), (70, 7), (65, 8), (60, 10), (55, 12), (50, 14), (45, 16), (40, 18), (35, 20)]
NEED_BOUNDS = [(55, 20, 74), (40, 24, 82), (25, 30, 88), (10, 36, 93)]
DEFAULT_AUDIO_KBPS, TARGET_BYTES, LIMIT_BYTES, OVERHEAD, SAFETY = 128, 3800 * 1024**2, 4 * 1024**3, 0.98, 0.97
SAMPLE_SECONDS, SAMPLE_POINTS = 10.0, [0.10, 0.30, 0.50, 0.70, 0.90]


def acceptable(size: Column, strict_max: int = STRICT_MAX) -> Column:
    return (size > 0) & (size < strict_max)


def preferred(size: Column, target: int = PREFERRED) -> Column:
    return (size > 0) & (size < target)


def reduction_needed(size: Column, target: int = PREFERRED) -> Column:
    """Per cent of the size that has to go to reach the target."""
    return F.when(size > 0, F.greatest(F.lit(0.0), (size - target) * 100.0 / size)).otherwise(0.0)


def potential(readable: Column, size: Column, width: Column, height: Column, strict_max: int = STRICT_MAX, target: int = PREFERRED) -> Column:
    """How hard it is to get under the limit."""
    need = reduction_needed(size, target)
    bpp = F.coalesce(F.when((width > 0) & (height > 0), size * 8.0 / (width.cast("double") * height)), F.lit(0.0))
    return (
        F.when(~readable, "unreadable").when(size < strict_max, "already_ok").when((need < 10) & (bpp > 4), "easy")
        .when(need < 25, "moderate").when((need < 45) | (bpp > 3), "challenging").otherwise("difficult")
    )


def codec_efficiency(codec: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CODEC_EFFICIENCY.items()))
    return F.coalesce(F.try_element_at(table, F.lower(codec)), F.lit(1.0))


def quality_class(kbps: Column, width: Column, height: Column, fps: Column, codec: Column) -> Column:
    """struct(bpp, effective_bpp, category, should_warn)."""
    known = (width > 0) & (height > 0) & (fps > 0) & (kbps > 0)
    bpp = F.when(known, kbps * 1000.0 / (width * height * fps)).otherwise(0.0)
    effective = bpp * codec_efficiency(codec)
    category = F.when(~known | known.isNull(), "unknown").when(effective > 0.3, "high").when(effective >= 0.15, "medium").when(effective >= 0.08, "compressed").otherwise("heavily_compressed")
    return F.struct(bpp.alias("bpp"), effective.alias("effective_bpp"), category.alias("category"), category.isin("compressed", "heavily_compressed").alias("should_warn"))


def audio_copyable(codecs: Column) -> Column:
    """True too if there are none."""
    return F.forall(codecs, lambda c: c.isin(AUDIO_COPY))


def stream_copyable(video_codec: Column, audio_codecs: Column) -> Column:
    return F.lower(video_codec).isin(H264) & audio_copyable(audio_codecs)


def subtitle_plan(codecs: Column) -> Column:
    """none, drop, copy or mov_text, in this order of precedence."""
    return (
        F.when(F.size(codecs) <= 0, "none").when(F.exists(codecs, lambda c: c.isin(SUBTITLE_IMAGE)), "drop")
        .when(F.forall(codecs, lambda c: c.isin(SUBTITLE_COPY)), "copy")
        .when(F.forall(codecs, lambda c: c.isin(SUBTITLE_TEXT + SUBTITLE_COPY)), "mov_text").otherwise("drop")
    )


def remux_decision(video_codec: Column, audio_codecs: Column, size: Column, limit: int = LIMIT_BYTES) -> Column:
    return F.when(stream_copyable(video_codec, audio_codecs) & (size <= limit), "FAST_REMUX").otherwise("ENCODE")


def quality_to_q(quality: Column) -> Column:
    """The encoder's scale from 1 (best) to 28."""
    q = clamp(quality.cast("int"), 1, 100)
    out = None
    for least, step in QUALITY_STEPS:
        out = F.when(q >= least, step) if out is None else out.when(q >= least, step)
    return out.otherwise(clamp(F.bround(2 + (100 - q) * F.lit(0.28)).cast("int"), 1, 28))


def quality_bounds(need: Column) -> Column:
    """struct(low, high): where to search, by the reduction that is needed."""
    pair = lambda a, b: F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"))
    out = None
    for least, low, high in NEED_BOUNDS:
        out = F.when(need >= least, pair(low, high)) if out is None else out.when(need >= least, pair(low, high))
    return out.otherwise(pair(35, 97))


def estimate_bytes(size: Column, quality: Column, codec: str = "JPG", scale: float = 1.0, strip_metadata: bool = True) -> Column:
    """Bytes after encoding, at least 1024."""
    q = clamp(quality, 1, 100) / 100.0
    meta = {"PNG": 0.97}.get(codec, 0.985) if strip_metadata else 1.0
    curve = {"PNG": F.when(quality >= 100, 0.97).otherwise(0.35 + 0.65 * q), "WEBP": 0.18 + 0.82 * F.pow(q, F.lit(1.25))}.get(codec, 0.22 + 0.78 * F.pow(q, F.lit(1.35)))
    return F.greatest(F.lit(1024), (size * curve * max(0.05, scale**2) * meta).cast("long"))


def max_quality_under(size: Column, target: Column, codec: str = "JPG", low: int = 35, high: int = 97) -> Column:
    """The best quality whose estimate is under the target; null if none is."""
    qualities = F.sequence(F.lit(low), F.lit(high))
    return F.array_max(F.filter(qualities, lambda q: estimate_bytes(size, q, codec) < target))


def stream_kbps(bit_rate: Column, bps_tag: Column, default: int = DEFAULT_AUDIO_KBPS) -> Column:
    rate = lambda x: F.greatest(F.lit(1), (x.try_cast("double") / 1000).cast("int"))
    return F.coalesce(F.when(bit_rate.try_cast("double").isNotNull(), rate(bit_rate)), F.when(bps_tag.try_cast("double").isNotNull(), rate(bps_tag)), F.lit(default))


def planned_audio_kbps(streams: Column) -> Column:
    """streams: array of struct(codec_name, bit_rate, bps)."""
    rates = F.transform(streams, lambda s: stream_kbps(s["bit_rate"], s["bps"]))
    total = F.aggregate(rates, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(streams) <= 0, 0).when(audio_copyable(F.transform(streams, lambda s: s["codec_name"])), total).otherwise(DEFAULT_AUDIO_KBPS * F.size(streams))


def target_kbps(duration: Column, audio_kbps: Column, target: int = TARGET_BYTES) -> Column:
    """Video kbit/s that fill the target; MiB count as MB here. Null without a duration."""
    total = F.lit(target / 1024**2 * 8000 * OVERHEAD) / duration * SAFETY
    return F.when(duration > 0, F.greatest(total - F.greatest(audio_kbps, F.lit(0)), F.lit(100.0)).cast("int"))


def retry_kbps(old: Column, actual: Column, target: int = TARGET_BYTES) -> Column:
    return F.greatest(F.lit(100), (old * (F.lit(float(target)) / actual) * 0.95).cast("int"))


def video_kbps(stream_rate: Column, size: Column, duration: Column, audio_kbps: Column) -> Column:
    """The stream's own rate, else what the size leaves after audio, at least 100."""
    derived = F.when((size > 0) & (duration > 0), F.greatest(F.lit(100), (size * 8 / duration / 1000 - audio_kbps).cast("int")))
    return F.coalesce(F.when(stream_rate > 0, (stream_rate / 1000).cast("int")), derived, F.lit(0))


def sample_starts(duration: Column, clip: float = SAMPLE_SECONDS) -> Column:
    """Where to take clips from: one, two or five, none within half a second of the one before."""
    points = F.transform(F.array(*map(F.lit, SAMPLE_POINTS)), lambda p: F.when(duration * p + clip > duration, F.greatest(F.lit(0.0), duration - clip)).otherwise(duration * p))
    none = F.array().cast("array<double>")
    spread = F.aggregate(points, none, lambda out, x: F.when((F.size(out) > 0) & (F.abs(F.try_element_at(out, F.lit(-1)) - x) <= 0.5), out).otherwise(F.concat(out, F.array(x))))
    return F.when(duration <= clip, F.array(F.lit(0.0))).when(duration <= 2 * clip, F.array(F.lit(0.0), F.greatest(F.lit(0.0), duration - clip))).otherwise(spread)


def interpolated(x1: Column, y1: Column, x2: Column, y2: Column, y: Column) -> Column:
    """x at which the line through (x1, ln y1) and (x2, ln y2) reaches ln y; null if there is none."""
    slope = (F.ln(y1) - F.ln(y2)) / (x1 - x2)
    return F.when((y1 > 0) & (y2 > 0) & (y1 != y2) & (x1 != x2), x1 + (F.ln(y) - F.ln(y1)) / slope)


def log_interpolation(points: Column, target: Column, factor: Column) -> Column:
    """points: array of struct(x, y); x for the target on the pair around it, or on the outer pair."""
    goal = F.greatest(target, F.lit(1.0))

    def on(scaled: Column) -> Column:
        pairs = F.zip_with(F.slice(scaled, F.lit(1), F.size(scaled) - 1), F.slice(scaled, F.lit(2), F.size(scaled) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        sizes = F.transform(scaled, lambda p: p["y"])
        around = lambda ps: F.get(F.filter(ps, lambda p: (F.least(p["a"]["y"], p["b"]["y"]) <= goal) & (goal <= F.greatest(p["a"]["y"], p["b"]["y"]))), 0)
        outer = lambda ps: F.when(goal > F.array_max(sizes), F.get(ps, 0)).when(goal < F.array_min(sizes), F.try_element_at(ps, F.lit(-1)))
        line = lambda p: interpolated(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"], goal)
        return F.when(F.size(scaled) >= 2, let(let(pairs, lambda ps: F.coalesce(around(ps), outer(ps))), line))

    valid = F.array_sort(F.filter(points, lambda p: p["y"] > 0))
    return let(F.transform(valid, lambda p: F.struct(p["x"].cast("double").alias("x"), (p["y"] * factor).alias("y"))), on)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def feasibility(estimate: Column, least_size: Column, most_size: Column, target: Column, limit: Column, crf_max: float = 51.0) -> Column:
    """struct(can_reach, is_feasible, suggest_scale, warning, bitrate_scale) from an estimated rate factor and the sizes at the ends of the probe."""
    hard = F.coalesce((estimate > crf_max) | (least_size > target), least_size > target)
    warning = F.when(hard, "difficult").when(estimate > 45, "very_low_quality").when(estimate > 40, "low_quality")
    room = target / most_size
    scale = F.when((most_size > 0) & (room < 0.85), F.greatest(F.lit(0.55), F.least(F.lit(1.0), room * 0.95))).when((most_size > 0) & (room > 1.4) & (estimate.isNull() | (estimate < 28)), F.least(F.lit(1.15), room * 0.5 + 0.5)).otherwise(1.0)
    return F.struct(F.when(hard, least_size <= limit).otherwise(True).alias("can_reach"), (~hard).alias("is_feasible"), hard.alias("suggest_scale"), warning.alias("warning"), scale.alias("bitrate_scale"))


def recommended_strategy(over: Column, hard: Column, average_over: Column) -> Column:
    """From a summary: files over the limit, those that are difficult or challenging, mean size of those over."""
    return F.when(over == 0, "none").when(hard >= F.greatest(F.lit(1), F.floor(over / 3)), "thorough").when((over <= 5) | (average_over < 7 * 1024**2), "careful").otherwise("fast")


def shrink_step(width: Column, height: Column, least: int = 640, factor: float = 0.95) -> Column:
    """The next smaller even canvas, or null when nothing changes."""
    from brindle.functions.formatting import even_dimension

    f = F.greatest(F.lit(factor), least / F.least(width, height))
    w, h = (F.greatest(F.lit(least), even_dimension(x * f)) for x in (width, height))
    return F.when((w != width) | (h != height), F.struct(w.alias("width"), h.alias("height")))


def palette_quality(colours: Column) -> Column:
    """struct(quality, lossless) that stands for a palette of so many colours; lossless at full quality for none."""
    quality = F.when(colours.isNull(), 100).otherwise(clamp(F.bround(colours / 256.0 * 94).cast("int"), 1, 94))
    return F.struct(quality.alias("quality"), colours.isNull().alias("lossless"))


def first_error(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that holds; null if none does."""
    return F.coalesce(*(F.when(condition, code) for condition, code in checks))


def verify_remux(source_duration: Column, duration: Column, source: dict[str, Column], out: dict[str, Column]) -> Column:
    """The reason why an output doesn't match its source; null if it does."""
    close = F.when(source_duration.isNull() & duration.isNull(), True).when(source_duration.isNull() | duration.isNull(), False).otherwise(F.abs(source_duration - duration) <= F.greatest(F.lit(1.0), 0.01 * F.abs(source_duration)))
    return first_error((~close, "duration_mismatch"), (source["video"] != out["video"], "video_streams"), (source["audio"] != out["audio"], "audio_streams"), (out["subtitle"] > source["subtitle"], "subtitle_streams"))


def verify_output(expected: dict[str, Column], actual: dict[str, Column], strict_max: int = STRICT_MAX) -> Column:
    """The first fault of an encoded image: codec, dimensions, alpha, profile, size."""
    icc = expected["icc_sha256"]
    return first_error(
        (~actual["is_readable"], "unreadable"),
        (expected["codec"] != actual["codec"], "codec_mismatch"),
        ((expected["width"] != actual["width"]) | (expected["height"] != actual["height"]), "dimension_mismatch"),
        (expected["has_alpha"] & ~actual["has_alpha"], "alpha_lost"),
        ((actual["codec"] == "JPG") & actual["has_alpha"], "jpeg_with_alpha"),
        (icc.isNotNull() & actual["icc_sha256"].isNull(), "icc_missing"),
        (icc.isNull() & actual["icc_sha256"].isNotNull(), "icc_unexpected"),
        (icc.isNotNull() & (icc != actual["icc_sha256"]), "icc_changed"),
        (~acceptable(actual["size"], strict_max), "size_over_limit"),
    )


def source_codec(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))
    return F.when(suffix.isin(".jpg", ".jpeg", ".jpe", ".jfif"), "JPG").when(suffix == ".webp", "WEBP").otherwise("PNG")


def bit_depth(pixel_format: Column) -> Column:
    """Bits of a component from a pixel format's name: 8 where it says nothing."""
    p = F.lower(pixel_format)
    return F.coalesce(F.nullif(F.regexp_extract(p, "(?:p|gray|gbrp|gbrap)(9|10|12|14|16)(?:le|be)?$", 1), F.lit("")).cast("int"), F.when(p.rlike("(48|64)(le|be)$"), 16), F.lit(8))


def has_alpha(pixel_format: Column) -> Column:
    return F.lower(pixel_format).rlike("^(rgba|argb|bgra|abgr|ya\\d|yuva|gbrap|pal8)")


def chroma(pixel_format: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(pixel_format), "yuva?j?(4[124][0-4])", 1), F.lit("")), F.lit("none"))


def encoders(image: dict[str, Column], has_library: bool = True, prefer_library: bool = False, strip_metadata: bool = True, keep_icc: bool = True, progressive: bool = False) -> Column:
    """struct(order, error): which encoders to try, library or tool, or why there is none.

    image: codec, has_icc, has_alpha, bit_depth, orientation and colours (of a palette, or null).
    """
    codec, png, jpg = image["codec"], image["codec"] == "PNG", image["codec"] == "JPG"
    icc, palette, deep = F.lit(keep_icc) & image["has_icc"], png & image["colours"].isNotNull(), png & (F.coalesce(image["bit_depth"], F.lit(0)) > 8)
    needs_library = F.lit(not strip_metadata) | icc | (jpg & image["has_alpha"])
    error = first_error((F.lit(not has_library) & needs_library, "library_required"), (F.lit(not has_library) & palette, "library_required_for_palette"), (deep & icc, "deep_png_with_profile"))
    names = lambda *x: F.array(*map(F.lit, x))
    library_first = F.lit(prefer_library) | png | needs_library | (F.lit(progressive) & jpg) | ~codec.isNull() & ~image["orientation"].isin(0, 1)
    order = F.when(deep, names("tool")).when(F.lit(not has_library), names("tool")).when(needs_library | palette, names("library")).when(library_first, names("library", "tool")).otherwise(names("tool", "library"))
    return F.struct(F.when(error.isNull(), order).alias("order"), error.alias("error"))


def under_limit(is_jpeg: Column, cleaned: Column, changed: Column, icc_kept: Column, size: Column, copy: bool = True, dry_run: bool = False, strip: bool = True) -> Column:
    """struct(status, variant) of an image that is small enough: sanitised only if that worked, changed something and kept the profile."""
    tried = F.lit(strip) & is_jpeg
    good = tried & cleaned & icc_kept
    variant = F.when(good & changed, "marker-sanitized").when((tried & ~good) | (F.lit(strip) & ~is_jpeg), "exact-copy-metadata-retained").otherwise("exact-copy")
    status = F.when(F.lit(not copy), "skipped_under_limit").when(F.lit(dry_run), "dry_run").when(~acceptable(size), "encode").when(good & changed, "sanitized").otherwise("copied")
    return F.struct(status.alias("status"), F.when(status.isin("sanitized", "copied"), variant).alias("variant"))


def final_webp(codec: Column, backend: Column, method: Column, size: Column, final_size: Column, final_method: int = 6) -> Column:
    """Bytes to keep: the retry's at the final method if there is one to make and it is acceptable, else the best so far."""
    retried = (codec == "WEBP") & (backend != "copy") & (method != final_method)
    return F.when(retried & acceptable(final_size), final_size).otherwise(size)


def attempt_key(codec: Column, quality: Column, scale: Column, width: Column, height: Column, lossless: Column, method: Column, colours: Column) -> Column:
    """What tells attempts apart: settings that don't matter for a codec are left out."""
    effective = F.when((codec == "PNG") & colours.isNotNull(), F.concat(F.lit("palette:"), colours.cast("string"))).when(codec == "PNG", "lossless").when((codec == "WEBP") & lossless, F.concat(F.lit("lossless:"), method.cast("string"))).otherwise(F.concat(F.lit("quality:"), quality.cast("string")))
    return F.struct(codec.alias("codec"), effective.alias("setting"), F.round(scale, 6).alias("scale"), width.alias("width"), height.alias("height"))


#: What stays free of a disk, as a share and in bytes; the longest path.
DISK_SHARE, DISK_BYTES, PATH_LIMIT = 0.05, 2 * 1024**3, 250


def admitted(free: Column, total: Column, in_flight: Column, need: Column) -> Column:
    """Whether a job that needs so many bytes leaves the margin free."""
    return free - in_flight - need >= F.greatest(total * DISK_SHARE, F.lit(float(DISK_BYTES)))


def path_fits(path: Column, limit: int = PATH_LIMIT) -> Column:
    return F.char_length(path) <= limit
