"""Probe documents (JSON, or key=value lines) as typed columns; errors are values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = (
    "struct<format:struct<duration:string,size:string,format_name:string,tags:map<string,string>>,"
    "streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,pix_fmt:string,bit_rate:string,duration:string,avg_frame_rate:string,r_frame_rate:string,tags:map<string,string>>>>"
)


def parsed(json: Column) -> Column:
    return F.from_json(json, SCHEMA)


def key_values(text: Column) -> Column:
    """A map of key=value lines."""
    return F.str_to_map(F.trim(text), F.lit("\n"), F.lit("="))


def streams_of(doc: Column, kind: str) -> Column:
    return F.filter(F.coalesce(doc["streams"], F.array().cast("array<struct<codec_type:string,codec_name:string,width:int,height:int,pix_fmt:string,bit_rate:string,duration:string,avg_frame_rate:string,r_frame_rate:string,tags:map<string,string>>>")), lambda s: s["codec_type"] == kind)


def stream_counts(doc: Column) -> Column:
    return F.struct(*(F.size(streams_of(doc, k)).alias(k) for k in ("video", "audio", "subtitle")))


def duration(doc: Column) -> Column:
    """The container's, else the longest stream's, else 0."""
    longest = F.array_max(F.transform(doc["streams"], lambda s: s["duration"].try_cast("double")))
    return F.coalesce(doc["format"]["duration"].try_cast("double"), longest, F.lit(0.0))


def frame_rate(stream: Column) -> Column:
    """The average rate, else the nominal one; zero denominators are skipped; 0 if there is none."""

    def rate(text: Column) -> Column:
        n, d = (F.get(F.split(text, "/"), k).try_cast("double") for k in (0, 1))
        return F.nullif(n / F.nullif(F.coalesce(d, F.lit(1.0)), F.lit(0.0)), F.lit(0.0))

    return F.coalesce(rate(stream["avg_frame_rate"]), rate(stream["r_frame_rate"]), F.lit(0.0))


def codecs(doc: Column, kind: str) -> Column:
    return F.transform(streams_of(doc, kind), lambda s: F.lower(s["codec_name"]))


def audio_rates(doc: Column) -> Column:
    """What ``policy.planned_audio_kbps`` takes."""
    return F.transform(streams_of(doc, "audio"), lambda s: F.struct(F.lower(s["codec_name"]).alias("codec_name"), s["bit_rate"].alias("bit_rate"), F.coalesce(F.try_element_at(s["tags"], F.lit("BPS")), F.try_element_at(s["tags"], F.lit("bps"))).alias("bps")))


def metadata(doc: Column, timed_out: Column, failed: Column) -> Column:
    """struct(duration_s, width, height, error) of the first video stream; the first fault is the error."""
    video = F.get(streams_of(doc, "video"), 0)
    length = duration(doc)
    error = F.coalesce(
        F.when(timed_out, "timeout"), F.when(failed, "process_error"), F.when(doc.isNull(), "invalid_json"), F.when(video.isNull(), "no_video_stream"),
        F.when(~F.coalesce((video["width"] > 0) & (video["height"] > 0), F.lit(False)), "invalid_resolution"), F.when(~(length > 0), "invalid_duration"),
    )
    good = error.isNull()
    return F.struct(F.when(good, length).alias("duration_s"), F.when(good, video["width"]).alias("width"), F.when(good, video["height"]).alias("height"), error.alias("error"))


def merged(first: Column, second: Column) -> Column:
    """Two probes of an image: size and orientation from the second, flags from either, the second's hash before the first's; unreadable if the second is."""
    either = lambda k: F.coalesce(first[k], F.lit(False)) | F.coalesce(second[k], F.lit(False))
    turned = F.coalesce(second["exif_orientation"], F.lit(1)) >= 5
    w, h = (F.coalesce(second[k], first[k]) for k in ("width", "height"))
    return F.struct(
        F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"), F.coalesce(first["is_readable"] & second["is_readable"], second["is_readable"], first["is_readable"]).alias("is_readable"),
        either("has_alpha").alias("has_alpha"), either("has_icc").alias("has_icc"), F.coalesce(second["icc_sha256"], first["icc_sha256"]).alias("icc_sha256"),
        F.coalesce(first["bit_depth"], second["bit_depth"]).alias("bit_depth"), F.coalesce(first["error"], second["error"]).alias("error"),
    )


def pixel_limit_error(width: Column, height: Column, limit: int = 200_000_000) -> Column:
    return F.when(width.cast("long") * height > limit, "pixel_limit")


def missing_capabilities(required: Column, available: Column) -> Column:
    return F.array_except(required, available)
