"""Plans: what to move, skip or encode, as tables. Nothing is ever moved or deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import policy
from brindle.functions.names import episode_code, split_extensions
from brindle.operators.clustering import anchored_clusters


def _plan(df: DataFrame, action: Column, source: Column, target: Column, reason: Column) -> DataFrame:
    return df.select(action.alias("action"), source.alias("src"), target.alias("dst"), reason.alias("reason"))


def low_resolution(videos: DataFrame, least: int = 480) -> DataFrame:
    """Moves of videos whose shorter side is under the least to a trash folder."""
    return _plan(videos.where(F.least("width", "height") < least), F.lit("move"), F.col("path"), F.concat(F.lit("_trash_low_res/"), "name"), F.lit("low_resolution"))


def short_videos(videos: DataFrame, least_s: float = 60.0) -> DataFrame:
    return _plan(videos.where(F.col("duration_s") < least_s), F.lit("move"), F.col("path"), F.concat(F.lit("_short_videos/"), "name"), F.lit("short"))


def size_groups(files: DataFrame) -> DataFrame:
    """Moves of files of equal size to folders numbered by count and first name, descending."""
    groups = files.groupBy("length").agg(F.count("*").alias("n"), F.min(F.lower("name")).alias("first")).where("n > 1")
    numbered = groups.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("first"), F.desc("length"))))
    joined = files.join(numbered, "length")
    return _plan(joined, F.lit("move"), F.col("path"), F.concat(F.lit("group_"), F.lpad(F.col("k").cast("string"), 3, "0"), F.lit("/"), "name"), F.lit("equal_size"))


def duration_groups(files: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Moves of files of about equal duration, clusters anchored at their shortest; by folder."""
    clusters = anchored_clusters(files.select("folder", "duration_s", "path"), ["folder"], "duration_s", "path", tolerance)
    many = clusters.withColumn("n", F.count("*").over(Window.partitionBy("folder", "cluster"))).where("n > 1")
    return _plan(many, F.lit("move"), F.col("path"), F.concat(F.lit("group_"), F.col("cluster").cast("string")), F.lit("equal_duration"))


def duplicates(members: DataFrame, keepers: DataFrame, group: str, item: str) -> DataFrame:
    """Moves of all members of a group but its keeper."""
    joined = members.join(keepers, group).where(F.col(item) != F.col("keeper"))
    return _plan(joined, F.lit("move"), F.col(item), F.concat(F.lit("_duplicates/"), F.regexp_extract(item, "([^/]*)$", 1)), F.concat(F.lit("duplicate of "), "keeper"))


def renames(matches: DataFrame) -> DataFrame:
    """Subtitles named as their videos: (v_filename, s_filename, ambiguous)."""
    video, sub = split_extensions(F.col("v_filename")), split_extensions(F.col("s_filename"))
    target = F.concat(video["stem"], sub["extension"])
    return _plan(matches.where(~F.col("ambiguous") & (F.col("s_filename") != target)), F.lit("rename"), F.col("s_filename"), target, F.lit("matched"))


def encode_or_remux(probes: DataFrame) -> DataFrame:
    """(path, decision, category, audio_kbps, video_kbps, subtitle) from (path, size, duration, video_codec, audio_codecs, subtitle_codecs, width, height, fps, kbps)."""
    decision = policy.remux_decision(F.col("video_codec"), F.col("audio_codecs"), F.col("size"))
    audio = F.size("audio_codecs") * policy.DEFAULT_AUDIO_KBPS
    return probes.select(
        "path", decision.alias("decision"), policy.quality_class(F.col("kbps"), F.col("width"), F.col("height"), F.col("fps"), F.col("video_codec"))["category"].alias("category"),
        audio.alias("audio_kbps"), policy.target_kbps(F.col("duration"), audio).alias("video_kbps"), policy.subtitle_plan(F.col("subtitle_codecs")).alias("subtitle"),
    )


def active(episodes: DataFrame, only_active: bool = True) -> DataFrame:
    return episodes.where("is_active") if only_active else episodes


def stream_arguments(audio_codecs: Column, subtitle_codecs: Column) -> Column:
    """struct(audio, subtitle): copy or a codec to convert to; null for nothing to map."""
    audio = F.when(F.size(audio_codecs) <= 0, F.lit(None)).when(policy.audio_copyable(audio_codecs), "copy").otherwise("aac")
    plan = policy.subtitle_plan(subtitle_codecs)
    return F.struct(audio.alias("audio"), F.when(plan.isin("copy", "mov_text"), plan).alias("subtitle"))


def rate_arguments(kbps: Column) -> Column:
    """struct(maxrate, bufsize) for a bitrate."""
    return F.struct((kbps * 1.5).cast("int").alias("maxrate"), (kbps * 2.0).cast("int").alias("bufsize"))


def image_status(readable: Column, size: Column, same_format: Column, copy_only: bool = False, dry_run: bool = False, strategy: str = "B") -> Column:
    """What will be done with an image, by the first rule that holds."""
    ok = policy.acceptable(size) & same_format
    return (
        F.when(~readable, "failed_unreadable").when(ok, "copied").when(F.lit(copy_only) & policy.acceptable(size), "skipped_copy_only")
        .when(F.lit(dry_run), "dry_run").when(F.lit(copy_only), "failed_copy_only").otherwise(f"encode_{strategy}")
    )


#: The qualities that each strategy tries before it searches: (strategy, phase, qualities).
LADDERS = [("A", 1, [95, 93, 90, 88, 85]), ("A", 2, list(range(84, 34, -1))), ("B", 1, [97, 95, 92, 90]), ("B", 2, list(range(89, 34, -1))), ("C", 1, list(range(97, 34, -1))), ("D", 1, [95, 92, 90, 86, 82, 78]), ("D", 2, list(range(89, 34, -1)))]


def planned_quality(images: DataFrame, strategy: str, codec: str = "JPG") -> DataFrame:
    """images (size_bytes) with quality: the first of the strategy's ladder whose estimate is under the target."""
    steps = F.array(*(F.lit(q) for s, _, qs in sorted(LADDERS) if s == strategy for q in qs))
    return images.withColumn("quality", F.get(F.filter(steps, lambda q: policy.estimate_bytes(F.col("size_bytes"), q, codec) < policy.PREFERRED), 0))


def episode_label(season: Column, episode: Column, filename: Column) -> Column:
    return F.coalesce(episode_code(season, episode), filename)


def delete_failed(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.[^./]+)$", "_delete_failed$1")


def shrink_canvas(images: DataFrame, width: int, height: int, target: int = policy.PREFERRED, least: int = 640) -> tuple[int, int]:
    """The largest canvas, shrunk step by step, on which every estimate at the lowest quality is under the target; the floor if none is.

    images: (size_bytes). The driver sees the greatest size alone.
    """
    largest = images.agg(F.max("size_bytes")).first()[0] or 0
    w, h, scale = width, height, 1.0
    while min(w, h) > least and 0.4 * largest * scale**2 >= target:
        scale *= max(0.95, least / min(w, h))
        w, h = (max(least, 2 * -(-round(x * scale) // 2)) for x in (width, height))
    return w, h
