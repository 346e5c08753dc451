"""Listings of files as tables; contents are only read if a column asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.names import SUBTITLE_EXTENSIONS, nfc_casefold

# What each scan takes and skips.
VIDEO_SCAN = [".mp4", ".mkv", ".avi", ".mov", ".wmv"]
CONVERTIBLE = [".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".ts"]
BUDGET_SCAN = [
    ".3g2", ".3gp", ".asf", ".avi", ".divx", ".dv", ".f4v", ".flv", ".m2t", ".m2ts", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".mts", ".mxf", ".ogm", ".ogv", ".rm", ".rmvb", ".ts", ".vob",
    ".webm", ".wmv",
]
JPEGS, IMAGES = [".jpg", ".jpeg", ".jpe", ".jfif"], [".png", ".webp", ".bmp", ".tif", ".tiff", ".gif", ".avif"]
PRUNED = "(?i)^(_trash_low_res|group_.*)$"


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, rel_path, name, extension, length, mtime, content) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    clean = F.regexp_replace("path", "^file:/*", "/")
    base = root.replace("file://", "").rstrip("/") + "/"
    rel = F.when(F.startswith(clean, F.lit(base)), F.substring(clean, len(base) + 1, 1 << 20)).otherwise(clean)
    named = files.select(clean.alias("path"), rel.alias("rel_path"), F.col("length"), F.col("modificationTime").alias("mtime"), "content")
    return named.withColumns({"name": F.regexp_extract("rel_path", "([^/]*)$", 1), "extension": extension_of(F.col("rel_path"))})


def extension_of(path: Column) -> Column:
    """Lower case with the dot; empty for none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def pruned(rel_path: Column, pattern: str = PRUNED) -> Column:
    """True if a folder of the path matches."""
    folders = F.slice(F.split(rel_path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(rel_path, "/")) - 1))
    return F.exists(folders, lambda d: d.rlike(pattern))


def scan_videos(files: DataFrame) -> DataFrame:
    """Videos outside the pruned folders, by normalised path."""
    return files.where(F.col("extension").isin(VIDEO_SCAN) & ~pruned(F.col("rel_path"))).orderBy(nfc_casefold(F.col("rel_path")), "rel_path")


def classify_videos(files: DataFrame, skip: str = "(?i)^(_short_videos|_duplicates)$") -> DataFrame:
    """files with class: convertible or final; logs, partial files and the pass's own folders are left out."""
    kind = F.when(F.col("extension").isin(CONVERTIBLE), "convertible").when(F.col("extension") == ".mp4", "final")
    kept = files.where(~pruned(F.col("rel_path"), skip) & ~F.col("name").rlike(r"(?i)(\.partial(\.[^.]+)?|\.log)$"))
    return kept.withColumn("class", kind).where("class is not null").orderBy(F.lower("rel_path"), "rel_path")


def scan_final(files: DataFrame) -> DataFrame:
    return files.where((F.col("extension") == ".mp4") & ~pruned(F.col("rel_path"), "(?i)^_duplicates$")).orderBy(F.lower("rel_path"), "rel_path")


def discover_images(files: DataFrame, recursive: bool = True, skip: list[str] | None = None) -> DataFrame:
    kept = files.where(F.col("extension").isin(JPEGS + IMAGES))
    if not recursive:
        kept = kept.where(~F.contains("rel_path", F.lit("/")))
    for folder in skip or []:
        kept = kept.where(~F.startswith("rel_path", F.lit(folder.rstrip("/") + "/")))
    return kept.orderBy(nfc_casefold(F.col("rel_path")), "rel_path")


def generated_name(name: Column) -> Column:
    """Temporary, generated and given-up files, by their names."""
    return name.rlike(r"(?i)(\.(tmp|part|partial)(\.[^.]+)?$)|(_encoded(_\d+)?\.[^.]+$)|(_delete_failed(\.[^.]+)?$)|(\.tmp_)")


def eligible_targets(files: DataFrame, locks: DataFrame, failures: DataFrame) -> DataFrame:
    """Videos that nothing has made, locked or given up; locks and failures hold paths."""
    kept = files.where(F.col("extension").isin(BUDGET_SCAN) & ~generated_name(F.col("name")))
    return kept.join(locks.select("path").distinct(), "path", "left_anti").join(failures.select("path").distinct(), "path", "left_anti")


def flat_images(files: DataFrame) -> DataFrame:
    return files.where(F.col("extension").isin(JPEGS[:2] + IMAGES) & ~F.contains("rel_path", F.lit("/")))


def flat_media(files: DataFrame, videos: list[str]) -> DataFrame:
    """Direct children with class video or subtitle, by code point."""
    kind = F.when(F.col("extension").isin(videos), "video").when(F.col("extension").isin(SUBTITLE_EXTENSIONS), "subtitle")
    return files.where(~F.contains("rel_path", F.lit("/"))).withColumn("class", kind).where("class is not null").orderBy("name")


def cache_key(path: Column, rel_path: Column, under_root: Column) -> Column:
    """The relative path, or ABS:: and the absolute one."""
    return F.when(under_root, F.regexp_replace(rel_path, "\\\\", "/")).otherwise(F.concat(F.lit("ABS::"), path))
