"""Summaries of catalogs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import policy
from brindle.functions.formatting import even_dimension


def preflight(images: DataFrame) -> DataFrame:
    """One row from (size_bytes, width, height, is_readable, is_jpeg): counts, bytes, savings, dimensions and classes."""
    size, readable = F.col("size_bytes"), F.col("is_readable")
    over = readable & (size >= policy.STRICT_MAX)
    saved = lambda q: F.least(F.greatest(F.lit(0), size - policy.PREFERRED), F.greatest(F.lit(0), size - policy.estimate_bytes(size, F.lit(q))))
    kind = policy.potential(readable, size, F.col("width"), F.col("height"))
    kinds = ("unreadable", "already_ok", "easy", "moderate", "challenging", "difficult")
    counts = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*(F.count_if(kind == k) for k in kinds)))
    return images.agg(
        F.count("*").alias("files"), F.count_if("is_jpeg").alias("jpegs"), F.count_if(~F.col("is_jpeg")).alias("convertible"),
        F.count_if(readable & ~over).alias("under_limit"), F.count_if(over).alias("over_limit"), F.count_if(~readable).alias("corrupt"),
        F.sum("size_bytes").alias("total_bytes"), F.coalesce(F.sum(F.when(over, size)), F.lit(0)).alias("over_bytes"),
        F.coalesce(F.sum(F.when(over, saved(93))), F.lit(0)).alias("savings_low"), F.coalesce(F.sum(F.when(over, saved(55))), F.lit(0)).alias("savings_high"),
        F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.min("height").alias("min_height"), F.max("height").alias("max_height"),
        F.floor(F.avg("width")).alias("avg_width"), F.floor(F.avg("height")).alias("avg_height"),
        F.bround(F.avg(F.col("width").cast("long") * F.col("height") / 1e6), 2).alias("avg_megapixels"), F.map_filter(counts, lambda _, n: n > 0).alias("histogram"),
    )


def canvas(images: DataFrame, order: str, least_side: int = 640) -> DataFrame:
    """One row (width, height, exact, error): the most common size if half of the images have it, else the medians, made even.

    Of equally common sizes, the one that comes first in the order counts.
    """
    sized = images.where("width is not null and height is not null")
    modes = sized.groupBy("width", "height").agg(F.count("*").alias("n"), F.min(order).alias("at"))
    modal = modes.agg(F.max(F.struct("n", (-F.col("at")).alias("first"), "width", "height")).alias("m"), F.sum("n").alias("all"))
    medians = sized.agg(F.median("width").alias("mw"), F.median("height").alias("mh"))
    both = modal.join(F.broadcast(medians), F.lit(True))  # one row each
    exact = F.col("m.n") * 2 >= F.col("all")
    w, h = (even_dimension(F.when(exact, F.col(f"m.{k}")).otherwise(F.col(m))) for k, m in (("width", "mw"), ("height", "mh")))
    return both.select(w.alias("width"), h.alias("height"), exact.alias("exact"), F.when(F.least(w, h) < least_side, "side_too_small").alias("error"))


def is_outlier(width: Column, height: Column, c_width: Column, c_height: Column, exact: Column) -> Column:
    ratio = lambda x, y: F.abs(x - y) / y
    apart = ((width > height) != (c_width > c_height)) | (ratio(width, c_width) > 0.08) | (ratio(height, c_height) > 0.08) | (ratio(width / height, c_width / c_height) > 0.04)
    return F.when(exact, (width != c_width) | (height != c_height)).otherwise(apart)


def distribution(df: DataFrame, kind: Column, order: str) -> DataFrame:
    """(kind, n, percent, is_main): shares of the total; the first in the order is the main of equals."""
    counts = df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    total = counts.agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("at")).alias("back"), "kind"))["kind"].alias("main"))
    return counts.join(F.broadcast(total), F.lit(True)).select("kind", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"), F.col("kind").eqNullSafe(F.col("main")).alias("is_main"))


def outcome_report(results: DataFrame) -> DataFrame:
    """One row from (status, original_bytes, output_bytes): totals, bytes saved, exit code and the counts as JSON."""
    s = F.col("status")
    failed = s.isin("failed", "interrupted", "error", "timeout")
    told = results.agg(
        F.count("*").alias("total"), F.count_if(s == "compressed").alias("compressed"), F.count_if(s.isin("copied", "sanitized")).alias("copied"), F.count_if(failed).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("output_bytes").isNotNull(), F.greatest(F.lit(0), F.col("original_bytes") - F.col("output_bytes")))), F.lit(0)).alias("bytes_saved"),
    )
    code = F.when(F.col("failed") == 0, 0).when(F.col("failed") == F.col("total"), 1).otherwise(2)
    return told.withColumn("exit_code", code).withColumn("json", F.to_json(F.struct("total", "compressed", "copied", "failed", "bytes_saved")))


def reasons(results: DataFrame) -> DataFrame:
    """(action, n, reasons): counts, and the sorted (path, reason) of those that have one."""
    given = F.when(F.col("reason").isNotNull(), F.struct("path", "reason"))
    return results.groupBy("action").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(given)).alias("reasons"))


def best_attempts(attempts: DataFrame, group: str) -> DataFrame:
    """The best attempt of each group: success, preferred, acceptable, scale, quality, then fewer bytes; among those not acceptable, fewer bytes first."""
    size = F.col("output_bytes")
    good = policy.acceptable(size)
    rank = F.struct(
        F.col("success").alias("a"), (F.col("success") & policy.preferred(size)).alias("b"), (F.col("success") & good).alias("c"),
        F.when(good, F.lit(0)).otherwise(-size).alias("d"), F.col("scale_factor").alias("e"), F.col("quality").alias("f"), (-size).alias("g"),
    )
    every = F.struct(*(c for c in attempts.columns if c != group))
    return attempts.groupBy(group).agg(F.max_by(every, rank).alias("best")).select(group, "best.*")


def folder_scores(listing: DataFrame, supported: list[str], tools: list[str]) -> DataFrame:
    """(folder, score): two points for each supported file, five for each tool."""
    points = F.when(F.col("extension").isin(supported), 2).otherwise(0) + F.when(F.col("name").isin(tools), 5).otherwise(0)
    return listing.groupBy("folder").agg(F.sum(points).alias("score"))


def replaced(original: DataFrame, replacement: DataFrame, key: str, order: str) -> DataFrame:
    """original with the columns of replacement where its key has one, in the order."""
    new = replacement.select(key, *(F.col(c).alias(f"__{c}") for c in replacement.columns if c != key), F.lit(True).alias("__new"))
    joined = original.join(new, key, "left")
    columns = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in replacement.columns and c != key else F.col(c) for c in original.columns]
    return joined.select(*columns).orderBy(order)


def memoised(attempts: DataFrame, key: Column, order: str) -> DataFrame:
    """The first attempt of each key: later ones with the same settings needn't be made."""
    every = F.struct(*attempts.columns)
    return attempts.groupBy(key.alias("__key")).agg(F.min_by(every, order).alias("first")).select("first.*")


def file_rows(pairs: DataFrame) -> DataFrame:
    """Pairs as rows of files: (path, other, size, duration_s, width, height, kept). One pass over the pairs."""
    side = lambda a, b, kept: F.struct(F.col(a).alias("path"), F.col(b).alias("other"), *(F.col(f"{a}_{c}").alias(c) for c in ("size", "duration_s", "width", "height")), F.lit(kept).alias("kept"))
    return pairs.select(F.explode(F.array(side("original", "duplicate", True), side("duplicate", "original", False))).alias("f")).select("f.*")


def largest_by_path(pairs: DataFrame) -> DataFrame:
    """(path, size, area, n): the greatest that any pair says of a file, and its pairs."""
    return file_rows(pairs).groupBy("path").agg(F.max("size").alias("size"), F.max(F.col("width").cast("long") * F.col("height")).alias("area"), F.count("*").alias("n"))
