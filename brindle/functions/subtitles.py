"""Subtitle records: times, tags, dialogue fields, styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields of a dialogue line where no Format line says otherwise.
FIELDS = ["Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text"]


def srt_time(ass: Column) -> Column:
    """H:MM:SS.cc as HH:MM:SS,mmm."""
    p = F.split(F.trim(ass), "[:.]")
    hundredths = F.left(F.rpad(F.get(p, 3), 2, "0"), F.lit(2))
    return F.concat(*(x for k in range(3) for x in (F.lpad(F.get(p, k).cast("int").cast("string"), 2, "0"), F.lit(":" if k < 2 else ","))), hundredths, F.lit("0"))


def strip_tags(text: Column) -> Column:
    """Plain text of a line; empty for drawings."""
    plain = F.regexp_replace(text, r"\{[^}]*\}", "")
    plain = F.replace(F.regexp_replace(plain, r"\\[Nn]", "\n"), F.lit("\\h"), F.lit(" "))
    return F.when(text.rlike(r"\{[^}]*\\p[1-9]"), "").otherwise(F.regexp_replace(plain, r"^\s+|\s+$", ""))


def dialogue_parts(line: Column, fields: Column | None = None) -> Column:
    """struct(start, end, text) of a Dialogue line; null if it has too few fields."""
    fields = F.array(*map(F.lit, FIELDS)) if fields is None else fields
    parts = F.split(F.substring(line, 10, 1 << 20), ",", F.size(fields))
    field = lambda name: F.trim(F.get(parts, (F.array_position(fields, name) - 1).cast("int")))
    return F.when(F.startswith(line, F.lit("Dialogue:")) & (F.size(parts) >= F.size(fields)), F.struct(field("Start").alias("start"), field("End").alias("end"), field("Text").alias("text")))


def format_fields(line: Column) -> Column:
    """The names in a Format line that lists Text; null otherwise."""
    names = F.transform(F.split(F.substring(line, 8, 1 << 20), ","), lambda x: F.trim(x))
    return F.when(F.startswith(line, F.lit("Format:")) & F.contains(line, F.lit("Text")), names)


def to_cues(lines: DataFrame) -> DataFrame:
    """(file, cue, start, end, text) from (file, ord, line): the Format line before decides the fields."""
    before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    trimmed = lines.withColumn("line", F.trim("line"))
    known = trimmed.withColumn("fields", F.coalesce(F.last(format_fields(F.col("line")), ignorenulls=True).over(before), F.array(*map(F.lit, FIELDS))))
    told = known.withColumn("d", dialogue_parts(F.col("line"), F.col("fields"))).where("d is not null").select("file", "ord", "d.start", "d.end", strip_tags(F.col("d.text")).alias("text")).where("text != ''")
    cue = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    return told.select("file", cue.alias("cue"), srt_time(F.col("start")).alias("start"), srt_time(F.col("end")).alias("end"), "text")


def srt_documents(cues: DataFrame) -> DataFrame:
    """(file, srt): the cues of each file as one text."""
    block = F.concat(F.col("cue").cast("string"), F.lit("\n"), "start", F.lit(" --> "), "end", F.lit("\n"), "text", F.lit("\n\n"))
    sorted_blocks = F.transform(F.array_sort(F.collect_list(F.struct("cue", block.alias("block")))), lambda x: x["block"])
    return cues.groupBy("file").agg(F.array_join(sorted_blocks, "").alias("srt"))


def styled(line: Column, exceptions: dict[str, str], plain: list[str], important: list[str], default: str = "main", plain_style: str = "Default") -> Column:
    """A Dialogue line with style and actor by ordered rules: exceptions, then plain actors, then important ones.

    An exact important actor gets a style of the same name, one that is only contained gets the plain style.
    """
    parts = F.split(F.replace(line, F.lit("﻿"), F.lit("")), ",", 10)
    name = F.get(parts, 4)
    rule = lambda hit, style, actor: (hit, F.struct(style.alias("style"), actor.alias("actor")))
    rules = [rule(name == k, F.lit(v), name) for k, v in exceptions.items()]
    for actors, own in ((plain, False), (important, True)):
        for a in actors:
            rules.append(rule(name == a, F.lit(a if own else plain_style), F.lit(a)))
            rules.append(rule(F.contains(name, F.lit(a)), F.lit(plain_style), F.lit(a)))
    chosen = None
    for hit, value in rules:
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    other = F.struct(F.lit(default).alias("style"), name.alias("actor"))
    chosen = other if chosen is None else chosen.otherwise(other)
    rebuilt = F.concat_ws(",", F.slice(parts, 1, 3), chosen["style"], chosen["actor"], F.slice(parts, 6, 5))
    return F.when((F.size(parts) == 10) & (F.trim(F.regexp_extract(F.get(parts, 0), "^([^:]*):", 1)) == "Dialogue"), rebuilt).otherwise(F.replace(line, F.lit("﻿"), F.lit("")))


def prefixed(line: Column, override: str) -> Column:
    """Puts an override block before a dialogue's text, merged into the block that it begins with."""
    parts = F.split(line, ",", 10)
    text = F.get(parts, 9)
    merged = F.when(F.startswith(text, F.lit("{")), F.concat(F.lit("{" + override), F.substring(text, 2, 1 << 20))).otherwise(F.concat(F.lit("{" + override + "}"), text))
    return F.when(F.startswith(line, F.lit("Dialogue:")) & (F.size(parts) == 10), F.concat_ws(",", F.slice(parts, 1, 9), merged)).otherwise(line)


def in_section(lines: DataFrame, section: str = "[Events]") -> Column:
    """True after the first line that holds the section's name; for (file, ord, line)."""
    at = F.min(F.when(F.contains("line", F.lit(section)), F.col("ord"))).over(Window.partitionBy("file"))
    return F.coalesce(F.col("ord") > at, F.lit(True))


def with_header(header: list[str], lines: DataFrame) -> DataFrame:
    """(file, ord, line): the header's lines, then those after the first Format or [Events] line; all if there is none."""
    first = lambda mark: F.min(F.when(F.startswith(F.trim("line"), F.lit(mark)), F.col("ord"))).over(Window.partitionBy("file"))
    tail = lines.withColumn("at", F.coalesce(first("Format:"), first("[Events]"), F.lit(-1))).where("ord > at").select("file", (F.col("ord") + 1_000_000).alias("ord"), "line")
    head = F.posexplode(F.array(*map(F.lit, header))).alias("at", "line")
    files = lines.select("file").distinct().select("file", head)
    return files.select("file", F.col("at").cast("long").alias("ord"), "line").unionByName(tail)


def dated_output(stem: Column, episode: Column, taken: Column, day: Column) -> Column:
    name = F.format_string("%s_Ep%s.ass", stem, episode.cast("string"))
    return F.when(taken, F.concat(F.regexp_replace(name, r"\.ass$", ""), F.lit("_"), F.date_format(day, "d.M"), F.lit(".ass"))).otherwise(name)
