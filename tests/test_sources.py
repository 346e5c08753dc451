"""Sources, sinks and streams on files in temporary folders."""

from pyspark.sql import functions as F

from brindle.functions import subtitles
from brindle.sources import files, lines, sinks
from brindle.streaming import incremental


def test_listing(spark, tmp_path):
    for name in ("B.mp4", "a.mkv", "note.log", "group_1/c.mp4", "sub/d.MP4", "x.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    listed = files.listing(spark, str(tmp_path))
    assert [r.rel_path for r in files.scan_videos(listed).collect()] == ["a.mkv", "B.mp4", "sub/d.MP4"]
    assert {r.rel_path: r["class"] for r in files.classify_videos(listed).collect()} == {"a.mkv": "convertible", "B.mp4": "final", "group_1/c.mp4": "final", "sub/d.MP4": "final"}
    assert [r.rel_path for r in files.discover_images(listed).collect()] == ["x.jpg"]


def test_lines_and_cues(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" a \n\na\nb pw\n")
    assert {r.line for r in lines.line_set(spark, str(tmp_path / "list.txt")).collect()} == {"a", "b pw"}
    (tmp_path / "s.ass").write_bytes("﻿[Events]\nFormat: Layer, Start, End, Style, Name, Text\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,{\\b1}Hi, there\n".encode())
    cues = subtitles.to_cues(lines.decoded_lines(spark, str(tmp_path / "s.ass")))
    assert subtitles.srt_documents(cues).first().srt == "1\n00:00:01,000 --> 00:00:02,500\nHi, there\n\n"


def test_ledger_stream(spark, tmp_path):
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    handle = lambda df: df.select("key", F.lit("success").alias("status"), F.lit("").alias("reason"))
    for k, keys in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(x,) for x in keys], "key string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string").parquet(source)
        incremental.ingest(stream, ledger, str(tmp_path / "cp"), "key", handle).awaitTermination()
        assert spark.read.parquet(ledger).count() == (2, 3)[k]


def test_export(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 2048, 10, 60.0, 61.0, 1, 2, 3, 4, 99.5, -1.0, 9)], "original string, duplicate string, original_size long, duplicate_size long, original_duration_s double, duplicate_duration_s double, original_width int, original_height int, duplicate_width int, duplicate_height int, similarity double, offset_s double, overlap_frames int")
    sinks.write_csv(sinks.pair_export(pairs), str(tmp_path / "csv"))
    row = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert row.original_size == "2.00 KB" and row.similarity == "99.50%"
