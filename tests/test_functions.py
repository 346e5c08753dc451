"""Hand-derived cases of the functions."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import binary, episodes, formatting, names, policy, subtitles, web
from brindle.operators import matching, naming, similarity, tree
from brindle.plans import actions


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_columns(spark):
    lit = F.lit
    cases = [
        (formatting.size_catalog(lit(500)), "500 B"), (formatting.size_remux(lit(500)), "500.0 B"), (formatting.size_budget(lit(500)), "500.00 B"), (formatting.size_converter(lit(500)), "500.00 B"),
        (formatting.size_image(lit(1536)), "1.54 KB"), (formatting.size_image(lit(1536), True), "1.50 KiB"), (formatting.size_image(lit(-1536)), "-1.54 KB"),
        (formatting.duration_clock(lit(59.5)), "01:00"), (formatting.duration_clock(lit(0.5)), "00:00"), (formatting.duration_truncated(lit(-1.0)), "--:--"), (formatting.eta(lit(61)), "ETA: ~1m 01s"),
        (formatting.even_dimension(lit(1)), 2), (formatting.even_dimension(lit(2.5)), 2), (formatting.even_dimension(lit(3)), 4),
        (formatting.parse_size_limit(lit("5"))["strict_max_bytes"], 4950000), (formatting.parse_size_limit(lit("4,5MB"))["preferred_target_bytes"], 4440000), (formatting.parse_size_limit(lit("x"))["strict_max_bytes"], None),
        (formatting.parse_dimensions(lit("1601x2400"))["width"], 1602), (formatting.content_size(lit("5"), lit("bytes 0-4/99")), 99),
        (policy.target_kbps(lit(3600.0), lit(128)), 7899), (policy.quality_to_q(lit(95)), 2), (policy.quality_to_q(lit(60)), 10), (policy.quality_to_q(lit(34)), 20), (policy.quality_to_q(lit(1)), 28),
        (policy.potential(lit(True), lit(5_200_000), lit(1000), lit(1000)), "easy"), (policy.acceptable(lit(4950000)), False), (policy.acceptable(lit(0)), False),
        (policy.audio_copyable(F.array().cast("array<string>")), True), (policy.estimate_bytes(lit(10_000_000), lit(93)), 9132989), (policy.estimate_bytes(lit(10_000_000), lit(93), "WEBP"), 9149558),
        (policy.estimate_bytes(lit(10_000_000), lit(93), "PNG"), 9258650), (policy.bit_depth(lit("yuv420p10le")), 10), (policy.has_alpha(lit("rgba")), True), (policy.source_codec(lit("a/b.JPEG")), "JPG"),
        (similarity.prefilter_radius(lit(29)), 20), (similarity.prefilter_radius(lit(30)), 18), (similarity.prefilter_radius(lit(90)), 16),
        (similarity.required_similarity(lit(0)), 1.0), (similarity.required_similarity(lit(2)), 0.995), (similarity.required_similarity(lit(9)), 0.92), (similarity.required_similarity(lit(10)), 0.85),
        (similarity.comparable_durations(lit(100.0), lit(155.0)), True), (similarity.comparable_durations(lit(100.0), lit(161.0)), False),
        (names.chinese_number(lit("十二話")), 12), (names.chinese_number(lit("二十三")), 23), (names.chinese_number(lit("x")), None), (names.number_words(lit("part twenty one")), 21), (names.roman_number(lit("xiv")), 14),
        (names.split_extensions(lit("a.vi.ass"))["stem"], "a.vi"), (names.split_extensions(lit("a.vi.ass"))["extension"], ".ass"), (names.split_extensions(lit("a.mkv"))["stem"], "a"),
        (names.language_score(lit(None).cast("string")), 0.5), (names.language_score(lit("vi")), 1.0), (names.language_score(lit("ja")), 0.8), (names.language_score(lit("ko")), 0.4),
        (names.clean_name(lit("a\x19b")), "ab"), (names.clean_name(lit("a\x1ab")), "a\x1ab"), (names.title_case(lit("the house no ss 2")), "The House no SS 2"), (names.special_type(lit("Show OVA 2")), "OVA"),
        (names.part(lit("Show Part 2")), 2), (names.cour(lit("Show 2nd Cour")), 2), (names.language(lit("x"), lit(".vi.srt"), lit("x")), "vi"), (names.episode_code(lit(2), lit(5)), "S02E05"),
        (subtitles.srt_time(lit("0:00:10.37")), "00:00:10,370"), (subtitles.srt_time(lit("1:02:03.5")), "01:02:03,500"), (subtitles.strip_tags(lit("{\\i1}a\\Nb\\hc ")), "a\nb c"), (subtitles.strip_tags(lit("{\\p1}m 0 0")), ""),
        (web.percent_decode(lit("a%20b+c")), "a b+c"), (web.valid_response(lit(206), lit(0)), True), (web.valid_response(lit(200), lit(3)), False), (web.segment_after(lit("https://h/d/abc/x")), "abc"),
        (web.next_page(lit("http://a/b?page=9")), "http://a/b?page=10"), (web.severity(lit("a warn error")), "ERROR"), (web.page_title(lit("<title>A%20b | c</title>")), "A b"),
    ]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    for i, (_, want) in enumerate(cases):
        assert row[i] == pytest.approx(want) if isinstance(want, float) else row[i] == want, (i, row[i], want)


def test_sizes_round_by_binary_values(spark):
    """As Python's formatting does: few texts that look like halves are halves."""
    sizes = [1_015_000, 1_005_000, 8_555_000, 75_525_000, 1_000_125_000, 1152 * 1024, 1_125_000, 1_375_000, 999_995, -8_555_000, -1_015_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", formatting.size_image(F.col("n")).alias("image"), formatting.size_budget(F.col("n")).alias("budget")).collect()
    for n, image, budget in rows:
        x, unit = (abs(n) / 1e9, "GB") if abs(n) >= 1e9 else (abs(n) / 1e6, "MB") if abs(n) >= 1e6 else (abs(n) / 1e3, "KB")
        assert image == ("-" if n < 0 else "") + f"{x:.2f} {unit}"
        assert budget == (f"{n / 2**20:.2f} MiB" if abs(n) >= 2**20 else f"{n / 1024:.2f} KiB")


def test_log_interpolation(spark):
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((28, 4e9), (34, 1e9))))
    assert value(spark, policy.log_interpolation(points, F.lit(2e9), F.lit(1.0))) == pytest.approx(31.0)
    assert value(spark, policy.sample_starts(F.lit(8.0))) == [0.0]
    assert len(value(spark, policy.sample_starts(F.lit(600.0)))) == 5


@pytest.mark.parametrize(
    ("name", "want"),
    [("Show S02E05", (2, 5)), ("Show Season 2 - 04", (2, 4)), ("Show 2x07", (2, 7)), ("[Group] Show - 12 [1080p]", (None, 12)), ("Show ep 3", (None, 3)), ("第12話", (None, 12)), ("Show 十二話", (None, 12)), ("Show #8", (None, 8)), ("Tập 9", (None, 9)), ("Show", None),
     ("Show S2 - 14", (2, 14)), ("Show Season IV Episode II", (4, 2)), ("Show twenty one", (None, 21)), ("Show OVA 2", (None, 2)), ("Show Vol. 3", (None, 3)), ("07 - Show", (None, 7)), ("Show_-_08v2_(1280x720)", (None, 8)),
     ("Show.11.mkv", (None, 11)), ("Show (2019) [05]", (None, 5)), ("第二十三話", (None, 23)), ("Show 4話", (None, 4)), ("Show S1 - 1080", None), ("Show.s03.e07", (3, 7))],
)
def test_episodes(name, want):
    assert names.named_episode(name, name, None) == want


def test_batches():
    batch = episodes.is_batch
    assert not batch("Show Season 2 - 04") and batch("Show - 01-12") and batch("Show complete") and batch("Show 01~12END") and not batch("Show 01-02") and not batch("Show S2 - 14")


def test_majority(spark):
    assert value(spark, similarity.majority_bits(F.array(*(F.lit(x).cast("long") for x in (1, 1, 0))))) == 1
    assert value(spark, similarity.majority_bits(F.array(*(F.lit(x).cast("long") for x in (1, 0))))) == 0
    assert value(spark, similarity.majority_bits(F.array().cast("array<bigint>"))) == 0


def test_shift(spark):
    rng = np.random.default_rng(1)
    a = [int(x) for x in rng.integers(-(2**62), 2**62, 12)]
    b = [int(x) for x in rng.integers(-(2**62), 2**62, 3)] + a
    s = value(spark, similarity.best_shift(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), min_overlap=4))
    assert (s.offset, s.similarity, s.overlap) == (3, 1.0, 12)


def test_greedy_ambiguity(spark):
    rows = [("f", 1, 1, 80.0), ("f", 1, 2, 78.0), ("f", 2, 3, 60.0)]
    out = matching.greedy_match(spark.createDataFrame(rows, "folder string, v int, s int, score double"), ["folder"], "v", "s").collect()
    assert {(r.v, r.s) for r in out if not r.ambiguous} == {(2, 3)}


def test_collisions(spark):
    rows = [("f", "a", ".x", k) for k in range(4)] + [("f", "a_2", ".x", 9)]
    df = spark.createDataFrame(rows, "folder string, stem string, ext string, k int")
    out = [r.target.lower() for r in naming.without_collisions(df, "folder", "stem", "ext", ["k"]).collect()]
    assert len(set(out)) == 5 and "a.x" in out


GRID = [["1C", "7A", "55", "E9", "BD"], ["E9", "1C", "7A", "BD", "55"], ["55", "BD", "1C", "E9", "7A"], ["7A", "E9", "BD", "55", "1C"], ["BD", "55", "E9", "7A", "1C"]]


def test_grid(spark):
    df = spark.createDataFrame([(r, c, v) for r, row in enumerate(GRID) for c, v in enumerate(row)], "row int, col int, val string")
    path = tree.shortest_path(spark, df, [["7A", "E9"]])
    values = [GRID[r][c] for r, c in path]
    assert path[0][0] == 0 and len(path) == len(set(path)) and ["7A", "E9"] in [values[i : i + 2] for i in range(len(values))]
    assert all((a[1] == b[1]) if k % 2 == 0 else (a[0] == b[0]) for k, (a, b) in enumerate(zip(path, path[1:], strict=False)))
    assert tree.shortest_path(spark, df, [["ZZ"]]) is None


def test_bytes():
    assert binary.signature(b"a" * 200_000) != binary.signature(b"a" * 199_999) and len(binary.signature(b"")) == 32
    flat, ramp = bytes(1024), bytes(int(x) for x in np.tile(np.arange(32) * 8, 32))
    assert binary.perceptual_hash(ramp) != binary.perceptual_hash(flat)
    segment = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    icc = b"ICC_PROFILE\x00\x01\x01" + b"profile"
    scan = b"\xff\xda\x00\x02abc\xff\xd9"
    jpeg = b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xE1, b"Exif") + segment(0xE2, icc) + segment(0xFE, b"note") + scan
    clean, changed, has_icc, error = binary.sanitized_jpeg(jpeg)
    assert clean == b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xE2, icc) + scan and changed and has_icc and error is None
    assert binary.icc_profile(jpeg) == b"profile" and binary.sanitized_jpeg(b"x")[3] == "not_jpeg"
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    assert binary.icc_profile(b"\x89PNG\r\n\x1a\n" + chunk(b"iCCP", b"n\x00\x00" + zlib.compress(b"prof"))) == b"prof"
    assert binary.icc_profile(b"RIFF\x00\x00\x00\x00WEBP" + b"ICCP" + (4).to_bytes(4, "little") + b"prof") == b"prof"
    assert binary.decoded_text("é".encode("cp1252")) == "é" and binary.decoded_text("é".encode("utf-8-sig")) == "é"


def test_plans(spark):
    videos = spark.createDataFrame([("a/x.mp4", "x.mp4", 100, 300, 5.0)], "path string, name string, width int, height int, duration_s double")
    assert [r.action for r in actions.low_resolution(videos).collect()] == ["move"] and actions.short_videos(videos).count() == 1
    matches = spark.createDataFrame([("v.mkv", "s.ass", False), ("w.mkv", "t.ass", True)], "v_filename string, s_filename string, ambiguous boolean")
    assert [(r.src, r.dst) for r in actions.renames(matches).collect()] == [("s.ass", "v.ass")]


def test_trees(spark):
    rows = [(None, "a", 0, "A")] + [(chr(96 + k) if k < 27 else f"n{k - 1}", chr(97 + k) if k < 26 else f"n{k}", 0, f"N{k}") for k in range(1, 3)]
    nodes = spark.createDataFrame(rows, "parent_id string, node_id string, ord int, name string")
    assert {(r.node_id, r.path) for r in tree.expand(spark, nodes, F.col("parent_id").isNull()).collect()} == {("a", ""), ("b", "N1"), ("c", "N1/N2")}
    cycle = nodes.unionByName(spark.createDataFrame([("c", "b", 0, "again")], nodes.schema))
    with pytest.raises(ValueError, match="ancestor"):
        tree.expand(spark, cycle, F.col("parent_id").isNull())
