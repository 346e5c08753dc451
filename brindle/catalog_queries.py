"""More queries over the driver's tables: scans, plans, probes, names, policies and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import binary, episodes, formatting, names, policy, probe, subtitles, web
from brindle.operators import clustering, ledger, matching, naming, similarity, summary
from brindle.operators.graph import numbered
from brindle.plans import actions
from brindle.queries import QUERIES, hashed, query, table
from brindle.sources import files, lines, sinks

# ---- listings -----------------------------------------------------------------------------------

#: Documents as files: folders and extensions that the scans tell apart.
FOLDERS = ["en", "group_1", "_trash_low_res", "sub", "_duplicates", "_short_videos", "GROUP_x"]
ENDS = [".mp4", ".MKV", ".jpg", ".png", ".ts", ".srt", ".partial.mp4", ".log", "_encoded_2.mp4", ".webp", ".vob", "_delete_failed.mkv", ".gif"]


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], k: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({k} % {len(values)} + 1)::INT]"


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    folder = F.when(d % 3 == 0, "").otherwise(F.concat(_pick(FOLDERS, d), F.lit("/")))
    rel = F.concat(folder, F.lit("f"), d.cast("string"), _pick(ENDS, d))
    own = table(spark, sf_dir, "documents").select("doc_id", rel.alias("rel_path"), F.col("n_chars").alias("length"))
    return own.withColumns({"path": F.concat(F.lit("/root/"), "rel_path"), "name": F.regexp_extract("rel_path", "([^/]*)$", 1), "extension": files.extension_of(F.col("rel_path"))})


LISTED = f"""f0 AS (SELECT doc_id, n_chars AS length, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_pick_sql(FOLDERS, 'doc_id')} || '/' END AS folder, 'f' || doc_id || {_pick_sql(ENDS, 'doc_id')} AS name FROM documents),
f AS (SELECT *, folder || name AS rel_path, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext FROM f0)"""


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"WITH {LISTED} SELECT rel_path FROM f WHERE ext IN {_in(files.VIDEO_SCAN)} AND NOT regexp_matches(lower(folder), '^(_trash_low_res|group_.*)/$')")
def video_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_videos(listed(spark, sf_dir)).select("rel_path")


@query(f"WITH {LISTED} SELECT rel_path, CASE WHEN ext IN {_in(files.CONVERTIBLE)} THEN 'convertible' ELSE 'final' END AS class FROM f WHERE folder NOT IN ('_duplicates/', '_short_videos/') AND name NOT LIKE '%.partial.mp4' AND (ext IN {_in(files.CONVERTIBLE)} OR ext = '.mp4')")
def convertible_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.classify_videos(listed(spark, sf_dir)).select("rel_path", "class")


@query(f"WITH {LISTED} SELECT rel_path FROM f WHERE ext = '.mp4' AND folder <> '_duplicates/'")
def final_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_final(listed(spark, sf_dir)).select("rel_path")


@query(f"WITH {LISTED} SELECT rel_path FROM f WHERE ext IN {_in(files.JPEGS + files.IMAGES)} AND folder <> 'sub/'")
def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.discover_images(listed(spark, sf_dir), skip=["sub"]).select("rel_path")


@query(f"WITH {LISTED} SELECT rel_path FROM f WHERE ext IN {_in(files.JPEGS[:2] + files.IMAGES)} AND folder = ''")
def flat_image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.flat_images(listed(spark, sf_dir)).select("rel_path")


@query(f"WITH {LISTED} SELECT rel_path, CASE WHEN ext = '.srt' THEN 'subtitle' ELSE 'video' END AS class FROM f WHERE folder = '' AND (ext IN {_in(names.VIDEO_EXTENSIONS)} OR ext = '.srt')")
def flat_media_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.flat_media(listed(spark, sf_dir), names.VIDEO_EXTENSIONS).select("rel_path", "class")


@query(f"WITH {LISTED} SELECT rel_path FROM f WHERE ext IN {_in(files.BUDGET_SCAN)} AND name NOT LIKE '%.partial.mp4' AND NOT regexp_matches(name, '_encoded(_[0-9]+)?\\.') AND NOT regexp_matches(name, '_delete_failed') AND doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def encode_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = listed(spark, sf_dir)
    return files.eligible_targets(every, every.where("doc_id % 5 = 0"), every.where("doc_id % 7 = 0")).select("rel_path")


@query(f"WITH {LISTED} SELECT rel_path, CASE WHEN doc_id % 4 = 0 THEN 'ABS::/root/' || rel_path ELSE rel_path END AS key, length('/root/' || rel_path) <= 24 AS fits FROM f")
def cache_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("rel_path", files.cache_key(F.col("path"), F.col("rel_path"), F.col("doc_id") % 4 != 0).alias("key"), policy.path_fits(F.col("path"), 24).alias("fits"))


@query(f"WITH {LISTED}, n AS (SELECT *, row_number() OVER (ORDER BY rel_path) AS r FROM f) SELECT rel_path, (r - 1)::BIGINT AS file_id, right(name, 8) AS shown FROM n")
def file_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.file_register(listed(spark, sf_dir), ["rel_path"], 8).select("rel_path", "file_id", "shown")


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id)::BIGINT AS number FROM events")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "events").select("event_id", "value"), [F.desc("value"), F.asc("event_id")]).select("event_id", "number")


@query("SELECT DISTINCT trim(l) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE trim(l) <> ''")
def line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.distinct_lines(table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("value")))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as UTF-8 with a mark, UTF-16 or plain UTF-8, decoded again."""
    d = F.col("doc_id") % 3
    raw = F.when(d == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when((d == 1) & (F.char_length("text") > 0), F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(binary.decode_text(raw)).alias("digest"))


# ---- plans --------------------------------------------------------------------------------------


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("v/"), key.cast("string")).alias("path"), key.cast("string").alias("name"), (F.col("p_size") * 20).alias("width"), (F.col("p_size") * 15 + 300).alias("height"), (F.col("p_retailprice") / 20).alias("duration_s"), (key % 40).alias("length"), F.col("p_brand").alias("folder"))


VIDEOS = "v AS (SELECT 'v/' || p_partkey AS path, p_partkey::VARCHAR AS name, p_size * 20 AS width, p_size * 15 + 300 AS height, p_retailprice / 20 AS duration_s, p_partkey % 40 AS length, p_brand AS folder FROM part)"


@query(f"WITH {VIDEOS} SELECT 'move' AS action, path AS src, '_trash_low_res/' || name AS dst, 'low_resolution' AS reason FROM v WHERE least(width, height) < 480")
def low_resolution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.low_resolution(_videos(spark, sf_dir))


@query(f"WITH {VIDEOS} SELECT 'move' AS action, path AS src, '_short_videos/' || name AS dst, 'short' AS reason FROM v WHERE duration_s < 60")
def short_video_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.short_videos(_videos(spark, sf_dir))


@query(f"WITH {VIDEOS}, g AS (SELECT length, count(*) AS n, min(lower(name)) AS f FROM v GROUP BY 1 HAVING count(*) > 1), k AS (SELECT length, row_number() OVER (ORDER BY n DESC, f DESC, length DESC) AS k FROM g) SELECT 'move' AS action, path AS src, 'group_' || lpad(k::VARCHAR, 3, '0') || '/' || name AS dst, 'equal_size' AS reason FROM v JOIN k USING (length)")
def size_group_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.size_groups(_videos(spark, sf_dir))


@query(f"WITH {VIDEOS}, k AS (SELECT length, arg_max(path, struct_pack(a := width * height, b := path)) AS keeper FROM v GROUP BY 1) SELECT 'move' AS action, path AS src, '_duplicates/' || name AS dst, 'duplicate of ' || keeper AS reason FROM v JOIN k USING (length) WHERE path <> keeper")
def duplicate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = _videos(spark, sf_dir)
    return actions.duplicates(videos, clustering.keepers(videos, "length", [F.col("width") * F.col("height")], "path"), "length", "path")


@query("SELECT 'rename' AS action, 's' || p_partkey || '.vi.ass' AS src, 'Show ' || p_size || '.ass' AS dst, 'matched' AS reason FROM part WHERE p_partkey % 3 <> 0")
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table(spark, sf_dir, "part").select(F.concat(F.lit("Show "), "p_size", F.lit(".mkv")).alias("v_filename"), F.concat(F.lit("s"), "p_partkey", F.lit(".vi.ass")).alias("s_filename"), (F.col("p_partkey") % 3 == 0).alias("ambiguous"))
    return actions.renames(matches)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND s <= 4294967296 THEN 'FAST_REMUX' ELSE 'ENCODE' END AS decision, (k * 1.5)::DOUBLE AS maxrate FROM (SELECT o_orderkey, trunc(o_totalprice * 30000)::BIGINT AS s, (o_orderkey % 100 * 2)::BIGINT AS k FROM orders)")
def remux_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = F.when(F.col("o_orderkey") % 3 == 0, "hevc").otherwise("H264")
    rates = actions.rate_arguments(F.col("o_orderkey") % 100 * 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.remux_decision(codec, F.array(F.lit("aac")), (F.col("o_totalprice") * 30000).cast("long")).alias("decision"), rates["maxrate"].cast("double").alias("maxrate"))


@query("SELECT conv_id, CASE WHEN s = 0 THEN NULL WHEN bad = 0 THEN 'copy' ELSE 'aac' END AS audio, CASE WHEN t > 0 THEN 'mov_text' END AS subtitle FROM (SELECT conv_id, count(*) AS s, count(*) FILTER (role NOT IN ('user', 'assistant')) AS bad, count(*) FILTER (role = 'assistant') AS t FROM conversations GROUP BY 1)")
def stream_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    audio = F.transform("r", lambda x: F.when(x == "user", "aac").when(x == "assistant", "opus").otherwise("dts"))
    told = actions.stream_arguments(audio, F.transform(F.filter("r", lambda x: x == "assistant"), lambda x: F.lit("subrip")))
    return roles.select("conv_id", told["audio"].alias("audio"), told["subtitle"].alias("subtitle"))


_SIZE = "n_chars * 4000"
_OK = "s > 0 AND s < 4950000"


def size() -> Column:
    return F.col("n_chars") * 4000


@query(f"SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'failed_unreadable' WHEN {_OK} AND doc_id % 2 = 0 THEN 'copied' ELSE 'encode_B' END AS status, CASE WHEN doc_id % 9 = 0 THEN 'failed_unreadable' WHEN {_OK} AND doc_id % 2 = 0 THEN 'copied' WHEN {_OK} THEN 'skipped_copy_only' ELSE 'failed_copy_only' END AS copy_only FROM (SELECT doc_id, {_SIZE} AS s FROM documents)")
def image_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    own = (d % 9 != 0, size(), d % 2 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", actions.image_status(*own).alias("status"), actions.image_status(*own, copy_only=True).alias("copy_only"))


@query(f"SELECT doc_id, max(q)::BIGINT AS quality FROM (SELECT doc_id, q, greatest(1024, trunc(s * (0.22 + 0.78 * pow(q / 100.0::DOUBLE, 1.35)) * 0.985)::BIGINT) AS e FROM (SELECT doc_id, {_SIZE} AS s FROM documents), (SELECT unnest([95, 93, 90, 88, 85]) AS q UNION ALL SELECT unnest(range(35, 85)))) WHERE e < 4940000 GROUP BY 1")
def strategy_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "documents").select("doc_id", size().alias("size_bytes"))
    return actions.planned_quality(images, "A").where("quality is not null").select("doc_id", F.col("quality").cast("long").alias("quality"))


@query("""SELECT doc_id, CASE WHEN st = 'copied' THEN CASE WHEN j AND NOT ok THEN 'exact-copy-metadata-retained' WHEN NOT j THEN 'exact-copy-metadata-retained' ELSE 'exact-copy' END WHEN st = 'sanitized' THEN 'marker-sanitized' END AS variant, st AS status
FROM (SELECT *, CASE WHEN NOT (s > 0 AND s < 4950000) THEN 'encode' WHEN j AND ok AND c THEN 'sanitized' ELSE 'copied' END AS st FROM (SELECT doc_id, n_chars * 4000 AS s, doc_id % 2 = 0 AS j, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS ok, doc_id % 5 <> 0 AS c FROM documents))""")
def under_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    told = policy.under_limit(d % 2 == 0, d % 3 != 0, d % 5 != 0, d % 7 != 0, size())
    return table(spark, sf_dir, "documents").select("doc_id", told["variant"].alias("variant"), told["status"].alias("status"))


@query("""SELECT doc_id, CASE WHEN deep AND icc THEN 'deep_png_with_profile' END AS error, CASE WHEN deep AND icc THEN NULL WHEN deep THEN 'tool' WHEN icc OR (c = 'JPG' AND a) OR p THEN 'library' WHEN c = 'PNG' OR o > 1 THEN 'library,tool' ELSE 'tool,library' END AS encoders
FROM (SELECT *, c = 'PNG' AND b > 8 AS deep, c = 'PNG' AND doc_id % 4 = 0 AS p FROM (SELECT doc_id, ['JPG', 'PNG', 'WEBP'][(doc_id % 3 + 1)::INT] AS c, doc_id % 5 = 0 AS icc, doc_id % 7 = 0 AS a, CASE WHEN doc_id % 11 = 0 THEN 16 ELSE 8 END AS b, doc_id % 9 AS o FROM documents))""")
def encoder_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    image = {"codec": _pick(["JPG", "PNG", "WEBP"], d), "has_icc": d % 5 == 0, "has_alpha": d % 7 == 0, "bit_depth": F.when(d % 11 == 0, 16).otherwise(8), "orientation": d % 9, "colours": F.when(d % 4 == 0, 64)}
    told = policy.encoders(image)
    return table(spark, sf_dir, "documents").select("doc_id", told["error"].alias("error"), F.array_join(told["order"], ",").alias("encoders"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 AND l_returnflag <> 'R' AND f > 0 AND f < 4950000 THEN f ELSE s END AS bytes FROM (SELECT *, trunc(l_extendedprice)::BIGINT * 100 AS s, trunc(l_extendedprice)::BIGINT * 97 AS f FROM lineitem)")
def webp_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("l_extendedprice").cast("long")
    kept = policy.final_webp(F.when(F.col("l_linenumber") % 3 == 0, "WEBP").otherwise("JPG"), F.when(F.col("l_returnflag") == "R", "copy").otherwise("tool"), F.lit(4), whole * 100, whole * 97)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kept.alias("bytes"))


@query("SELECT min(l_orderkey * 8 + l_linenumber)::BIGINT AS attempt FROM lineitem GROUP BY l_partkey, CASE WHEN l_returnflag = 'N' THEN 'PNG' ELSE 'JPG' END, CASE WHEN l_returnflag = 'N' THEN -1 ELSE l_quantity END")
def memoised_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("int")
    tried = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("attempt"), F.when(F.col("l_returnflag") == "N", "PNG").otherwise("JPG").alias("codec"), F.col("l_quantity").alias("quality"), F.col("l_partkey").alias("image"))
    key = F.struct("image", policy.attempt_key(F.col("codec"), F.col("quality"), F.lit(1.0), F.lit(10), F.lit(10), F.lit(False), F.lit(4), none))
    return summary.memoised(tried, key, "attempt").select("attempt")


@query("SELECT o_orderkey, f - 1000000 - n >= greatest(t * 0.05, 2147483648.0) AS admitted FROM (SELECT o_orderkey, trunc(o_totalprice * 100000)::BIGINT AS f, 60000000000 AS t, o_custkey * 1000 AS n FROM orders)")
def disk_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    room = policy.admitted((F.col("o_totalprice") * 100000).cast("long"), F.lit(60_000_000_000), F.lit(1_000_000), F.col("o_custkey") * 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", room.alias("admitted"))


# ---- the duplicate search -----------------------------------------------------------------------


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as videos: eight hashes of eight signs each, with durations, sizes and rates."""
    signs = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    bits = lambda at, n: F.coalesce(F.conv(F.reverse(F.substring("signs", at + 1, n)), 2, 10).cast("long"), F.lit(0))
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.rpad(F.coalesce(signs, F.lit("")), 64, "0").alias("signs")).select(
        k.alias("ord"), F.lpad(k.cast("string"), 8, "0").alias("path"), (600.0 + k % 50 * 10).alias("duration_s"), F.array(*(bits(w * 8, 8) for w in range(8))).alias("hashes"), bits(0, 63).alias("consensus_hash"), (k % 13 * 1000).alias("file_size"),
        F.lit(640).alias("width"), (F.lit(360) + (k % 3).cast("int") * 2).alias("height"), F.when(k % 10 == 0, 2.0).otherwise(1.0).alias("sample_fps"),
    )


_BYTES = "list_transform(range(0, 8), lambda w: list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: CASE WHEN embedding[w * 8 + i + 1] > 0 THEN 1::BIGINT << i::INT ELSE 0::BIGINT END)), lambda a, b: a | b))"
_SIGNS = "list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i::INT ELSE 0::BIGINT END)), lambda a, b: a | b)"
PRINTS = f"p AS (SELECT vec_id AS ord, lpad(vec_id::VARCHAR, 8, '0') AS path, (600.0::DOUBLE + vec_id % 50 * 10) AS d, {_BYTES} AS v, {_SIGNS} AS h, vec_id % 13 * 1000 AS size, 640 * (360 + vec_id % 3 * 2) AS area, CASE WHEN vec_id % 10 = 0 THEN 2.0 ELSE 1.0 END AS fps FROM embeddings)"
DUPLICATES = f"""WITH {PRINTS}, c AS (SELECT a.path AS a, b.path AS b, a.v AS x, b.v AS y, a.area AS aa, b.area AS ba, a.size AS asz, b.size AS bsz, a.d AS ad, b.d AS bd FROM p a JOIN p b ON a.ord < b.ord AND abs(a.d - b.d) <= greatest(60.0, 0.12 * greatest(a.d, b.d)) AND bit_count(xor(a.h, b.h)) <= 20 AND greatest(a.fps, b.fps) / least(a.fps, b.fps) <= 1.25),
o AS (SELECT c.*, o, 8 - abs(o) AS n, list_sum(list_transform(range(0, 8 - abs(o)), lambda k: bit_count(xor(x[greatest(0, -o) + k + 1], y[greatest(0, o) + k + 1])))) AS diff FROM c, range(-7, 8) t(o)),
s AS (SELECT *, 1 - diff / (n * 64.0::DOUBLE) AS sim FROM o), r AS (SELECT a, b, aa, ba, asz, bsz, ad, bd, arg_max(struct_pack(o := o, n := n, sim := sim), struct_pack(r := round(sim * 1e12)::BIGINT, n := n, p := -abs(o), q := -o)) AS best FROM s GROUP BY ALL),
k AS (SELECT *, aa > ba OR (aa = ba AND (asz > bsz OR (asz = bsz AND a <= b))) AS first FROM r WHERE best.sim >= CASE WHEN best.n < 3 THEN 0.995 WHEN best.n < 5 THEN 0.97 WHEN best.n < 10 THEN 0.92 ELSE 0.85 END),
d AS (SELECT CASE WHEN first THEN a ELSE b END AS original, CASE WHEN first THEN b ELSE a END AS duplicate, CASE WHEN first THEN asz ELSE bsz END AS original_size, CASE WHEN first THEN bsz ELSE asz END AS duplicate_size, best.sim * 100 AS similarity, CASE WHEN first THEN best.o ELSE -best.o END::DOUBLE AS offset_s, best.n::BIGINT AS overlap_frames FROM k)"""


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.duplicate_pairs(prints(spark, sf_dir))


@query(f"{DUPLICATES} SELECT original, duplicate, original_size, duplicate_size, floor(similarity * 1000 + 0.5)::BIGINT AS points, offset_s, overlap_frames FROM d")
def duplicate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.floor(F.col("similarity") * 1000 + 0.5)
    return _duplicates(spark, sf_dir).select("original", "duplicate", "original_size", "duplicate_size", points.alias("points"), "offset_s", F.col("overlap_frames").cast("long").alias("overlap_frames"))


@query(f"{DUPLICATES}, u AS (SELECT original AS path, original_size AS size FROM d UNION ALL SELECT duplicate, duplicate_size FROM d) SELECT path, max(size) AS size, count(*)::BIGINT AS n FROM u GROUP BY 1")
def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as files, and the greatest size that a pair says of each."""
    return summary.largest_by_path(_duplicates(spark, sf_dir)).select("path", "size", "n")


@query(f"{DUPLICATES} SELECT original, duplicate, CASE WHEN original_size < 1024 THEN original_size || ' B' ELSE printf('%.2f KB', original_size / 1024.0::DOUBLE) END AS shown FROM d")
def duplicate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.pair_export(_duplicates(spark, sf_dir)).select("original", "duplicate", F.col("original_size").alias("shown"))


@query("SELECT least(a, b) AS a, greatest(a, b) AS b, count(*)::BIGINT AS n FROM (SELECT user_id % 40 AS a, event_id % 40 AS b FROM events) GROUP BY ALL")
def symmetric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("x"), (F.col("event_id") % 40).alias("y"))
    counts = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))
    distinct = ledger.symmetric_distinct(pairs, "x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return counts.join(distinct, ["a", "b"])


@query("SELECT a.l_orderkey, a.l_linenumber, greatest(x, y) / least(x, y) > 1.25 AS differ, CASE WHEN l_linenumber <= 0 THEN 1.0 WHEN l_linenumber < 3 THEN 0.995 WHEN l_linenumber < 5 THEN 0.97 WHEN l_linenumber < 10 THEN 0.92 ELSE 0.85 END::DOUBLE AS required, greatest(0.001, least(1.0, 10 / x))::DOUBLE AS fps FROM (SELECT *, l_quantity AS x, 20.0::DOUBLE AS y FROM lineitem) a")
def search_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", similarity.rates_differ(q, F.lit(20.0)).alias("differ"), similarity.required_similarity(F.col("l_linenumber")).cast("double").alias("required"), similarity.effective_fps(F.lit(1.0), F.lit(10.0), q).alias("fps"))


@query("SELECT vec_id, (CASE WHEN list_sum(list_transform(embedding[1:3], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) >= 2 THEN 1 ELSE 0 END)::BIGINT AS majority FROM embeddings")
def majority_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = F.transform(F.slice("embedding", 1, 3), lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", similarity.majority_bits(signs).alias("majority"))


@query("SELECT vec_id, list_transform(range(0, 4), lambda w: CASE WHEN w = 0 THEN bits ELSE 0 END)[1]::BIGINT AS word FROM (SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > list_sum(list_transform(embedding[1:63], lambda x: x::DOUBLE)) / 63 THEN 1::BIGINT << i::INT ELSE 0::BIGINT END)), lambda a, b: a | b) AS bits FROM embeddings)")
def average_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.get(binary.average_hash(pixels), 0).alias("word"))


@query("SELECT a.vec_id, (bit_count(xor(a.h, b.h)) + bit_count(xor(b.h, a.h)))::BIGINT AS distance FROM (SELECT vec_id, " + _SIGNS + " AS h FROM embeddings) a JOIN (SELECT vec_id, " + _SIGNS + " AS h FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def word_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hashed(spark, sf_dir).select("vec_id", "h")
    after = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return own.join(after, "vec_id").select("vec_id", binary.hamming_words(F.array("h", "g"), F.array("g", "h")).cast("long").alias("distance"))


# ---- probes -------------------------------------------------------------------------------------

_JSON_SQL = """'{"format":{"duration":"' || CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE o_custkey::VARCHAR END || '"},"streams":[{"codec_type":"video","codec_name":"H264","width":' || (o_custkey % 2000) || ',"height":720,"avg_frame_rate":"' || (o_orderkey % 60) || '/2","duration":"9.5"},{"codec_type":"audio","codec_name":"AAC","bit_rate":"' || (o_custkey * 100) || '"}]}'"""


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as probe documents."""
    length = F.when(F.col("o_orderkey") % 7 == 0, "N/A").otherwise(F.col("o_custkey").cast("string"))
    shape = '{"format":{"duration":"%s"},"streams":[{"codec_type":"video","codec_name":"H264","width":%d,"height":720,"avg_frame_rate":"%d/2","duration":"9.5"},{"codec_type":"audio","codec_name":"AAC","bit_rate":"%d"}]}'
    json = F.format_string(shape, length, F.col("o_custkey") % 2000, F.col("o_orderkey") % 60, F.col("o_custkey") * 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", probe.parsed(json).alias("doc"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2000 = 0 THEN 'invalid_resolution' END AS error, CASE WHEN o_custkey % 2000 > 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 9.5 ELSE o_custkey::DOUBLE END END AS duration_s, CASE WHEN o_custkey % 2000 > 0 THEN o_custkey % 2000 END::BIGINT AS width FROM orders")
def probe_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = probe.metadata(F.col("doc"), F.lit(False), F.lit(False))
    return probed(spark, sf_dir).select("o_orderkey", told["error"].alias("error"), told["duration_s"].alias("duration_s"), told["width"].cast("long").alias("width"))


@query("SELECT o_orderkey, 1::BIGINT AS video, 1::BIGINT AS audio, 0::BIGINT AS subtitle, (o_orderkey % 60 / 2.0)::DOUBLE AS fps, greatest(1, o_custkey * 100 // 1000)::BIGINT AS audio_kbps FROM orders")
def probe_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, counts = F.col("doc"), probe.stream_counts(F.col("doc"))
    return probed(spark, sf_dir).select("o_orderkey", *(counts[k].cast("long").alias(k) for k in ("video", "audio", "subtitle")), probe.frame_rate(F.get(probe.streams_of(doc, "video"), 0)).alias("fps"), policy.planned_audio_kbps(probe.audio_rates(doc)).cast("long").alias("audio_kbps"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_custkey::VARCHAR AS customer FROM orders")
def probe_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = probe.key_values(F.concat(F.lit("status="), "o_orderstatus", F.lit("\ncustomer="), F.col("o_custkey").cast("string"), F.lit("\n")))
    return table(spark, sf_dir, "orders").select("o_orderkey", told["status"].alias("status"), told["customer"].alias("customer"))


@query("SELECT doc_id, CASE WHEN o >= 5 THEN 20 ELSE 10 END::BIGINT AS width, CASE WHEN o >= 5 THEN 10 ELSE 20 END::BIGINT AS height, doc_id % 3 = 0 OR doc_id % 4 = 0 AS has_alpha, CASE WHEN doc_id % 5 = 0 THEN 'second' ELSE 'first' END AS icc_sha256, CASE WHEN n_chars * n_chars > 1000000 THEN 'pixel_limit' END AS error FROM (SELECT *, doc_id % 8 + 1 AS o FROM documents)")
def merged_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, none = F.col("doc_id"), F.lit(None).cast("string")
    shape = lambda **x: F.struct(*(c.alias(k) for k, c in x.items()))
    first = shape(width=F.lit(1), height=F.lit(2), is_readable=F.lit(True), has_alpha=d % 3 == 0, has_icc=F.lit(True), icc_sha256=F.lit("first"), bit_depth=F.lit(8), error=none, exif_orientation=F.lit(1))
    second = shape(width=F.lit(10), height=F.lit(20), is_readable=F.lit(True), has_alpha=d % 4 == 0, has_icc=F.lit(False), icc_sha256=F.when(d % 5 == 0, "second"), bit_depth=F.lit(None).cast("int"), error=none, exif_orientation=d % 8 + 1)
    told = probe.merged(first, second)
    limit = probe.pixel_limit_error(F.col("n_chars"), F.col("n_chars"), 1_000_000)
    return table(spark, sf_dir, "documents").select("doc_id", told["width"].cast("long").alias("width"), told["height"].cast("long").alias("height"), told["has_alpha"].alias("has_alpha"), told["icc_sha256"].alias("icc_sha256"), limit.alias("error"))


@query("SELECT source, len(list_filter(['de', 'en', 'fr'], lambda x: NOT list_contains(l, x)))::BIGINT AS missing FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY 1)")
def capability_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"))
    return own.select("source", F.size(probe.missing_capabilities(F.array(*map(F.lit, ("de", "en", "fr"))), F.col("l"))).cast("long").alias("missing"))


# ---- policies -----------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN p % 100 >= 55 THEN 20 WHEN p % 100 >= 40 THEN 24 WHEN p % 100 >= 25 THEN 30 WHEN p % 100 >= 10 THEN 36 ELSE 35 END::BIGINT AS low, CASE WHEN p % 100 >= 55 THEN 74 WHEN p % 100 >= 40 THEN 82 WHEN p % 100 >= 25 THEN 88 WHEN p % 100 >= 10 THEN 93 ELSE 97 END::BIGINT AS high,
['JPG', 'JPG', 'WEBP', 'PNG', 'PNG'][(p % 5 + 1)::INT] AS codec, [10, 8, 16, 12][(p % 4 + 1)::INT]::BIGINT AS bits, [false, true, false, false][(p % 4 + 1)::INT] AS alpha, ['420', 'none', 'none', '444'][(p % 4 + 1)::INT] AS chroma, greatest(1, least(94, round_even(p % 300 / 256.0 * 94, 0)))::BIGINT AS palette FROM (SELECT doc_id, doc_id AS p FROM documents)""")
def image_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    bounds, pixel = policy.quality_bounds(d % 100), _pick(["yuv420p10le", "rgba", "rgb48be", "yuv444p12le"], d)
    return table(spark, sf_dir, "documents").select(
        "doc_id", bounds["low"].cast("long").alias("low"), bounds["high"].cast("long").alias("high"), policy.source_codec(_pick(["a.jpg", "b/c.JPEG", "d.webp", "e.png", "f.bmp"], d)).alias("codec"),
        policy.bit_depth(pixel).cast("long").alias("bits"), policy.has_alpha(pixel).alias("alpha"), policy.chroma(pixel).alias("chroma"), policy.palette_quality(d % 300)["quality"].cast("long").alias("palette"),
    )


@query("SELECT source, CASE WHEN o = 0 THEN 'none' WHEN h >= greatest(1, o // 3) THEN 'thorough' WHEN o <= 5 OR a < 7340032 THEN 'careful' ELSE 'fast' END AS strategy FROM (SELECT source, count(*) FILTER (s >= 4950000) AS o, count(*) FILTER (s >= 9900000) AS h, avg(s) FILTER (s >= 4950000) AS a FROM (SELECT source, n_chars * 4000 AS s FROM documents) GROUP BY 1)")
def strategy_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = size()
    told = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(s >= 4950000).alias("o"), F.count_if(s >= 9900000).alias("h"), F.avg(F.when(s >= 4950000, s)).alias("a"))
    return told.select("source", policy.recommended_strategy(F.col("o"), F.col("h"), F.col("a")).alias("strategy"))


@query("SELECT o_orderkey, e <= 51 AND l <= 1000000 AS feasible, CASE WHEN e > 51 OR l > 1000000 THEN 'difficult' WHEN e > 45 THEN 'very_low_quality' WHEN e > 40 THEN 'low_quality' END AS warning, CASE WHEN o_orderkey % 2 = 0 AND k > 0 THEN k // 1000 WHEN s > 0 THEN greatest(100, trunc(s * 8 / 600.0 / 1000 - 128)::BIGINT) ELSE 0 END::BIGINT AS kbps FROM (SELECT o_orderkey, (o_orderkey % 60)::DOUBLE AS e, o_custkey * 1500 AS l, o_custkey * 1000 AS k, o_custkey * 1000000 AS s FROM orders)")
def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    told = policy.feasibility((k % 60).cast("double"), c * 1500, c * 3000, F.lit(1_000_000), F.lit(2_000_000))
    rate = policy.video_kbps(F.when(k % 2 == 0, c * 1000), c * 1_000_000, F.lit(600.0), F.lit(128))
    return table(spark, sf_dir, "orders").select("o_orderkey", told["is_feasible"].alias("feasible"), told["warning"].alias("warning"), rate.cast("long").alias("kbps"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (w + w % 2) END::BIGINT AS width, (trunc(p_size * 1000000)::BIGINT - 50000) AS strict, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 7 ELSE p_partkey END AS total FROM (SELECT *, greatest(2, p_size) AS w FROM part)")
def parsed_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    sides = F.when(k % 3 == 0, F.concat(s, F.lit("x720"))).otherwise("none")
    total = formatting.content_size(k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("bytes 0-4/"), (k * 7).cast("string"))))
    return table(spark, sf_dir, "part").select("p_partkey", formatting.parse_dimensions(sides)["width"].cast("long").alias("width"), formatting.parse_size_limit(F.concat(s, F.lit(" MB")))["strict_max_bytes"].alias("strict"), total.alias("total"))


@query("SELECT DISTINCT p_size AS size, CASE WHEN f * w < 640 THEN 640 ELSE e END::BIGINT AS width FROM (SELECT p_size, (p_size * 40 + 700) AS w, greatest(0.95::DOUBLE, 640 / (p_size * 40 + 700)::DOUBLE) AS f, (round_even((p_size * 40 + 700) * greatest(0.95::DOUBLE, 640 / (p_size * 40 + 700)::DOUBLE), 0)::BIGINT + round_even((p_size * 40 + 700) * greatest(0.95::DOUBLE, 640 / (p_size * 40 + 700)::DOUBLE), 0)::BIGINT % 2) AS e FROM part)")
def shrink_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.col("p_size") * 40 + 700
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), policy.shrink_step(side, side)["width"].cast("long").alias("width")).distinct()


# ---- names --------------------------------------------------------------------------------------

_NAME = "'Show OVA Part ' || (p_partkey % 2 + 1) || ' Cour ' || (p_partkey % 4 + 1) || ' - ' || lpad((p_size % 24 + 1)::VARCHAR, 2, '0')"


def _name() -> Column:
    return F.format_string("Show OVA Part %d Cour %d - %02d", F.col("p_partkey") % 2 + 1, F.col("p_partkey") % 4 + 1, F.col("p_size") % 24 + 1)


@query("SELECT p_partkey, 'OVA' AS special, (p_partkey % 2 + 1)::BIGINT AS part, (p_partkey % 4 + 1)::BIGINT AS cour FROM part")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.special_type(_name()).alias("special"), names.part(_name()).cast("long").alias("part"), names.cour(_name()).cast("long").alias("cour"))


@query("SELECT p_partkey, (p_partkey % 4 + 1)::BIGINT AS season, (p_size % 24 + 1)::BIGINT AS episode, 'S' || lpad((p_partkey % 4 + 1)::VARCHAR, 2, '0') || 'E' || lpad((p_size % 24 + 1)::VARCHAR, 2, '0') AS code, p_partkey % 5 <> 0 AS renamable, p_partkey % 5 = 0 AS batch FROM part")
def episode_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in four notations, a fifth of them of whole seasons."""
    k, e = F.col("p_partkey"), F.col("p_size") % 24 + 1
    s = k % 4 + 1
    name = F.when(k % 5 == 0, F.format_string("Show S%02dE%02d complete", s, e)).when(k % 5 == 1, F.format_string("[Sub] Show S%d - %02d [1080p]", s, e)).when(k % 5 == 2, F.format_string("Show Season %d Episode %d", s, e)).when(k % 5 == 3, F.format_string("show.%dx%02d.x264", s, e)).otherwise(F.format_string("Show Season %d - %02d (2019)", s, e))
    told = table(spark, sf_dir, "part").select("p_partkey", names.episode_features(name, F.lit(None).cast("string")).alias("f"))
    own = told.select("p_partkey", "f.season", "f.episode", "f.is_batch")
    return own.select("p_partkey", F.col("season").cast("long").alias("season"), F.col("episode").cast("long").alias("episode"), names.episode_code(F.col("season"), F.col("episode")).alias("code"), names.renamable(F.col("episode"), F.lit(None).cast("string"), F.col("is_batch")).alias("renamable"), F.col("is_batch").alias("batch"))


_ROMAN_SQL = "[" + ", ".join(f"'{r}'" for r in episodes.ROMAN) + "]"
_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in episodes.NUMBER_WORDS) + "]"


@query(f"SELECT p_partkey, {_pick_sql([str(v) for v in episodes.ROMAN.values()], 'p_partkey')}::BIGINT AS roman, {_pick_sql([str(v) for v in episodes.NUMBER_WORDS.values()], 'p_partkey')}::BIGINT AS word, (p_size % 9 + 11)::BIGINT AS chinese, p_size IN (264, 265, 360, 480, 576, 720, 1080, 2160, 4320) OR p_size <= 0 OR p_size >= 1900 AS noise FROM part")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    digit = _pick(["一", "二", "三", "四", "五", "六", "七", "八", "九"], F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", names.roman_number(_pick(list(episodes.ROMAN), k)).cast("long").alias("roman"), names.number_words(F.concat(F.lit("part "), _pick(list(episodes.NUMBER_WORDS), k), F.lit(" end"))).cast("long").alias("word"),
        names.chinese_number(F.concat(F.lit("十"), digit, F.lit("話"))).cast("long").alias("chinese"), names.noise_number(F.col("p_size")).alias("noise"),
    )


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_partkey || '.vi' ELSE 'a' || p_partkey END AS stem, CASE WHEN p_partkey % 2 = 0 THEN '.ass' ELSE '.mkv' END AS extension, CASE WHEN p_partkey % 2 = 0 THEN 'vi' END AS language, replace(replace(p_name, ':', '-'), '?', '-') AS clean, left(sha1(p_name), 10) AS token FROM part")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("a"), k.cast("string"), F.when(k % 2 == 0, ".vi.ass").otherwise(".mkv"))
    cut = names.split_extensions(name)
    return table(spark, sf_dir, "part").select(
        "p_partkey", cut["stem"].alias("stem"), cut["extension"].alias("extension"), names.language(F.lit("x"), cut["extension"], cut["stem"]).alias("language"), names.clean_name(F.col("p_name")).alias("clean"),
        names.stable_token(F.col("p_name")).alias("token"),
    )


@query("SELECT p_partkey, p_name AS folded, trim(regexp_replace(regexp_replace(p_name, '\\[[^\\[\\]]*\\]', ' ', 'g'), 'x264', '', 'g')) AS plain, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part")
def name_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width letters folded back, brackets and noise left out, words capitalised."""
    n = F.col("p_name")
    wide = F.translate(n, names.HALFWIDTH, names.FULLWIDTH)
    noisy = F.concat(n, F.lit("[abc] x264"))
    return table(spark, sf_dir, "part").select("p_partkey", names.fullwidth_to_ascii(wide).alias("folded"), F.trim(names.remove_noise(names.remove_brackets(noisy))).alias("plain"), names.title_case(n).alias("title"))


@query("SELECT p_partkey, p_type || ' ' || (p_size % 50) AS cleaned FROM part")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bare numbers are sought in: codecs, resolutions, seasons and decimals are left out."""
    name = F.concat("p_type", F.lit(" s02 1080p 12.5 x265 "), (F.col("p_size") % 50).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.trim(F.regexp_replace(names.without_noise_column(name), " +", " ")).alias("cleaned"))


@query()
def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as names of at most 240 bytes, and their version 5 UUIDs."""
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    return table(spark, sf_dir, "documents").select("doc_id", names.truncated_name()(F.concat(F.regexp_replace("text", r"\s+", " "), F.lit(".mp4"))).alias("name"), names.name_uuid(space)(F.col("text")).alias("uuid"))


@query("SELECT p_partkey, p_type AS item FROM part WHERE p_partkey % 3 = 0 OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey = p_partkey)")
def unmatched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no supplier of the same number matches, ambiguous matches (odd or of every third) not counting."""
    matches = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), ((F.col("s_suppkey") % 2 != 0) | (F.col("s_suppkey") % 3 == 0)).alias("ambiguous"))
    return matching.unmatched(table(spark, sf_dir, "part"), matches, ["p_partkey"]).select("p_partkey", F.col("p_type").alias("item"))


# ---- texts, pages and ledgers -------------------------------------------------------------------


@query("SELECT page_id, u.url, u.name FROM (SELECT page_id, unnest(list_transform(range(1, len(h) + 1), lambda i: struct_pack(url := h[i], name := nullif(trim(regexp_replace(regexp_replace(t[i], '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), ''), first := list_position(h, h[i]) = i))) AS u FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>', 2) AS t FROM pages)) WHERE u.first")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(web.anchors(F.col("html"))).alias("x")).select("page_id", "x.url", "x.name")


@query("SELECT page_id, 'https://m.example/' || page_id || '.mp4' AS source, '/get_video?id=' || page_id || '&expires=9&ip=1&token=t' AS signed, 't' || page_id AS segment, '{\"k\": ' || page_id || '}' AS json, '{\"v\": 1}' AS assigned FROM pages")
def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with player scripts put in: what the patterns capture."""
    k = F.col("page_id").cast("string")
    script = F.concat(F.lit('<script>x = {sourcesCode: [{ src: "https://m.example/'), k, F.lit('.mp4", type: 1}]}; a="get_video?id='), k, F.lit("&expires=9&ip=1&token=t'\";viewer_data = {\"v\": 1};</script><script id=\"d\" type=\"j\">{\"k\": "), k, F.lit("}</script>"))
    html = F.concat(script, "html")
    path = web.segment_after(F.concat(F.lit("https://h/d/t"), k, F.lit("/x")))
    return table(spark, sf_dir, "pages").select("page_id", web.media_source(html).alias("source"), web.signed_video(html).alias("signed"), path.alias("segment"), web.embedded_json(html, "d").alias("json"), web.assigned_json(html, "viewer_data").alias("assigned"))


@query("SELECT page_id, regexp_extract_all(html, 'https?://[^\\s,;\"''<>]+') AS urls FROM pages")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.urls_in(F.col("html")).alias("urls"))


@query("SELECT page_id, 7::BIGINT AS last, contains(lower(url), 'example') AND regexp_matches(url, 'https?://') AS supported, page_id % 3 = 0 OR page_id % 4 = 0 AS kept, 'a+b c' || page_id AS decoded FROM pages")
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    ext = F.when(k % 3 == 0, "jpg").when(k % 4 == 0, "").otherwise("exe")
    texts = F.array(F.lit("1"), F.lit(" 7 "), F.lit("next"))
    return table(spark, sf_dir, "pages").select("page_id", web.last_page(texts, F.lit(1)).cast("long").alias("last"), web.supported_line(F.col("url"), ["example"]).alias("supported"), web.allowed_extension(ext, ["jpg"], empty_ok=True).alias("kept"), web.percent_decode(F.concat(F.lit("a+b%20c"), k.cast("string"))).alias("decoded"))


@query("SELECT page_id, s < 1048576 OR page_id % 9 = 0 AS suspicious, CASE WHEN page_id % 2 = 0 THEN 'clip ' || page_id || '.mp4' ELSE page_id || '.mp4' END AS name FROM (SELECT page_id, length(html) * 300 AS s FROM pages)")
def download_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    url = F.concat(F.lit("https://h/"), F.when(k % 9 == 0, "deleted/").otherwise("v/"), k.cast("string"), F.lit(".mp4"))
    name = F.when(k % 2 == 0, F.concat(F.lit("clip "), k.cast("string"))).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", web.suspicious_small(url, F.char_length("html") * 300, F.lit(False), False).alias("suspicious"), web.download_name(name, url).alias("name"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'WARN' WHEN event_type = 'purchase' THEN 'DONE' ELSE 'INFO' END AS severity, (user_id * 3600 + 62.5)::DOUBLE AS seconds FROM events")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    line = F.concat(F.when(kind == "view", "warning").when(kind == "purchase", "done").otherwise(kind), F.lit(" time="), F.col("user_id").cast("string"), F.lit(":01:02.5 x"))
    return table(spark, sf_dir, "events").select("event_id", web.severity(line).alias("severity"), web.progress_seconds(line).alias("seconds"))


@query("SELECT doc_id, right(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)), 2000) AS summary FROM documents WHERE text IS NOT NULL")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.concat(F.lit("ffmpeg version 9\n  built with x\n"), "text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", web.error_summary(log).alias("summary"))


@query("WITH l AS (SELECT source, list(doc_id::VARCHAR ORDER BY doc_id) AS d FROM documents GROUP BY 1) SELECT source, array_to_string(d[1:10], chr(10)) || CASE WHEN len(d) > 10 THEN chr(10) || '… and ' || (len(d) - 10) || ' more' ELSE '' END AS shown FROM l")
def first_and_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each source as a report shows them, and how many more there are."""
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("d"))
    return own.select("source", web.first_and_more(F.transform("d", lambda x: x.cast("string"))).alias("shown"))


@query("SELECT conv_id, turn, 'Dialogue: 0,0:00:00.00,0:00:01.00,x,' || role || ',0,0,0,,{\\i1\\b1}t' AS line FROM conversations")
def dialogue_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Dialogue: 0,0:00:00.00,0:00:01.00,x,"), "role", F.lit(",0,0,0,,{\\b1}t"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", subtitles.prefixed(line, "\\i1").alias("line"))


@query("SELECT conv_id::VARCHAR AS file, turn::BIGINT AS ord, turn > m AS inside FROM (SELECT *, min(CASE WHEN turn % 3 = 1 THEN turn END) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE m IS NOT NULL")
def event_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("ord"), F.when(F.col("turn") % 3 == 1, "[Events]").otherwise("x").alias("line"))
    has = own.where("line = '[Events]'").select("file").distinct()
    return own.withColumn("inside", subtitles.in_section(own)).join(has, "file", "left_semi").select("file", F.col("ord").cast("long").alias("ord"), "inside")


@query("WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'Format: x' ELSE 'Dialogue: ' || turn END AS line FROM conversations), m AS (SELECT conv_id, coalesce(min(CASE WHEN line LIKE 'Format:%' THEN turn END), -1) AS starts FROM l GROUP BY 1) SELECT conv_id::VARCHAR AS file, 'head' AS line, 1::BIGINT AS n FROM m UNION ALL SELECT conv_id::VARCHAR, line, count(*)::BIGINT FROM l JOIN m USING (conv_id) WHERE turn > starts GROUP BY ALL")
def with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), turn.alias("ord"), F.when(turn % 2 == 1, "Format: x").otherwise(F.concat(F.lit("Dialogue: "), turn.cast("string"))).alias("line"))
    return subtitles.with_header(["head"], own).groupBy("file", "line").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_brand || '_Ep' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '_5.1' ELSE '' END || '.ass' AS name FROM part")
def dated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = subtitles.dated_output(F.col("p_brand"), F.col("p_size"), F.col("p_partkey") % 2 == 0, F.lit("2024-01-05").cast("date"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query("SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase' AND s.event_id % 29 = 0)")
def open_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed entries whose key has no success."""
    status = F.when(F.col("event_type") == "error", "failed").when((F.col("event_type") == "purchase") & (F.col("event_id") % 29 == 0), "success").otherwise("other")
    return ledger.open_failures(table(spark, sf_dir, "events").withColumn("status", status), "user_id").select("event_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'late' ELSE 'done' END AS state FROM customer")
def late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "customer")
    done = every.where("c_custkey % 3 <> 0").select("c_custkey", F.lit("done").alias("state"))
    return ledger.collected_late(done, every.select("c_custkey", F.lit("late").alias("state")), "c_custkey")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey IN (1, 2)")
def chosen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "region").where("r_regionkey in (1, 2)").select(F.col("r_regionkey").alias("n_regionkey"))
    return ledger.chosen(table(spark, sf_dir, "nation"), wanted, "n_regionkey").select(F.col("n_name").alias("name"))


@query("SELECT min(p_type) AS item FROM part GROUP BY lower(p_type)")
def prepared_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.prepared(table(spark, sf_dir, "part").select(F.col("p_type").alias("item")), "item", F.lower("item"))


@query("SELECT DISTINCT n_name AS name FROM nation UNION SELECT r_name FROM region")
def list_with_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_new(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), "name")


@query("SELECT min(k) AS k FROM (SELECT [p_size % 5, p_partkey % 5] AS k FROM part) GROUP BY list_sort(k)")
def distinct_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.array(F.col("p_size").cast("long") % 5, F.col("p_partkey") % 5).alias("k"))
    return ledger.distinct_orders(pairs, "k")


@query("SELECT conv_id, list_sort(list_distinct(list_concat(a, b))) AS roles, a[1:2] AS firsts FROM (SELECT conv_id, list(role ORDER BY turn) AS a, ['system', 'user'] AS b FROM conversations GROUP BY 1)")
def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two selections, and the first items of one."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("a"))
    return rows.select("conv_id", F.array_sort(F.array_union("a", F.array(F.lit("system"), F.lit("user")))).alias("roles"), F.slice("a", 1, 2).alias("firsts"))


@query("SELECT event_type AS action, count(*)::BIGINT AS n, count(*) FILTER (value > 9)::BIGINT AS reasons FROM events GROUP BY 1")
def run_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("path"), F.when(F.col("value") > 9, "large").alias("reason"))
    return summary.reasons(rows).select("action", "n", F.size("reasons").cast("long").alias("reasons"))


@query("SELECT DISTINCT n_regionkey % 2 = 0 AS active, count(*) OVER (PARTITION BY n_regionkey % 2 = 0)::BIGINT AS n FROM nation WHERE n_regionkey % 2 = 0")
def active_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = actions.active(table(spark, sf_dir, "nation").withColumn("is_active", F.col("n_regionkey") % 2 == 0))
    return rows.groupBy(F.col("is_active").alias("active")).agg(F.count("*").alias("n"))


@query("SELECT '{\"total\":' || count(*) || ',\"compressed\":' || count(*) FILTER (event_type = 'purchase') || ',\"copied\":0,\"failed\":' || count(*) FILTER (event_type = 'error') || ',\"bytes_saved\":0}' AS report FROM events")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.when(kind == "purchase", "compressed").when(kind == "error", "failed").otherwise("skipped").alias("status"), F.lit(10).alias("original_bytes"), F.lit(None).cast("long").alias("output_bytes"))
    return summary.outcome_report(rows).select(F.col("json").alias("report"))


@query("SELECT event_id, CASE WHEN p IS NULL THEN 0.0 ELSE greatest(0.0, 2.0 - (epoch_us(ts) - p) / 1000000.0) END::DOUBLE AS wait FROM (SELECT event_id, ts, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS p FROM events)")
def site_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that each event waits so that those of a user are two seconds apart."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", ledger.deltas(at, ["user_id"], "event_id", 2.0).alias("wait"))


@query("SELECT doc_id, crc32 AS crc, s1 AS sha FROM (SELECT doc_id, 0::BIGINT AS crc32, sha1(text) AS s1 FROM documents WHERE text IS NOT NULL)")
def xor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts XORed with a key twice: the digest of what comes back, and how far its checksum is off."""
    raw = F.encode("text", "UTF-8")
    back = binary.keyed_xor(b"key")(binary.keyed_xor(b"key")(raw))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", (F.crc32(back) - F.crc32(raw)).alias("crc"), F.sha1(back).alias("sha"))


@query("SELECT page_id, 'alert(' || page_id || ')' AS script FROM pages")
def unpacked_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.concat(F.lit("eval(function(p,a,c,k,e,d){return p}('0(1)',62,2,'alert|"), F.col("page_id").cast("string"), F.lit("'.split('|'),0,{}))"))
    return table(spark, sf_dir, "pages").select("page_id", web.unpacked_script()(packed).alias("script"))


__all__ = ["QUERIES"]
