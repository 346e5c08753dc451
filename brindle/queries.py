"""Queries over the driver's tables, one or more for each operator, with SQL that gives the same rows.

The tables aren't file catalogs, so each operator runs on the table that has the same shape. SQL is
DuckDB's; an entry without it is tested against brute force in tests/.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import formatting, names, policy, subtitles, web
from brindle.functions.binary import fast_signature, hamming
from brindle.operators import clustering, ledger, naming, similarity, summary, tree
from brindle.operators.graph import connected_components
from brindle.operators.matching import greedy_match, scored_candidates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- hashes and similarity -------------------------------------------------------------------

SIGN_SQL = "list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i::INT ELSE 0::BIGINT END)), lambda a, b: a | b)"


def sign_hash(vector: Column) -> Column:
    """63 bits, one for each of the first dimensions over zero."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), lambda s, i: F.when(F.get(vector, i) > 0, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(s))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", sign_hash(F.col("embedding")).alias("h"))


HASHED = f"h AS (SELECT vec_id, label, {SIGN_SQL} AS h FROM embeddings)"


@query(f"WITH {HASHED} SELECT vec_id, h FROM h")
def simhash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).select("vec_id", "h")


@query(f"WITH {HASHED} SELECT a.vec_id AS a_id, b.vec_id AS b_id, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 16")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.hamming_join(hashed(spark, sf_dir), "vec_id", "h", 16)
    return pairs.select(F.col("a_vec_id").alias("a_id"), F.col("b_vec_id").alias("b_id"), F.col("distance").cast("long").alias("distance"))


@query(f"WITH {HASHED} SELECT a.vec_id AS a_id, b.vec_id AS b_id, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= CASE WHEN b.label % 3 = 0 THEN 20 WHEN b.label % 3 = 1 THEN 18 ELSE 16 END")
def adaptive_radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius is that of the later row, whose label stands for its number of frames."""
    frames = F.when(F.col("b_label") % 3 == 0, 10).when(F.col("b_label") % 3 == 1, 50).otherwise(100)
    pairs = similarity.hamming_join(hashed(spark, sf_dir), "vec_id", "h", similarity.prefilter_radius(frames))
    return pairs.select(F.col("a_vec_id").alias("a_id"), F.col("b_vec_id").alias("b_id"), F.col("distance").cast("long").alias("distance"))


@query(f"WITH {HASHED}, b AS (SELECT label, i, count(*) AS n, sum((h >> i::INT) & 1) AS ones FROM h, range(0, 63) t(i) GROUP BY ALL) SELECT label, max(n)::BIGINT AS n, sum(CASE WHEN 2 * ones > n THEN 1::BIGINT << i::INT ELSE 0 END)::BIGINT AS consensus FROM b GROUP BY label")
def consensus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.consensus_hash(hashed(spark, sf_dir), "label", "h")


COMPONENTS = f"""WITH RECURSIVE {HASHED}, e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM h a JOIN h b ON a.vec_id <> b.vec_id AND bit_count(xor(a.h, b.h)) <= 16),
r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(spark, hamming_pairs(spark, sf_dir), "a_id", "b_id")


@query(f"{COMPONENTS} SELECT node, component FROM c")
def hamming_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).select("node", "component")


@query(f"{COMPONENTS}, m AS (SELECT c.component, c.node, e.label::BIGINT * 1000 + c.node AS size, e.label FROM c JOIN embeddings e ON c.node = e.vec_id), k AS (SELECT component, arg_max(node, struct_pack(a := label, b := node)) AS keeper, count(*)::BIGINT AS members FROM m GROUP BY component) SELECT k.component, k.keeper, k.members, sum(CASE WHEN m.node <> k.keeper THEN m.size ELSE 0 END)::BIGINT AS reclaimable FROM k JOIN m USING (component) GROUP BY ALL")
def component_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each component, the member with the greatest label, then id, and the sizes of the others."""
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "label", (F.col("label").cast("long") * 1000 + F.col("vec_id")).alias("size"))
    members = components(spark, sf_dir).join(sizes, "node")
    kept = clustering.keepers(members, "component", [F.col("label")], "node")
    return kept.join(clustering.reclaimable(members, "component", "node", "size", kept.select("component", "keeper")), "component")


WORDS = "list_transform(range(0, 8), lambda w: list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: CASE WHEN embedding[w * 8 + i + 1] > 0 THEN 1::BIGINT << i::INT ELSE 0::BIGINT END)), lambda a, b: a | b))"


@query(f"""WITH w AS (SELECT vec_id, label, {WORDS} AS v FROM embeddings), p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.v AS x, b.v AS y FROM w a JOIN w b ON b.vec_id = a.vec_id + 1),
o AS (SELECT a_id, b_id, o, 8 - abs(o) AS n, list_sum(list_transform(range(0, 8 - abs(o)), lambda k: bit_count(xor(x[greatest(0, -o) + k + 1], y[greatest(0, o) + k + 1])))) AS d FROM p, range(-5, 6) t(o)),
s AS (SELECT *, 1 - d / (n * 8.0::DOUBLE) AS sim FROM o) SELECT a_id, b_id, arg_max(o, struct_pack(r := round(sim * 1e12)::BIGINT, n := n, p := -abs(o), q := -o))::BIGINT AS shift, arg_max(n, struct_pack(r := round(sim * 1e12)::BIGINT, n := n, p := -abs(o), q := -o))::BIGINT AS overlap, max(sim) AS similarity FROM s GROUP BY ALL""")
def shift_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best shift of each vector's eight words of eight bits against its successor's."""
    word = lambda v, w: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), lambda s, i: F.when(F.get(v, w * 8 + i) > 0, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(s))
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*(word(F.col("embedding"), k) for k in range(8))).alias("v"))
    a = own.select(F.col("vec_id").alias("a_id"), F.col("v").alias("x"), (F.col("vec_id") + 1).alias("b_id"))
    pairs = a.join(own.select(F.col("vec_id").alias("b_id"), F.col("v").alias("y")), "b_id")
    best = similarity.best_shift(F.col("x"), F.col("y"), min_overlap=3, bits=8)
    return pairs.select("a_id", "b_id", best.alias("s")).select("a_id", "b_id", F.col("s.offset").cast("long").alias("shift"), F.col("s.overlap").cast("long").alias("overlap"), "s.similarity")


# ---- clusters and groups -----------------------------------------------------------------------


@query("SELECT md5(text) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("WITH g AS (SELECT n_chars AS size, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT size, n, first_id, row_number() OVER (ORDER BY n DESC, lpad(first_id::VARCHAR, 12, '0') DESC, size DESC)::BIGINT AS number FROM g")
def size_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = clustering.equal_groups(docs, F.col("n_chars"), "doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return groups.select(F.col("key").alias("size"), "n", F.col("first").alias("first_id"), F.col("number").cast("long").alias("number"))


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 3600000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g) SELECT user_id, k::BIGINT AS cluster, count(*)::BIGINT AS n, min(event_id) AS first_id FROM c GROUP BY ALL HAVING count(*) >= 2""")
def chained_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", seconds().alias("t"))
    told = clustering.chained_clusters(events, ["user_id"], F.col("t"), 3_600_000_000, ["event_id"]).where("cluster_size >= 2")
    return told.groupBy("user_id", F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, value, i, value AS base, 1::BIGINT AS cluster FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.value, e.i, CASE WHEN e.value - w.base > 1.0 THEN e.value ELSE w.base END, CASE WHEN e.value - w.base > 1.0 THEN w.cluster + 1 ELSE w.cluster END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, cluster, count(*)::BIGINT AS n, min(value) AS base FROM w GROUP BY ALL HAVING count(*) >= 2""")
def anchored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = clustering.anchored_clusters(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", 1.0)
    return told.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("value").alias("base")).where("n >= 2")


@query("SELECT event_id, (count(*) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN 1.0 PRECEDING AND CURRENT ROW) - 1)::BIGINT AS near FROM events")
def range_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN 1.0D PRECEDING AND CURRENT ROW) - 1")
    return table(spark, sf_dir, "events").select("event_id", near.alias("near"))


@query("SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND (a.value < b.value OR (a.value = b.value AND a.event_id < b.event_id)) AND b.value - a.value <= 0.25")
def banded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.banded_join(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id", "value", 0.25, ["user_id"])
    return pairs.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))


@query("SELECT a.o_orderkey AS a_id, b.o_orderkey AS b_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) <= greatest(60.0, 0.12 * greatest(a.o_totalprice, b.o_totalprice, 0.0))")
def duration_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    a, b = (orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias(f"{k}_id"), F.col("o_totalprice").alias(f"{k}_d")) for k in "ab")
    return a.join(b, "c").where((F.col("a_id") < F.col("b_id")) & similarity.comparable_durations(F.col("a_d"), F.col("b_d"))).select("a_id", "b_id")


@query("SELECT event_id, value FROM (SELECT event_id, value, lag(value, 1, -1.0::DOUBLE) OVER w AS p, lead(value, 1, -1.0::DOUBLE) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE value >= p AND value >= n AND value >= 0.55")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumn("top", clustering.local_maxima(F.col("value"), ["user_id"], ["event_id"], 0.55)).where("top").select("event_id", "value")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r, max(l_extendedprice) OVER (PARTITION BY l_partkey) AS best FROM lineitem) WHERE r <= 12 OR l_extendedprice >= best - 0.04")
def topk_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = clustering.top_with_margin(table(spark, sf_dir, "lineitem"), ["l_partkey"], F.col("l_extendedprice"), ["l_orderkey", "l_linenumber"], 12, 0.04)
    return told.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l_partkey, arg_max(l_orderkey, struct_pack(a := l_quantity, b := l_extendedprice, c := l_orderkey)) AS keeper, count(*)::BIGINT AS members FROM lineitem GROUP BY 1")
def keeper_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.keepers(table(spark, sf_dir, "lineitem"), "l_partkey", [F.col("l_quantity"), F.col("l_extendedprice")], "l_orderkey")


# ---- names and matching ------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || '_' || n::VARCHAR END || '.jpg' AS target FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey) AS n FROM part)")
def collision_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("folder"), F.col("p_type").alias("stem"), F.lit(".jpg").alias("ext"))
    return naming.without_collisions(parts, "folder", "stem", "ext", ["p_partkey"], "plain").select("p_partkey", "target")


_STOP = ", ".join(f"'{w}'" for w in names.TITLE_STOP)


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(trim(lower(regexp_replace(regexp_replace(p_name, '[\\s._\\-–—：:]+', ' ', 'g'), '\\b\\d+\\b', ' ', 'g'))), '\\s+'), lambda w: (length(w) >= 2 OR regexp_full_match(w, '\\pL')) AND NOT list_contains([{_STOP}], w)))), ' ') AS title_key FROM part")
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.title_key(F.col("p_name")).alias("title_key"))


_BENCH_WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))"


@query(f"WITH w AS (SELECT item_id, {_BENCH_WORDS} AS k FROM benchmark) SELECT a.item_id AS a_id, b.item_id AS b_id, len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k)))::DOUBLE AS jaccard FROM w a JOIN w b ON a.item_id < b.item_id")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("k"))
    pairs = similarity.pairs_in_grid(items, "item_id", F.lit(True), items.count())
    return pairs.select(F.col("a_item_id").alias("a_id"), F.col("b_item_id").alias("b_id"), names.jaccard(F.col("a_k"), F.col("b_k")).alias("jaccard"))


def _titled(parts: DataFrame) -> DataFrame:
    """Parts with their titles; each different name becomes a title once."""
    titles = parts.select("p_name").distinct().withColumn("title_key", names.title_key(F.col("p_name")))
    return parts.join(titles, "p_name", "left")


def _media(titled: DataFrame, kind: str) -> DataFrame:
    """Parts as videos (even keys) and subtitles (odd keys) of a folder, their brand."""
    key = F.col("p_partkey")
    return titled.where(key % 2 == 0 if kind == "video" else key % 2 != 0).select(
        F.col("p_brand").alias("folder"), key.alias("id"), F.when(key % 7 != 0, F.col("p_size")).alias("episode"), F.when(key % 3 != 0, (key % 4).cast("int")).alias("season"),
        F.lit(None).cast("string").alias("special_type"), (key % 5).cast("int").alias("part"), F.lit(None).cast("int").alias("cour"), "title_key",
        F.when(key % 2 != 0, F.coalesce(F.get(F.array(*map(F.lit, ["vi", "en", "ja"])), (key % 4).cast("int")), F.lit("ko"))).alias("language"), (key % 50 == 0).alias("is_batch"),
    )


_MEDIA = f"""m AS (SELECT p_brand AS folder, p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS episode, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 4 END AS season, p_partkey % 5 AS part,
list_distinct(list_filter(string_split_regex(trim(lower(regexp_replace(regexp_replace(p_name, '[\\s._\\-–—：:]+', ' ', 'g'), '\\b\\d+\\b', ' ', 'g'))), '\\s+'), lambda w: (length(w) >= 2 OR regexp_full_match(w, '\\pL')) AND NOT list_contains([{_STOP}], w))) AS k,
CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.4 END AS lang, p_partkey % 50 = 0 AS batch FROM part),
j AS (SELECT a.folder, a.id AS v_id, b.id AS s_id, CASE WHEN a.episode = b.episode THEN 50.0 ELSE 0.0 END + CASE WHEN a.season = b.season THEN 25.0 ELSE 0.0 END + CASE WHEN (a.season IS NULL) <> (b.season IS NULL) THEN -5.0 ELSE 0.0 END
+ CASE WHEN a.part = b.part THEN 5.0 ELSE 0.0 END + 15.0 * CASE WHEN len(a.k) > 0 AND len(b.k) > 0 THEN len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k)))::DOUBLE ELSE 0.0 END + 5.0 * b.lang + CASE WHEN a.batch OR b.batch THEN -30.0 ELSE 0.0 END AS score
FROM m a JOIN m b ON a.folder = b.folder AND a.id % 2 = 0 AND b.id % 2 <> 0 WHERE NOT coalesce(a.episode <> b.episode, false) AND NOT coalesce(a.season <> b.season, false))"""


@query(f"WITH {_MEDIA} SELECT folder, v_id, s_id, floor(score * 1000 + 0.5)::BIGINT AS points FROM j WHERE score >= 20")
def scored_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = _titled(table(spark, sf_dir, "part"))
    found = scored_candidates(_media(titled, "video"), _media(titled, "subtitle"))
    return found.select(F.col("v_folder").alias("folder"), "v_id", "s_id", F.floor(F.col("score") * 1000 + 0.5).alias("points"))


@query()
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_match(scored_match(spark, sf_dir).withColumn("score", F.col("points") / 1000.0), ["folder"], "v_id", "s_id")


@query("SELECT doc_id, CASE WHEN lang IS NULL THEN 0.5 WHEN lower(lang) = 'en' THEN 0.9 ELSE 0.4 END::DOUBLE AS score FROM documents")
def lang_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", names.language_score(F.col("lang")).alias("score"))


@query()
def nfkc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(names.nfkc(F.col("text"))).alias("digest"), F.md5(names.nfc_casefold(F.col("text"))).alias("folded"))


@query("SELECT p_partkey, (p_partkey % 4 + 1)::INT AS season, (p_size % 24 + 1)::INT AS episode, false AS is_batch FROM part")
def episode_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("name", F.format_string("%s S%02d - %02d [1080p]", "p_name", (F.col("p_partkey") % 4 + 1).cast("int"), (F.col("p_size") % 24 + 1).cast("int")))
    told = parts.withColumn("f", names.episode_features(F.col("name"), names.special_type(F.col("name"))))
    return told.select("p_partkey", "f.season", "f.episode", "f.is_batch")


@query()
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fast_signature(F.encode("text", "UTF-8")).alias("signature"))


# ---- pages and links ----------------------------------------------------------------------------


@query("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("host"), web.path(F.col("url")).alias("path"))


ROUTES = [("blog", "blog"), ("news", "news"), ("example.com", "site"), ("example.org", "organisation")]
_ROUTES = " ".join(f"WHEN contains(h, '{d}') THEN '{n}'" for d, n in ROUTES)


@query(f"SELECT page_id, CASE {_ROUTES} ELSE 'unsupported' END AS route FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS h FROM pages)")
def site_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.routed(F.col("url"), ROUTES).alias("route"))


@query("SELECT page_id, regexp_replace(CASE WHEN regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim(url) ELSE 'https://' || trim(url) END, '[?#].*$', '') AS url FROM pages")
def sanitize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.sanitize_url(F.col("url")).alias("url"))


@query("""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1) AS l FROM pages), u AS (SELECT page_id, l[i] AS href, i - 1 AS ord FROM a, range(1, len(l) + 1) t(i)) SELECT page_id, href, min(ord)::BIGINT AS ord FROM u GROUP BY ALL""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(web.hrefs(F.col("html"))).alias("ord", "href"))
    return links.groupBy("page_id", "href").agg(F.min("ord").cast("long").alias("ord"))


@query("SELECT page_id, trim(split_part(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '|', 1)) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.page_title(F.col("html")).alias("title"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN u || '?page=' || (page_id + 1)::VARCHAR WHEN page_id % 3 = 1 THEN u || '?q=1&page=2' ELSE u || '?page=2' END AS next FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)")
def pagination_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = web.sanitize_url(F.col("url"))
    numbered = F.when(F.col("page_id") % 3 == 0, F.concat(url, F.lit("?page="), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.concat(url, F.lit("?q=1"))).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", web.next_page(numbered).alias("next"))


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), json_extract_string(props, '$.k'), '-1') AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", web.json_or(F.col("props"), "-1", "$.missing", "$.k").alias("k"))


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_trunc('second', ts) END AS t FROM events) WHERE coalesce(t >= TIMESTAMP '2024-01-10 00:00:00', true)")
def date_range_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text, a tenth of them unreadable: those from a day on and the unreadable ones."""
    text = F.when(F.col("event_id") % 10 == 0, "unknown").otherwise(F.date_format("ts", "HH:mm:ss dd/MM/yyyy"))
    kept = web.within_dates(text, F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit(None).cast("timestamp"))
    return table(spark, sf_dir, "events").where(kept).select("event_id")


# ---- ledgers -------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledger.pending(table(spark, sf_dir, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query("WITH e AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'success' ELSE event_type END AS status, ts FROM events) SELECT user_id, arg_max(status, struct_pack(d := status = 'success', t := ts, s := status)) AS status FROM e GROUP BY 1")
def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "success").otherwise(F.col("event_type")))
    return ledger.latest_status(entries, "user_id", "ts")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'miss' WHEN doc_id % 5 = 1 THEN 'size_changed' WHEN doc_id % 5 = 2 THEN 'schema_changed' WHEN doc_id % 5 = 3 THEN 'content_changed' ELSE 'hit' END AS state FROM documents")
def cache_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    files = docs.select("doc_id", F.col("n_chars").alias("file_size"), F.lit(0).cast("long").alias("mtime_ns"), F.md5("text").alias("fast_sig"))
    cache = docs.where(k != 0).select(
        "doc_id", (F.col("n_chars") + F.when(k == 1, 1).otherwise(0)).alias("file_size"), F.lit(0).cast("long").alias("mtime_ns"), F.when(k == 3, "other").otherwise(F.md5("text")).alias("fast_sig"),
        F.when(k == 2, 1).otherwise(2).alias("schema_version"), F.array(F.lit(1).cast("long")).alias("hashes"),
    )
    return ledger.cache_state(files, cache, "doc_id")


@query("SELECT sum(CASE WHEN r = 1 THEN 1 ELSE 0 END)::BIGINT AS added, sum(CASE WHEN r > 1 THEN 1 ELSE 0 END)::BIGINT AS skipped FROM (SELECT row_number() OVER (PARTITION BY regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) ORDER BY page_id) AS r FROM pages)")
def queue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ledger.queued(table(spark, sf_dir, "pages").withColumn("host", web.host(F.col("url"))), "host", "page_id")
    return told.agg(F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("skipped"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::BIGINT ELSE d.n_chars END AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def replacement_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"))
    return summary.replaced(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), new, "doc_id", "doc_id")


# ---- policies and estimates -----------------------------------------------------------------------


def image_size() -> Column:
    """Bytes of a text as an image."""
    return F.col("n_chars") * 4000


_NEED = "CASE WHEN s > 0 THEN greatest(0.0, (s - 4940000) * 100.0 / s) ELSE 0.0 END"
_KIND = f"CASE WHEN s = 4000 * 0 THEN 'unreadable' WHEN s < 4950000 THEN 'already_ok' WHEN {_NEED} < 10 AND s * 8.0 / 1000000 > 4 THEN 'easy' WHEN {_NEED} < 25 THEN 'moderate' WHEN {_NEED} < 45 OR s * 8.0 / 1000000 > 3 THEN 'challenging' ELSE 'difficult' END"


@query(f"SELECT doc_id, s > 0 AND s < 4950000 AS acceptable, s > 0 AND s < 4940000 AS preferred, {_KIND} AS potential FROM (SELECT doc_id, n_chars * 4000 AS s FROM documents)")
def policy_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as images of 4000 bytes a character and a megapixel."""
    kind = policy.potential(image_size() > 0, image_size(), F.lit(1000), F.lit(1000))
    return table(spark, sf_dir, "documents").select("doc_id", policy.acceptable(image_size()).alias("acceptable"), policy.preferred(image_size()).alias("preferred"), kind.alias("potential"))


def _estimate(q: str, codec: str) -> str:
    curve = {"PNG": f"(0.35 + 0.65 * ({q} / 100.0::DOUBLE)) * 0.97", "WEBP": f"(0.18 + 0.82 * pow({q} / 100.0::DOUBLE, 1.25)) * 0.985", "JPG": f"(0.22 + 0.78 * pow({q} / 100.0::DOUBLE, 1.35)) * 0.985"}[codec]
    return f"greatest(1024, trunc(s * {curve})::BIGINT)"


@query(f"SELECT doc_id, {_estimate('93', 'JPG')} AS jpg, {_estimate('93', 'WEBP')} AS webp, {_estimate('93', 'PNG')} AS png FROM (SELECT doc_id, n_chars * 4000 AS s FROM documents)")
def estimate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(policy.estimate_bytes(image_size(), F.lit(93), c).alias(c.lower()) for c in ("JPG", "WEBP", "PNG")))


@query(f"SELECT doc_id, max(q)::BIGINT AS quality FROM (SELECT doc_id, q, s, {_estimate('q', 'JPG')} AS e FROM (SELECT doc_id, n_chars * 4000 AS s FROM documents), range(35, 98) t(q)) WHERE e < 4940000 GROUP BY 1")
def max_quality_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = policy.max_quality_under(image_size(), F.lit(policy.PREFERRED)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", best.alias("quality")).where("quality is not null")


@query("SELECT q::BIGINT AS quality, CASE WHEN q >= 95 THEN 2 WHEN q >= 90 THEN 3 WHEN q >= 85 THEN 4 WHEN q >= 80 THEN 5 WHEN q >= 75 THEN 6 WHEN q >= 70 THEN 7 WHEN q >= 65 THEN 8 WHEN q >= 60 THEN 10 WHEN q >= 55 THEN 12 WHEN q >= 50 THEN 14 WHEN q >= 45 THEN 16 WHEN q >= 40 THEN 18 WHEN q >= 35 THEN 20 ELSE least(28, greatest(1, round_even(2 + (100 - q) * 0.28, 0)))::INT END::BIGINT AS q FROM (SELECT DISTINCT greatest(1, p_size) AS q FROM part)")
def quality_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.greatest(F.lit(1), F.col("p_size")).cast("long").alias("quality")).distinct()
    return sizes.select("quality", policy.quality_to_q(F.col("quality")).cast("long").alias("q"))


SUMMARY_SQL = f"""WITH i AS (SELECT doc_id, n_chars * 4000 AS s, (n_chars % 1000 + 1) AS w, (n_chars % 700 + 1) AS h, doc_id % 2 = 0 AS jpg FROM documents), o AS (SELECT *, s >= 4950000 AND s > 0 AS over FROM i),
e AS (SELECT *, greatest(0, s - 4940000) AS most, {_estimate('93', 'JPG')} AS e93, {_estimate('55', 'JPG')} AS e55 FROM o)
SELECT count(*)::BIGINT AS files, count(*) FILTER (jpg)::BIGINT AS jpegs, count(*) FILTER (NOT over AND s > 0)::BIGINT AS under_limit, count(*) FILTER (over)::BIGINT AS over_limit, sum(s)::BIGINT AS total_bytes, coalesce(sum(s) FILTER (over), 0)::BIGINT AS over_bytes,
coalesce(sum(least(most, greatest(0, s - e93))) FILTER (over), 0)::BIGINT AS savings_low, coalesce(sum(least(most, greatest(0, s - e55))) FILTER (over), 0)::BIGINT AS savings_high, min(w)::BIGINT AS min_width, max(h)::BIGINT AS max_height, floor(avg(w))::BIGINT AS avg_width FROM e"""


@query(SUMMARY_SQL)
def preflight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "documents").select(image_size().alias("size_bytes"), (F.col("n_chars") % 1000 + 1).alias("width"), (F.col("n_chars") % 700 + 1).alias("height"), (image_size() > 0).alias("is_readable"), (F.col("doc_id") % 2 == 0).alias("is_jpeg"))
    return summary.preflight(images).select("files", "jpegs", "under_limit", "over_limit", "total_bytes", "over_bytes", "savings_low", "savings_high", "min_width", "max_height", F.col("avg_width").cast("long").alias("avg_width"))


_EFF = " ".join(f"WHEN '{k}' THEN {v}" for k, v in policy.CODEC_EFFICIENCY.items())
_CODECS = list(policy.CODEC_EFFICIENCY)
_CODEC_SQL = "[" + ", ".join(f"'{c}'" for c in _CODECS) + "]"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN NOT (w > 0 AND f > 0) THEN 'unknown' WHEN x > 0.3 THEN 'high' WHEN x >= 0.15 THEN 'medium' WHEN x >= 0.08 THEN 'compressed' ELSE 'heavily_compressed' END AS category FROM (SELECT *, k * 1000.0 / (w * 720.0 * f) * CASE c {_EFF} END AS x FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 10 AS k, l_quantity * 40 AS w, 24.0 + l_linenumber AS f, {_CODEC_SQL}[(l_partkey % {len(_CODECS)} + 1)::INT] AS c FROM lineitem))")
def quality_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = F.element_at(F.array(*map(F.lit, _CODECS)), (F.col("l_partkey") % len(_CODECS) + 1).cast("int"))
    told = policy.quality_class(F.col("l_extendedprice") / 10, F.col("l_quantity") * 40, F.lit(720.0), F.lit(24.0) + F.col("l_linenumber"), codec)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", told["category"].alias("category"))


@query("SELECT o_orderkey, trunc(greatest(3800.0::DOUBLE * 8000 * 0.98 / d * 0.97 - 128, 100.0))::BIGINT AS kbps, greatest(100, trunc(4000 * (3984588800.0::DOUBLE / (o_totalprice * 30000)) * 0.95))::BIGINT AS retry FROM (SELECT *, o_totalprice / 10 AS d FROM orders)")
def target_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.target_kbps(price / 10, F.lit(128)).cast("long").alias("kbps"), policy.retry_kbps(F.lit(4000), price * 30000).cast("long").alias("retry"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS x, min(l_extendedprice) AS y FROM lineitem GROUP BY ALL), q AS (SELECT l_orderkey, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, min(y) OVER v AS lo, max(y) OVER v AS hi, row_number() OVER w AS i, count(*) OVER v AS n FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY x), v AS (PARTITION BY l_orderkey)),
c AS (SELECT *, CASE WHEN least(y, y2) <= 20000 AND 20000 <= greatest(y, y2) THEN 1 WHEN 20000 > hi AND i = 1 THEN 2 WHEN 20000 < lo AND i = n - 1 THEN 2 END AS fit FROM q WHERE x2 IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY fit, i) AS r FROM c WHERE fit IS NOT NULL) SELECT l_orderkey, floor((x + (ln(20000.0) - ln(y)) / ((ln(y) - ln(y2)) / (x - x2))) * 1000 + 0.5)::BIGINT AS estimate FROM b WHERE r = 1 AND y <> y2""")
def log_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as probe points: where their price would be 20,000."""
    prices = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("x")).agg(F.min("l_extendedprice").alias("y"))
    points = prices.groupBy("l_orderkey").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    told = points.select("l_orderkey", policy.log_interpolation(F.col("p"), F.lit(20000.0), F.lit(1.0)).alias("x")).where("x is not null")
    return told.select("l_orderkey", F.floor(F.col("x") * 1000 + 0.5).alias("estimate"))


_CANVAS = """WITH i AS (SELECT p_partkey AS k, p_size * 40 + 700 AS w, trunc(p_retailprice)::INT + 700 AS h FROM part), m AS (SELECT w, h, count(*) AS n, min(k) AS f FROM i GROUP BY ALL), t AS (SELECT arg_max(struct_pack(w := w, h := h, n := n), struct_pack(a := n, b := -f)) AS x, sum(n) AS every FROM m),
c AS (SELECT x.n * 2 >= every AS exact, CASE WHEN x.n * 2 >= every THEN x.w ELSE (SELECT median(w) FROM i) END AS cw, CASE WHEN x.n * 2 >= every THEN x.h ELSE (SELECT median(h) FROM i) END AS ch FROM t),
d AS (SELECT exact, (round_even(cw, 0)::BIGINT + round_even(cw, 0)::BIGINT % 2) AS cw, (round_even(ch, 0)::BIGINT + round_even(ch, 0)::BIGINT % 2) AS ch FROM c)"""


def _pages_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 40 + 700).alias("width"), (F.col("p_retailprice").cast("int") + 700).alias("height"))


@query(f"{_CANVAS} SELECT cw AS width, ch AS height, exact FROM d")
def canvas_mode_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.canvas(_pages_of_parts(spark, sf_dir), "k").select(F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "exact")


@query(f"{_CANVAS} SELECT k FROM i, d WHERE CASE WHEN exact THEN w <> cw OR h <> ch ELSE (w > h) <> (cw > ch) OR abs(w - cw) / cw::DOUBLE > 0.08 OR abs(h - ch) / ch::DOUBLE > 0.08 OR abs(w / h::DOUBLE - cw / ch::DOUBLE) / (cw / ch::DOUBLE) > 0.04 END")
def canvas_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _pages_of_parts(spark, sf_dir)
    plan = summary.canvas(images, "k").select(F.col("width").alias("cw"), F.col("height").alias("ch"), "exact")
    return images.join(F.broadcast(plan), F.lit(True)).where(summary.is_outlier(F.col("width"), F.col("height"), F.col("cw"), F.col("ch"), F.col("exact"))).select("k")


@query("WITH c AS (SELECT source AS kind, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1) SELECT kind, n::BIGINT AS n, n * 100.0 / sum(n) OVER ()::DOUBLE AS percent, row_number() OVER (ORDER BY n DESC, f) = 1 AS is_main FROM c")
def format_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.distribution(table(spark, sf_dir, "documents"), F.col("source"), "doc_id")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'compressed' WHEN 'view' THEN 'copied' WHEN 'error' THEN 'failed' ELSE 'skipped' END"


@query(f"WITH r AS (SELECT {_STATUS} AS s, 1000 AS o, CASE WHEN event_type = 'purchase' THEN user_id * 10 END AS b FROM events), t AS (SELECT count(*)::BIGINT AS total, count(*) FILTER (s = 'compressed')::BIGINT AS compressed, count(*) FILTER (s = 'copied')::BIGINT AS copied, count(*) FILTER (s = 'failed')::BIGINT AS failed, coalesce(sum(greatest(0, o - b)) FILTER (b IS NOT NULL), 0)::BIGINT AS bytes_saved FROM r) SELECT *, CASE WHEN failed = 0 THEN 0 WHEN failed = total THEN 1 ELSE 2 END::BIGINT AS exit_code FROM t")
def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "compressed").when(kind == "view", "copied").when(kind == "error", "failed").otherwise("skipped")
    results = table(spark, sf_dir, "events").select(status.alias("status"), F.lit(1000).alias("original_bytes"), F.when(kind == "purchase", F.col("user_id") * 10).alias("output_bytes"))
    return summary.outcome_report(results).select("total", "compressed", "copied", "failed", "bytes_saved", F.col("exit_code").cast("long").alias("exit_code"))


@query("SELECT l_orderkey, arg_max(l_linenumber, struct_pack(a := l_returnflag <> 'R', b := l_returnflag <> 'R' AND p < 4940000, c := l_returnflag <> 'R' AND p < 4950000, d := CASE WHEN p < 4950000 THEN 0 ELSE -p END, e := l_discount, f := l_quantity, g := -p, h := l_linenumber))::BIGINT AS line FROM (SELECT *, trunc(l_extendedprice)::BIGINT * 100 AS p FROM lineitem) GROUP BY 1")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("success"), (F.col("l_extendedprice").cast("long") * 100).alias("output_bytes"), F.col("l_discount").alias("scale_factor"), F.col("l_quantity").alias("quality"), "l_linenumber")
    return summary.best_attempts(lines, "l_orderkey").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query("""WITH s AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1), c AS (SELECT conv_id, list_transform(r, lambda x: CASE x WHEN 'user' THEN 'aac' WHEN 'assistant' THEN 'opus' ELSE 'dts' END) AS a, list_transform(list_filter(r, lambda x: x <> 'user'), lambda x: CASE x WHEN 'assistant' THEN 'subrip' ELSE 'mov_text' END) AS t FROM s)
SELECT conv_id, len(list_filter(a, lambda x: x = 'dts')) = 0 AS copyable, CASE WHEN len(t) = 0 THEN 'none' WHEN len(list_filter(t, lambda x: x <> 'mov_text')) = 0 THEN 'copy' ELSE 'mov_text' END AS subtitle FROM c""")
def stream_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    audio = F.transform("r", lambda x: F.when(x == "user", "aac").when(x == "assistant", "opus").otherwise("dts"))
    text = F.transform(F.filter("r", lambda x: x != "user"), lambda x: F.when(x == "assistant", "subrip").otherwise("mov_text"))
    return roles.select("conv_id", policy.audio_copyable(audio).alias("copyable"), policy.subtitle_plan(text).alias("subtitle"))


def _size_sql(step: int, units: list[str], decimals: int, whole: bool) -> str:
    parts = []
    for k, u in enumerate(units):
        text = f"(n)::BIGINT::VARCHAR || ' {u}'" if k == 0 and whole else f"printf('%.{decimals}f {u}', n / {float(step**k)}::DOUBLE)"
        parts.append(text if k == len(units) - 1 else f"CASE WHEN n < {step ** (k + 1)} THEN {text} ELSE ")
    return "".join(parts) + " END" * (len(units) - 1)


@query(f"SELECT doc_id, {_size_sql(1024, ['B', 'KB', 'MB', 'GB', 'TB', 'PB'], 2, True)} AS catalog, {_size_sql(1024, ['B', 'KiB', 'MiB', 'GiB', 'TiB'], 1, False)} AS remux, {_size_sql(1024, ['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB'], 2, False)} AS budget, {_size_sql(1000, ['B', 'KB', 'MB', 'GB', 'TB'], 2, True)} AS image, {_size_sql(1024, ['B', 'KB', 'MB', 'GB', 'TB'], 2, False)} AS converter FROM (SELECT doc_id, n_chars * (doc_id % 5000) * 8 AS n FROM documents)")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") * (F.col("doc_id") % 5000) * 8
    return table(spark, sf_dir, "documents").select(
        "doc_id", formatting.size_catalog(n).alias("catalog"), formatting.size_remux(n).alias("remux"), formatting.size_budget(n).alias("budget"), formatting.size_image(n).alias("image"), formatting.size_converter(n).alias("converter")
    )


@query("""SELECT doc_id, CASE WHEN r >= 3600 THEN printf('%02d:%02d:%02d', r // 3600, r // 60 % 60, r % 60) ELSE printf('%02d:%02d', r // 60 % 60, r % 60) END AS clock, CASE WHEN t >= 3600 THEN printf('%02d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) ELSE printf('%02d:%02d', t // 60 % 60, t % 60) END AS truncated,
CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN t >= 3600 THEN printf('%dh %02dm %02ds', t // 3600, t // 60 % 60, t % 60) ELSE printf('%dm %02ds', t // 60 % 60, t % 60) END AS words FROM (SELECT doc_id, n_chars / 4.0::DOUBLE AS s, round_even(n_chars / 4.0, 0)::BIGINT AS r, trunc(n_chars / 4.0)::BIGINT AS t FROM documents)""")
def human_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("n_chars") / 4.0
    return table(spark, sf_dir, "documents").select("doc_id", formatting.duration_clock(s).alias("clock"), formatting.duration_truncated(s).alias("truncated"), formatting.duration_words(s).alias("words"))


# ---- trees, grids, subtitles ----------------------------------------------------------------------


@query("""WITH n AS (SELECT NULL AS parent, 'r' || r_regionkey AS node, r_regionkey::BIGINT AS ord, r_name AS name FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_nationkey, n_name FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey, s_name FROM supplier),
w AS (SELECT a.node AS node_id, 0 AS depth, '' AS path FROM n a WHERE a.parent IS NULL UNION ALL SELECT b.node, 1, b.name FROM n b WHERE b.node LIKE 'n%' UNION ALL SELECT c.node, 2, b.name || '/' || c.name FROM n c JOIN n b ON c.parent = b.node WHERE c.node LIKE 's%') SELECT node_id, depth::BIGINT AS depth, path FROM w""")
def tree_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = (
        region.select(F.lit(None).cast("string").alias("parent_id"), node("r", "r_regionkey").alias("node_id"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("name"))
        .unionByName(nation.select(node("r", "n_regionkey").alias("parent_id"), node("n", "n_nationkey").alias("node_id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name")))
        .unionByName(supplier.select(node("n", "s_nationkey").alias("parent_id"), node("s", "s_suppkey").alias("node_id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name")))
    )
    return tree.expand(spark, nodes, F.col("parent_id").isNull()).select("node_id", F.col("depth").cast("long").alias("depth"), "path")


@query()
def grid_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 25 nations by their regions: the shortest path to two targets, one cell a row."""
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") / 5).cast("int").alias("row"), (F.col("n_nationkey") % 5).cast("int").alias("col"), F.col("n_regionkey").cast("string").alias("val"))
    path = tree.shortest_path(spark, nation, [["1", "2"], ["2", "3"]]) or []
    return spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(path)], "step int, row int, col int")


@query("SELECT conv_id, turn, printf('%02d:%02d:%02d,%02d0', turn // 60 % 24, turn % 60, conv_id % 60, conv_id % 100) AS start, trim(replace(text, chr(9), ' '), ' ' || chr(10)) AS line FROM conversations WHERE trim(replace(text, chr(9), ' '), ' ' || chr(10)) <> ''")
def ass_to_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as dialogue lines with tags, back to cues; a turn's lines are joined by the mark for line ends."""
    whole = F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit("\\N"))
    time = F.format_string("%d:%02d:%02d.%02d", F.floor(F.col("turn") / 60) % 24, F.col("turn") % 60, F.col("conv_id") % 60, F.col("conv_id") % 100)
    line = F.concat(F.lit("Dialogue: 0,"), time, F.lit(","), time, F.lit(",Default,,0,0,0,,{\\i1}"), whole, F.lit("{\\i0}"))
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", subtitles.dialogue_parts(line).alias("d"))
    line = F.btrim(subtitles.strip_tags(F.col("d.text")), F.lit(" \n"))
    return told.select("conv_id", "turn", subtitles.srt_time(F.col("d.start")).alias("start"), line.alias("line")).where("line != ''")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'system' THEN 'Default' WHEN 'tool' THEN 'sign' ELSE 'main' END AS style FROM conversations")
def style_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Dialogue: 0,0:00:00.00,0:00:01.00,x,"), "role", F.lit(",0,0,0,,text"))
    mapped = subtitles.styled(line, {"tool": "sign"}, ["system"], ["user"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(F.split(mapped, ","), 3).alias("style"))


@query(f"WITH {HASHED} SELECT vec_id, bit_count(xor(h, 6148914691236517205))::BIGINT AS distance FROM h")
def hamming_to_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).select("vec_id", hamming(F.col("h"), F.lit(6148914691236517205)).cast("long").alias("distance"))


# ---- decisions on rows ------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN page_id % 7 IN (3, 4) THEN false WHEN page_id % 2 = 0 THEN page_id % 7 IN (0, 2) ELSE page_id % 7 = 2 END AS valid FROM pages")
def response_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, [200, 302, 206, 403, 404, 301, 100])), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", web.valid_response(status, F.col("page_id") % 2).alias("valid"))


@query("SELECT event_type AS kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'image' WHEN event_type = 'purchase' THEN 'video' ELSE 'other' END AS event_type FROM events) GROUP BY 1")
def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    ext = F.when(kind == "click", "jpg").when(kind == "view", "webp").when(kind == "purchase", "mp4").otherwise("bin")
    return table(spark, sf_dir, "events").groupBy(web.media_kind(ext).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(a - b) > greatest(1.0, 0.01 * abs(a)) THEN 'duration_mismatch' WHEN l_linenumber % 3 = 0 THEN 'video_streams' WHEN l_linenumber % 5 = 0 THEN 'subtitle_streams' END AS fault FROM (SELECT *, l_extendedprice AS a, l_extendedprice * (1 + l_tax / 4) AS b FROM lineitem)""")
def remux_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    source = {"video": F.lit(1), "audio": F.lit(2), "subtitle": F.lit(0)}
    out = {"video": F.when(line % 3 == 0, 0).otherwise(1), "audio": F.lit(2), "subtitle": F.when(line % 5 == 0, 1).otherwise(0)}
    fault = policy.verify_remux(F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_tax") / 4), source, out)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fault.alias("fault"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'unreadable' WHEN doc_id % 7 = 0 THEN 'codec_mismatch' WHEN doc_id % 5 = 0 THEN 'dimension_mismatch' WHEN doc_id % 3 = 0 THEN 'icc_missing' WHEN NOT (n_chars * 4000 > 0 AND n_chars * 4000 < 4950000) THEN 'size_over_limit' END AS fault FROM documents""")
def output_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    expected = {"codec": F.lit("PNG"), "width": F.lit(10), "height": F.lit(10), "has_alpha": F.lit(True), "icc_sha256": F.lit("x")}
    actual = {
        "is_readable": d % 11 != 0, "codec": F.when(d % 7 == 0, "JPG").otherwise("PNG"), "width": F.when(d % 5 == 0, 9).otherwise(10), "height": F.lit(10), "has_alpha": F.lit(True),
        "icc_sha256": F.when(d % 3 != 0, "x"), "size": image_size(),
    }
    return table(spark, sf_dir, "documents").select("doc_id", policy.verify_output(expected, actual).alias("fault"))


@query("WITH f AS (SELECT l_suppkey AS folder, sum(CASE WHEN l_returnflag = 'N' THEN 2 ELSE 0 END + CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 5 ELSE 0 END)::BIGINT AS score FROM lineitem GROUP BY 1) SELECT folder, score FROM f")
def folder_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)
    listing = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("folder"), F.when(F.col("l_returnflag") == "N", ".jpg").otherwise(".bin").alias("extension"), F.when(tool, "tool").otherwise("file").alias("name"))
    return summary.folder_scores(listing, [".jpg"], ["tool"])


@query("""WITH n AS (SELECT p_partkey, p_type, p_brand, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS n FROM part), p AS (SELECT *, CASE WHEN n = 1 THEN p_type ELSE replace(p_brand, '/', '__') || '__' || p_type END AS t FROM n),
m AS (SELECT *, row_number() OVER (PARTITION BY lower(t) ORDER BY p_partkey) AS m FROM p) SELECT p_partkey, CASE WHEN m = 1 THEN t ELSE t || '_' || m::VARCHAR END AS target FROM m""")
def prefix_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("name"), F.col("p_brand").alias("parents"))
    return naming.prefixed_on_collision(parts, "name", "parents", ["p_partkey"]).select("p_partkey", "target")


#: Start points over all orders: shares of the duration, clamped to the end, each kept if over half a second from the last one kept.
_POINTS = "list_transform([0.1, 0.3, 0.5, 0.7, 0.9], lambda p: CASE WHEN d * p::DOUBLE + 10 > d THEN greatest(0.0, d - 10) ELSE d * p::DOUBLE END)"
_SPREAD = "list_reduce(list_prepend([x[1]], list_transform(x[2:], lambda v: [v])), lambda s, v: CASE WHEN abs(s[-1] - v[1]) <= 0.5 THEN s ELSE list_concat(s, v) END)"


@query(f"SELECT o_orderkey, CASE WHEN d <= 10 THEN 1 WHEN d <= 20 THEN 2 ELSE len({_SPREAD}) END::BIGINT AS clips FROM (SELECT o_orderkey, d, {_POINTS} AS x FROM (SELECT o_orderkey, o_totalprice / 1000 AS d FROM orders))")
def sample_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(policy.sample_starts(d)).cast("long").alias("clips"))


@query("""WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cue FROM conversations WHERE role <> 'system'), b AS (SELECT conv_id, cue, cue::VARCHAR || chr(10) || '00:00:' || lpad((turn % 60)::VARCHAR, 2, '0') || ',000 --> 00:00:' || lpad((turn % 60)::VARCHAR, 2, '0') || ',000' || chr(10) || role || chr(10) || chr(10) AS block FROM s)
SELECT conv_id::VARCHAR AS file, md5(string_agg(block, '' ORDER BY cue)) AS digest FROM b GROUP BY 1""")
def cue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as subtitle files: system turns are drawings, which leave no cue."""
    time = F.format_string("0:00:%02d.00", F.col("turn") % 60)
    text = F.when(F.col("role") == "system", F.lit("{\\p1}m 0 0")).otherwise(F.col("role"))
    line = F.concat(F.lit("Dialogue: 0,"), time, F.lit(","), time, F.lit(",Default,,0,0,0,,"), text)
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("ord"), line.alias("line"))
    return subtitles.srt_documents(subtitles.to_cues(lines)).select("file", F.md5("srt").alias("digest"))
