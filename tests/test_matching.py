"""The matching at size: rows that score alike, long chains of rivals."""

import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.functions import names
from brindle.operators import matching

KINDS = "folder string, id long, episode int, season int, special_type string, part int, cour int, title_key string, language string, is_batch boolean"


def _items(spark, n, seed):
    rng = random.Random(seed)
    some = lambda *x: rng.choice([None, *x])
    return spark.createDataFrame([(some("f", "g"), k % (n - 5), some(1, 2), some(1, 2), some("OVA"), some(1), some(1), rng.choice(["", "a b", "a c"]), some("vi", "en"), rng.random() < 0.2) for k in range(n)], KINDS)


@pytest.mark.parametrize("rows", [1, 256])
def test_candidates_equal_all_pairs(spark, monkeypatch, rows):
    """Scored as classes or one by one: nulls and repeated rows alike."""
    monkeypatch.setattr(matching, "CLASS_ROWS", rows)
    v, s = _items(spark, 120, 1), _items(spark, 90, 2)
    a, b = (x.select(*(F.col(c).alias(p + c) for c in x.columns)) for x, p in ((v, "v_"), (s, "s_")))
    want = a.join(b, F.col("v_folder") == F.col("s_folder")).withColumn("score", matching.match_score()).where("score >= 20")
    got = matching.scored_candidates(v, s)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.count() > 500


def test_rows_that_score_alike_are_joined_once(spark):
    """400 by 400 rows of one class make one pair to score."""
    one = spark.range(400).select(F.lit("f").alias("folder"), F.col("id"), F.lit(1).alias("episode"), F.lit(1).alias("season"), *(F.lit(None).cast(k).alias(c) for c, k in (("special_type", "string"), ("part", "int"), ("cour", "int"))), F.lit("a").alias("title_key"), F.lit("en").alias("language"), F.lit(False).alias("is_batch"))
    assert matching._classes(one, "folder").count() <= 2
    assert matching.scored_candidates(one, one).count() == 160_000


def _plain(pairs):
    taken, out = set(), set()
    for x, v, s in sorted((-x, v, s) for v, s, x in pairs):
        if ("v", v) in taken or ("s", s) in taken:
            continue
        ambiguous = any(abs(y + x) < 3.0 and (w == v) != (t == s) and ("v", w) not in taken and ("s", t) not in taken for w, t, y in pairs)
        out.add((v, s, ambiguous))
        if not ambiguous:
            taken |= {("v", v), ("s", s)}
    return out


def test_greedy_equals_plain_loops(spark):
    rng = random.Random(5)
    pairs = [(v, s, float(rng.choice([20, 22, 25, 31, 50, 57, 90])) + rng.choice([0.0, 2.999])) for v in range(25) for s in range(25) if rng.random() < 0.3]
    pairs += pairs[:20]  # repeated rows are no rivals of themselves
    got = matching.greedy_match(spark.createDataFrame([("f", *p) for p in pairs], "folder string, v int, s int, score double"), ["folder"], "v", "s").collect()
    assert {(r.v, r.s, r.ambiguous) for r in got} == _plain(pairs) and {r.ambiguous for r in got} == {True, False}


def test_greedy_of_many_rivals(spark):
    """A million pairs that are all rivals: reading all rivals of each takes minutes."""
    n = 1000
    pairs = spark.range(n * n).select(F.lit("f").alias("folder"), F.floor(F.col("id") / n).alias("v"), (F.col("id") % n).alias("s"), F.lit(50.0).alias("score"))
    began = time.time()
    assert matching.greedy_match(pairs, ["folder"], "v", "s").where("ambiguous").count() == n * n
    assert time.time() - began < 60


def test_titles_are_compared_where_they_can_matter(spark):
    """16 million pairs without an episode, of which 4,000 have the same title: comparing the words of all takes minutes."""
    items = lambda episode, language: spark.range(4000).select(F.lit("f").alias("folder"), "id", episode.cast("int").alias("episode"), *(F.lit(None).cast(k).alias(c) for c, k in (("season", "int"), ("special_type", "string"))), F.lit(1).alias("part"), F.lit(None).cast("int").alias("cour"), F.concat_ws(" ", F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id")).alias("title_key"), F.lit(language).alias("language"), F.lit(False).alias("is_batch"))
    began = time.time()
    got = matching.scored_candidates(items(F.lit(None), "vi"), items(F.lit(3), "vi")).select("v_id", "s_id", "score").collect()
    assert sorted(map(tuple, got)) == [(k, k, 25.0) for k in range(4000)]
    assert time.time() - began < 60


def test_masks_bound_the_similarity_of_titles(spark):
    rng = random.Random(3)
    title = lambda: " ".join({f"w{rng.randrange(90)}" for _ in range(rng.randrange(9))})
    pairs = spark.createDataFrame([(title(), title()) for _ in range(2000)] + [("a", "a"), ("", "a"), (None, "a")], "a string, b string")
    a, b = map(names.key_words, (F.col("a"), F.col("b")))
    at_most = names.jaccard_at_most(F.size(a), names.word_mask(a), F.size(b), names.word_mask(b))
    got = pairs.select(names.jaccard(F.col("a"), F.col("b")), F.coalesce(at_most, F.lit(0.0))).collect()
    assert all(x <= y <= 1 for x, y in got) and sum(y - x for x, y in got) < 0.05 * len(got)


@pytest.mark.parametrize("least", [5.0, 16.0, 20.0, 28.0])
def test_rows_without_an_episode_meet_by_what_can_score(spark, least):
    """Seasons, special types and titles of up to six words, also with a least score that pairs without a common word reach."""
    rng = random.Random(8)

    def items(n):
        some = lambda *x: rng.choice([None, *x])
        title = lambda: " ".join(sorted({f"w{rng.randrange(8)}" for _ in range(rng.randrange(7))}))
        return spark.createDataFrame([("f", k, some(1), some(1, 2), some("OVA", "SP"), some(1, 2), some(1), title(), some("vi", "en", "ko"), rng.random() < 0.1) for k in range(n)], KINDS)

    v, s = items(250), items(220)
    a, b = (x.select(*(F.col(c).alias(p + c) for c in x.columns)) for x, p in ((v, "v_"), (s, "s_")))
    want = a.crossJoin(b).withColumn("score", matching.match_score()).where(F.col("score") >= least).select("v_id", "s_id", "score").collect()
    got = matching.scored_candidates(v, s, least=least).select("v_id", "s_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 1000


def test_titles_meet_by_their_words(spark):
    """144 million pairs without an episode in a folder, of which 12,000 have the same title: testing each pair takes minutes."""
    items = lambda episode: spark.range(12_000).select(F.lit("f").alias("folder"), "id", episode.cast("int").alias("episode"), *(F.lit(None).cast(k).alias(c) for c, k in (("season", "int"), ("special_type", "string"))), F.lit(1).alias("part"), F.lit(None).cast("int").alias("cour"), F.concat_ws(" ", F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id")).alias("title_key"), F.lit("vi").alias("language"), F.lit(False).alias("is_batch"))
    began = time.time()
    got = matching.scored_candidates(items(F.lit(None)), items(F.lit(3))).select("v_id", "s_id", "score").collect()
    assert sorted(map(tuple, got)) == [(k, k, 25.0) for k in range(12_000)]
    assert time.time() - began < 60
