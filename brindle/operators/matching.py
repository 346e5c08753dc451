"""Scored matching of two lists and a greedy one-to-one assignment."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.names import jaccard, jaccard_at_most, jaccard_of_words, key_words, language_score, word_mask

LEAST_SCORE, AMBIGUOUS = 20.0, 3.0
#: What the score of a pair depends on, besides the folder; rows that score alike and are held as one.
SCORED, CLASS_ROWS = ("episode", "season", "special_type", "part", "cour", "title_key", "language", "is_batch"), 256
#: Kinds of partners: with the same episode, without one on the subtitle's side, without one on the video's side only.
KNOWN, NO_SUBTITLE_EPISODE, NO_VIDEO_EPISODE = 0, 1, 2
#: How rows meet: by episode (that kind only), by season, by special type, or by a word, with no season on either side or on one.
EPISODE, SEASON, SPECIAL, NO_SEASON, NO_VIDEO_SEASON, NO_SUBTITLE_SEASON = range(6)
#: The most that a pair gets without an equal episode, season or special type and without a common word; slack for sums of floats.
WITHOUT_TITLE, SLACK = 15.0, 1e-9


def contradict(v: str = "v_", s: str = "s_") -> Column:
    """A video (v_*) and a subtitle (s_*) have different episodes, seasons or special types."""
    return F.expr(" OR ".join(f"coalesce({v}{c} <> {s}{c}, false)" for c in ("episode", "season", "special_type")))


def _points(title: Column, spoken: Column, v: str = "v_", s: str = "s_") -> Column:
    """Points of a pair whose titles have this similarity and whose subtitle has this score of its language."""
    equal = lambda c, points: f"IF({v}{c} = {s}{c}, {points}D, 0D)"
    one_season = f"IF(({v}season IS NULL) <> ({s}season IS NULL), -5D, 0D)"
    same = [equal("episode", 50), equal("season", 25), one_season, equal("special_type", 20), equal("part", 5), equal("cour", 5)]
    return F.expr(" + ".join(same)) + 15.0 * title + 5.0 * spoken + F.expr(f"IF({v}is_batch OR {s}is_batch, -30D, 0D)")


def match_score(v: str = "v_", s: str = "s_") -> Column:
    """Points of a video (v_*) and a subtitle (s_*); null where they contradict each other."""
    return F.when(~contradict(v, s), _points(jaccard(F.col(f"{v}title_key"), F.col(f"{s}title_key")), language_score(F.col(f"{s}language")), v, s))


def _classes(rows: DataFrame, folder: str) -> DataFrame:
    """Rows that score alike as one, with the rest of their columns as members; large classes in parts of about CLASS_ROWS."""
    alike = [folder, *(c for c in rows.columns if c in SCORED and c != folder)]
    rest = [c for c in rows.columns if c not in alike]
    parts = F.ceil(F.count("*").over(Window.partitionBy(*alike)) / CLASS_ROWS)
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*(rest or alike)), parts))
    return dealt.groupBy(*alike, "__part").agg(F.collect_list(F.struct(F.lit(True).alias("__row"), *rest)).alias("__members")).drop("__part")


def _ways(video: bool, least: float) -> Column:
    """How a class meets partners without the same episode: array of way and words.

    Pairs without an equal season or special type need similar titles: the words of a title, in one order for all, of which
    the first so many can't all be missing from a title that is similar enough.
    """
    others = f"(5D * (int(part IS NOT NULL) + int(cour IS NOT NULL)) + 5D * {'1D' if video else '__spoken'} - IF(is_batch, 30D, 0D))"
    every, none = "array('')", "CAST(array() AS array<string>)"
    way = lambda k, words: f"named_struct('way', {k}, 'words', {words})"

    def titles(k: int, less: float) -> str:
        if least <= WITHOUT_TITLE:
            return way(k, every)
        need = f"(({least + less}D - {others}) / 15D - {SLACK}D)"
        return way(k, f"IF({need} <= 1D, slice(__words, 1, __n - int(ceil(greatest({need}, 0D) * __n)) + 1), {none})")

    alone, other = (NO_VIDEO_SEASON, NO_SUBTITLE_SEASON) if video else (NO_SUBTITLE_SEASON, NO_VIDEO_SEASON)
    special = way(SPECIAL, f"IF(special_type IS NULL, {none}, array(special_type))")
    with_season = f"array({way(SEASON, every)}, {titles(other, 5.0)}, {special})"
    return F.expr(f"IF(season IS NULL, array({titles(NO_SEASON, 0.0)}, {titles(alone, 5.0)}, {special}), {with_season})")


def _met(classes: DataFrame, p: str, folder: str, kinds: str, least: float) -> DataFrame:
    """Classes with prefixed names, their words and the score of their language, once for each way in which they meet a kind of partners."""
    words = F.sort_array(F.coalesce(key_words(F.col("title_key")), F.array().cast("array<string>")))
    told = classes.select("*", words.alias("__words"), language_score(F.col("language")).alias("__spoken"))
    told = told.select("*", F.size("__words").alias("__n"), word_mask(F.col("__words")).alias("__mask"))
    own = [F.col(c).alias(f"{p}{c}") for c in told.columns]
    kept = [F.col(folder).alias("__folder"), F.expr(f"CASE __met.way WHEN {EPISODE} THEN episode WHEN {SEASON} THEN season END").alias("__number")]
    known = F.expr(f"array(named_struct('way', {EPISODE}, 'words', array('')))")
    met = told.select("*", F.expr(f"explode({kinds})").alias("__kind")).select("*", F.explode(F.when(F.col("__kind") == KNOWN, known).otherwise(_ways(p == "v_", least))).alias("__met"))
    return met.select(*own, *kept, "__kind", F.col("__met.way").alias("__way"), F.explode("__met.words").alias("__word"))


def scored_candidates(videos: DataFrame, subtitles: DataFrame, folder: str = "folder", least: float = LEAST_SCORE) -> DataFrame:
    """Pairs within a folder that score enough: v_*, s_*, score.

    Rows that score alike are scored once, and all meet in one equality join: by episode, or where one has none, by season,
    special type or words of titles, as without an equal one of the former only similar titles score enough. Words are only
    compared where the most that their masks allow scores enough: quotients and sums of floats don't fall when both or a
    term grow, so that loses none.
    """
    x, y = _classes(videos, folder), _classes(subtitles, folder)
    a = _met(x, "v_", folder, f"IF(episode IS NULL, array({NO_SUBTITLE_EPISODE}, {NO_VIDEO_EPISODE}), array({KNOWN}, {NO_SUBTITLE_EPISODE}))", least)
    b = _met(y, "s_", folder, f"IF(episode IS NULL, array({NO_SUBTITLE_EPISODE}), array({KNOWN}, {NO_VIDEO_EPISODE}))", least)
    spoken, way, words = F.col("s___spoken"), a["__way"], (F.col("v___words"), F.col("s___words"))
    met = [*(a[c] == b[c] for c in ("__folder", "__kind", "__way", "__word")), a["__number"].eqNullSafe(b["__number"])]
    at_most = jaccard_at_most(*map(F.col, ("v___n", "v___mask", "s___n", "s___mask")))
    lacks = lambda c: F.col(f"v_{c}").isNull() | F.col(f"s_{c}").isNull()
    # A pair that could meet in several ways meets by season, else by special type, else by its first common word.
    first = F.lit(True) if least <= WITHOUT_TITLE else F.get(F.array_intersect(*words), F.lit(0)) == a["__word"]
    once = F.when(way < SPECIAL, True).when(way == SPECIAL, lacks("season")).otherwise(lacks("special_type") & first)
    close = a.join(b, [*met, ~contradict(), _points(at_most, spoken) >= least, once])
    none_common = F.col("v___mask").bitwiseAND(F.col("s___mask")) == 0
    score = _points(F.when(none_common, 0.0).otherwise(jaccard_of_words(*words)), spoken)
    enough = close.withColumn("score", F.explode(F.array(score))).where(F.col("score") >= least)  # exploded: computed once
    each = enough.withColumn("__v", F.explode("v___members")).withColumn("__s", F.explode("s___members"))
    side = lambda df, of, p: [F.col(f"{p}_{c}") if c in of.columns else F.col(f"__{p}.{c}").alias(f"{p}_{c}") for c in df.columns]
    return each.select(*side(videos, x, "v"), *side(subtitles, y, "s"), "score")


def _flat(numbers: np.ndarray) -> array:
    """Read one by one as fast as a list, in a fifth of its memory."""
    return array("q", numbers.astype("int64", copy=False).tobytes())


def _chained(ends: np.ndarray) -> tuple[Callable[[int], list[int]], array, array]:
    """Pairs with the same end as chains in their order: its pairs, and of each pair the one before and after, or -1."""
    order = np.argsort(ends, kind="stable")
    firsts = np.searchsorted(ends[order], np.arange(len(ends) + 1))
    same = ends[order][1:] == ends[order][:-1]
    before, after = np.full(len(ends), -1), np.full(len(ends), -1)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return lambda k: order[firsts[k] : firsts[k + 1]].tolist(), _flat(before), _flat(after)


def greedy_match(candidates: DataFrame, by: list[str], left: str, right: str, score: str = "score", margin: float = AMBIGUOUS) -> DataFrame:
    """(by, left, right, score, ambiguous): one-to-one, the best first; a pair with a free rival within the margin is only reported.

    The rivals of a pair are those of either side that are still free. Ties go by left, then right. The
    order of choices makes this sequential within a group; free pairs of each side are chained by score, so that only
    the nearest ones are compared.
    """
    kinds = ", ".join(f"`{c}` {candidates.schema[c].dataType.simpleString()}" for c in [*by, left, right, score])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, left, right], ascending=[False, True, True], kind="stable")
        ends = [pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in (left, right)]
        (of_left, before_left, after_left), (of_right, before_right, after_right) = map(_chained, ends)
        a_of, b_of, points = _flat(ends[0]), _flat(ends[1]), pdf[score].tolist()
        used_left, used_right, chosen, told = set(), set(), array("q"), bytearray()

        def rival(e: int, step: array, other: array) -> bool:
            """The next free pair of this side to another partner has the nearest score."""
            f = step[e]
            while f >= 0 and other[f] == other[e]:
                f = step[f]
            return f >= 0 and abs(points[e] - points[f]) < margin

        for e, (a, b) in enumerate(zip(a_of, b_of, strict=True)):
            if a in used_left or b in used_right:
                continue
            ambiguous = rival(e, before_left, b_of) or rival(e, after_left, b_of) or rival(e, before_right, a_of) or rival(e, after_right, a_of)
            chosen.append(e)
            told.append(ambiguous)
            if not ambiguous:
                used_left.add(a)
                used_right.add(b)
                for rows, before, after in ((of_right(b), before_left, after_left), (of_left(a), before_right, after_right)):
                    for f in rows:
                        p, n = before[f], after[f]
                        if p >= 0:
                            after[p] = n
                        if n >= 0:
                            before[n] = p
        return pdf.iloc[chosen][[*by, left, right, score]].assign(ambiguous=np.frombuffer(told, dtype=bool))

    return candidates.select(*by, left, right, score).groupBy(*by).applyInPandas(assign, f"{kinds}, ambiguous boolean")


def unmatched(items: DataFrame, matches: DataFrame, on: list[str]) -> DataFrame:
    return items.join(matches.where("not ambiguous"), on, "left_anti")
