"""Line dedup by a deletion-neighbourhood join. DataFrame operations only.

Lines compare with white space as one space. A line goes if an equal line stands in a document with a
smaller doc_id or further up in the same text, or if a line within the edit bound stands in
a document with a smaller doc_id. The edit bound is one word in lines of ``near_words`` or more, which is
the share of edits that counts as near (one word in ten), and none in shorter ones. Lines without words stay;
``min_words`` can spare short lines too, which by default it doesn't.

Two lines are within one edit of a word (one put in, left out or replaced) only if they share a
variant: the line itself or the line without one of its words. Variants are emitted as hashed
keys, equal ones are joined, each line with the earliest of its key, and the edit distance of what
is joined is verified on the words. A key is a sum over pairs of neighbouring words, so that it
takes constant time for each word left out. Two keys, equal but for the place of the word left
out, would also join lines that are two edits apart; so replaced words join at equal places.

A line has a partner only if a line shares its first half (edit in the second) or its second half
(edit in the first), halves being counted in the words of the shorter line; a line emits the
variants of the halves for which that holds, which loses none. Lines are told apart by a 64-bit
hash and their length.

Rows: null and empty texts have no lines to go; a null doc_id is after all others; rows of one
doc_id are neither earlier nor later than each other; repeated rows give equal results; an empty
table gives no rows; further columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD_GAP, read_table, written

#: The least words of a line that may go, and of one that may differ by a word.
MIN_WORDS, NEAR_WORDS = 1, 10
LAST = (1 << 63) - 1
#: Bits of a hashed pair: sums over lines of millions of words stay in 64 bits.
PAIR_BITS = 40
#: Lines that may have partners are broadcast up to so many (32 bytes each), and joined beyond.
BROADCAST_ROWS = 1_000_000
LINE = ["h", "len"]
#: The white space of WORD_GAP.
SPACES = " \t\n\x0b\x0c\r"


def _order() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def lines_of(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text_hash, line, norm): the lines of each text that count; doc: doc_id, or the last number for none."""
    raw = F.col("raw")
    odd = F.startswith(raw, F.lit(" ")) | F.endswith(raw, F.lit(" "))
    for gap in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(raw, F.lit(gap))
    norm = F.when(odd, F.trim(F.regexp_replace(raw, WORD_GAP, " "))).otherwise(raw)
    rows = docs.where("text is not null").select(_order().alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    # Blank lines go by a test of the raw line: a filter on norm would compute it again for each mention.
    lines = rows.where(F.ltrim("raw", F.lit(SPACES)) != "").select("doc", "text_hash", "line", norm.alias("norm"))
    return lines.where(n_words("norm") >= min_words) if min_words > 1 else lines


def n_words(norm: str) -> Column:
    return F.when(F.col(norm) == "", 0).otherwise(F.char_length(norm) - F.char_length(F.replace(F.col(norm), F.lit(" "))) + 1)


def _named(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"h": F.xxhash64("norm"), "len": F.char_length("norm")})


#: The halves of a line of n words: as the shorter or equal line of a pair (of n words), as the longer (of n - 1).
HALVES = {"first": (0, 1), "second": (0, -1), "first_longer": (1, 1), "second_longer": (1, -1)}


def _halves(near_words: int) -> dict[str, Column]:
    """Hashes of the halves, with the words of the shorter line; null for lines of too few words."""
    near = F.col("n") >= near_words
    half = lambda less, sign: F.expr(f"substring_index(norm, ' ', {sign} * ((n - {less}) div 2))")
    return {name: F.when(near & (F.col("n") - less >= near_words), F.xxhash64(F.col("n") - less, F.lit(sign), half(less, sign))) for name, (less, sign) in HALVES.items()}


def with_partners(distinct: DataFrame) -> DataFrame:
    """Of the distinct lines (h, len, doc and halves): those that may have partners, and which halves are shared."""
    ends = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(name).alias("half")) for k, name in enumerate(HALVES)))
    keyed = distinct.where("first is not null").select(*LINE, "doc", F.explode(ends).alias("e")).select(*LINE, "doc", "e.kind", "e.half").where("half is not null")
    shared = keyed.groupBy("half").count().where("count > 1").select("half")
    return keyed.join(shared, "half", "left_semi").groupBy(*LINE).agg(F.min("doc").alias("doc"), *(F.max(F.col("kind") == k).alias(name) for k, name in enumerate(HALVES)))


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b).bitwiseAND((1 << PAIR_BITS) - 1)


def variants(candidates: DataFrame) -> DataFrame:
    """(h, len, doc, key, left, place): the line (place -1) and the line without the word at a place; left: words left."""
    bounded = candidates.withColumn("w", F.concat(F.array(F.lit("")), F.split("norm", " "), F.array(F.lit(""))))
    n = F.size("w") - 2
    paired = bounded.withColumn("pairs", F.transform(F.sequence(F.lit(0), n), lambda i: _pair(F.get("w", i), F.get("w", i + 1))))
    summed = paired.withColumn("total", F.aggregate("pairs", F.lit(0).cast("long"), lambda s, x: s + x))
    left_out = lambda i: F.col("total") - F.get("pairs", i) - F.get("pairs", i + 1) + _pair(F.get("w", i), F.get("w", i + 2))
    own, less = F.floor(n / 2), F.floor((n - 1) / 2)
    wanted = lambda i: (F.col("first") & (i >= own)) | (F.col("second") & (i < own)) | (F.col("first_longer") & (i >= less)) | (F.col("second_longer") & (i < less))
    whole = F.array(F.struct(F.col("total").alias("key"), n.alias("left"), F.lit(-1).alias("place")))
    places = F.filter(F.sequence(F.lit(0), n - 1), wanted)
    every = F.concat(whole, F.transform(places, lambda i: F.struct(left_out(i).alias("key"), (n - 1).alias("left"), i.alias("place"))))
    return summed.select(*LINE, "doc", F.explode(every).alias("v")).select(*LINE, "doc", "v.*")


def _within_one_edit(a: Column, b: Column) -> Column:
    """Of arrays of words: what agrees at the start and at the end leaves one word of the longer at most."""
    first_difference = lambda x, y: F.coalesce(F.nullif(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False), F.lit(0)) - 1, F.size(x))
    return first_difference(a, b) + first_difference(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def near_lines(spark: SparkSession, docs: DataFrame, distinct: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(h, len, near): the smallest doc that a line within one edit stands in."""
    partners = written(spark, with_partners(distinct), "partners")
    small = partners.count() <= BROADCAST_ROWS
    found = _named(lines_of(docs, min_words)).select("norm", *LINE).join(F.broadcast(partners) if small else partners, LINE)
    candidates = written(spark, found.groupBy(*LINE, "doc", *HALVES).agg(F.min("norm").alias("norm")), "candidates")
    keys = written(spark, variants(candidates), "variants")
    out = keys.where("place >= 0")
    key = ["key", "left"]
    least = F.min(F.struct("doc", *LINE)).alias("p")
    replaced = out.join(out.groupBy(*key, "place").agg(least, F.count("*").alias("n")).where("n > 1").drop("n"), [*key, "place"])
    whole = keys.where("place < 0").groupBy(*key).agg(least)
    shorter = out.join(whole, key)
    longer = keys.where("place < 0").join(out.groupBy(*key).agg(least), key)
    pairs = replaced.select(*LINE, "doc", "p").unionAll(shorter.select(*LINE, "doc", "p")).unionAll(longer.select(*LINE, "doc", "p"))
    joined = pairs.where("p.doc < doc").groupBy(*LINE, F.col("p.h").alias("ph"), F.col("p.len").alias("plen"), F.col("p.doc").alias("near")).agg(F.lit(1))
    words = candidates.select(*LINE, F.split("norm", " ").alias("w"))
    other = words.select(F.col("h").alias("ph"), F.col("len").alias("plen"), F.col("w").alias("pw"))
    verified = joined.join(words, LINE).join(other, ["ph", "plen"]).where(_within_one_edit(F.col("w"), F.col("pw")))
    return verified.groupBy(*LINE).agg(F.min("near").alias("near"))


def removed_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc, text_hash, gone): the numbers of the lines that go, for texts that lose any."""
    named = _named(lines_of(docs, min_words)).withColumn("n", n_words("norm"))
    lines = written(spark, named.select("doc", "text_hash", "line", *LINE, *(c.alias(k) for k, c in _halves(max(2, near_words)).items())), "lines")
    distinct = written(spark, lines.groupBy(*LINE).agg(F.min("doc").alias("doc"), F.count("*").alias("n"), *(F.min(k).alias(k) for k in HALVES)), "distinct-lines")
    near_by = near_lines(spark, docs, distinct, min_words)
    repeated = distinct.join(near_by, LINE, "left").where("n > 1 or near is not null").select(*LINE, F.least("doc", "near").alias("earliest"))
    hits = lines.select("doc", "text_hash", "line", *LINE).join(repeated, LINE).repartition("doc", "text_hash")
    again = F.col("line") > F.min("line").over(Window.partitionBy("doc", "text_hash", *LINE))
    gone = hits.withColumn("again", again).where((F.col("earliest") < F.col("doc")) | F.col("again"))
    return gone.groupBy("doc", "text_hash").agg(F.collect_set("line").alias("gone"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with the lines that stay as text, and n_lines and n_removed."""
    removed = removed_lines(spark, docs.select("doc_id", "text"), min_words, near_words).select(F.col("doc").alias("__d"), F.col("text_hash").alias("__h"), F.col("gone").alias("__gone"))
    own = docs.drop("n_lines", "n_removed").withColumns({"__doc": _order(), "__hash": F.xxhash64("text")})
    joined = own.join(removed, (F.col("__doc") == F.col("__d")) & (F.col("__hash") == F.col("__h")), "left").drop("__doc", "__hash", "__d", "__h")
    raw = F.split("text", "\n")
    gone = F.array_sort("__gone")
    # The stretches between lines that go: linear in the lines.
    first = lambda i: F.coalesce(F.get(gone, i - 1) + 1, F.lit(0))
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("__gone")), lambda i: F.slice(raw, first(i) + 1, F.coalesce(F.get(gone, i), F.size(raw)) - first(i)))), "\n")
    out = joined.withColumns({"n_lines": F.coalesce(F.size(raw), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")})
    return out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).drop("__gone")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
