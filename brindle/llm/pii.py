r"""Information-theoretic sanitisation of personal data. DataFrame operations only.

Protected entities are e-mail addresses, IP addresses, card numbers and phone numbers, found by
fixed patterns. How far a term of the same text discloses it is estimated from the whole corpus, with document
frequencies over all rows, on three levels: the entity itself, its group (an e-mail's domain, a network, a card's
issuer, a phone's prefix) and its kind, as an entity that stands in one text only says nothing by itself. On a
level, the pointwise mutual information ``log2(n_et * N / (n_e * n_t))`` of entity and term, as a share of the
entity's information ``log2(N / n_e)``, is shrunk by ``texts / (texts + SHRINK)``, texts being the
different texts that show both. The share is near 1 if the term hardly stands without the entity and there is much
evidence; the greatest of the levels counts. Terms over GENERALISE are replaced by their class, over REMOVE
they are removed; both only in documents with the entity, wherever they stand in them. Entities
themselves are replaced by their kind.

Patterns take possessive quantifiers and anchors to the previous match or a boundary; they match what the
plain patterns match, in linear time and without recursion.

Rows: a null text is empty and has no spans; null and repeated doc_ids are carried along; equal
texts get equal spans, and are searched once when counting texts; an empty table gives no rows;
further columns of the input are kept. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import read_table, written

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns of the base kinds.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = len(KINDS) - 1
#: Letters of a term, at least.
TERM_LETTERS = 4
#: Shares shrink by half for so many different texts.
SHRINK = 0.5
GENERALISE, REMOVE = 0.75, 0.9
#: Terms to count are broadcast up to so many (under 10 MB), and joined beyond.
BROADCAST_TERMS = 200_000
KEY = ["k1", "k2"]
LETTERS = "\\p{L}+"


def _keys(text: str = "text") -> list[Column]:
    """A text's name: 128 bits of hashes."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), F.reverse(text)).alias("k2")]


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    ip = match.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, n.between(16, 19) & F.call_function("luhn_check", digits)).otherwise(n.between(8, 15))


def base_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, copies, kind, value, start, end) of the entities of each different text."""
    rows = docs.where(F.col("text").rlike("[@0-9]")).select(*_keys(), "text")
    kinds = [F.struct(F.lit(i).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("m"), F.split("text", p, -1).alias("g")) for i, p in enumerate(PATTERNS)]
    found = rows.select(*KEY, F.explode(F.array(*kinds)).alias("f")).where(F.size("f.m") > 0).select(*KEY, "f.*")
    pieces = F.transform("m", lambda x, i: F.struct(x.alias("match"), F.char_length(F.get("g", i)).alias("gap")))
    each = found.select(*KEY, "kind", F.posexplode(pieces).alias("k", "p")).groupBy(*KEY, "kind", "k", "p").agg(F.count("*").alias("copies"))
    so_far = Window.partitionBy(*KEY, "kind").orderBy("k")
    end = F.sum(F.col("p.gap") + F.char_length("p.match")).over(so_far)
    placed = each.select(*KEY, "copies", "kind", end.alias("end"), "p.*")
    value = F.when(F.col("kind") == 0, F.lower("match")).otherwise(F.regexp_replace("match", "[\\x20()-]", ""))
    return placed.where(_valid(F.col("kind"), F.col("match"))).select(*KEY, "copies", "kind", value.alias("value"), (F.col("end") - F.char_length("match")).alias("start"), "end")


def contexts(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(k1, k2, term, start, end): all terms of each different text that has an entity."""
    texts = docs.where(F.col("text").rlike("[@0-9]")).select(*_keys(), "text").join(entities.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)
    words = texts.select(*KEY, F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)).alias("m"), F.split("text", LETTERS, -1).alias("g"))
    each = words.select(*KEY, F.posexplode(F.transform("m", lambda w, i: F.struct(w.alias("word"), F.char_length(F.get("g", i)).alias("gap")))).alias("k", "p"))
    end = F.sum(F.col("p.gap") + F.char_length("p.word")).over(Window.partitionBy(*KEY).orderBy("k"))
    placed = each.select(*KEY, "p.word", end.alias("end")).where(F.char_length("word") >= TERM_LETTERS)
    return placed.select(*KEY, F.lower("word").alias("term"), (F.col("end") - F.char_length("word")).alias("start"), "end")


def levels(kind: Column, value: Column) -> Column:
    """An entity's names: itself, its group and its kind, which has none."""
    group = F.when(kind == 0, F.substring_index(value, "@", -1)).when(kind == 1, F.substring_index(value, ".", 2)).when(kind == 2, F.left(value, F.lit(6))).otherwise(F.left(value, F.lit(5)))
    return F.array(*(F.struct(F.lit(k).alias("level"), name.alias("name")) for k, name in enumerate((value, group, F.lit("")))))


LEVEL = ["kind", "level", "name"]


def _on_levels(df: DataFrame) -> DataFrame:
    told = df.withColumn("l", F.explode(levels(F.col("kind"), F.col("value")))).drop("value")
    return told.select("*", "l.level", "l.name").drop("l")


def _named(entities: DataFrame) -> DataFrame:
    """(kind, level, name, k1, k2, copies): what each text's entities are called, once."""
    return _on_levels(entities).groupBy(*LEVEL, *KEY).agg(F.max("copies").alias("copies"))


def disclosure(spark: SparkSession, docs: DataFrame, entities: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, level, name, term, share): how far each term discloses each entity, group or kind, if over GENERALISE."""
    named, terms_of = _named(entities), words.select(*KEY, "term").distinct()
    # Fewer texts than so are too little evidence for any term, so names that stand in fewer aren't paired.
    alone = named.groupBy(*LEVEL).agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).where(_shrunk(F.lit(1.0)) >= GENERALISE).drop("texts")
    together = named.join(alone, LEVEL, "left_semi").join(terms_of, KEY).groupBy(*LEVEL, "term").agg(F.sum("copies").alias("n_et"), F.count("*").alias("texts")).where(_shrunk(F.lit(1.0)) >= GENERALISE)
    seen = terms_of.join(entities.groupBy(*KEY).agg(F.max("copies").alias("copies")), KEY).groupBy("term").agg(F.sum("copies").alias("n_t"))
    total = docs.select(F.count("text").alias("n"))
    # A term stands in as many documents at least as beside some entity: this bounds its share from above.
    known = together.join(alone, LEVEL).join(F.broadcast(total))  # one row
    possible = written(spark, known.join(seen, "term").where(_share() >= GENERALISE).drop("n_t"), "possible-terms")
    terms = possible.select("term").distinct()
    few = terms.count() <= BROADCAST_TERMS
    everywhere = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))).alias("term")).where(F.char_length("term") >= TERM_LETTERS)
    counts = everywhere.join(F.broadcast(terms) if few else terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    return possible.join(counts, "term").withColumn("share", _share()).where(F.col("share") >= GENERALISE).select(*LEVEL, "term", "share")


def _shrunk(share: Column) -> Column:
    return share * F.col("texts") / (F.col("texts") + F.lit(SHRINK))


def _share() -> Column:
    return _shrunk(F.log2(F.col("n_et") * F.col("n") / (F.col("n_e") * F.col("n_t"))) / F.nullif(F.log2(F.col("n") / F.col("n_e")), F.lit(0.0)))


def spans_of_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(k1, k2, base, terms): the sorted spans of each different text that has an entity."""
    entities = written(spark, base_spans(docs), "entities")
    words = written(spark, contexts(docs, entities), "contexts")
    strong = written(spark, disclosure(spark, docs, entities, words), "strong-terms")
    base = entities.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("base"))
    likely = words.join(strong.select("term").distinct(), "term", "left_semi")
    told = likely.join(_named(entities), KEY).join(strong, [*LEVEL, "term"]).groupBy(*KEY, "start", "end").agg(F.max("share").alias("share"))
    terms = told.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    both = base.join(terms, KEY, "left")
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return both.select(*KEY, "base", F.coalesce(apart, F.array().cast("array<struct<start:bigint,end:bigint,share:double>>")).alias("terms"))


def sanitise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with base and terms (spans) and sanitised: the text with what the spans hold replaced."""
    shape = docs.drop("base", "terms", "sanitised")
    keyed = shape.withColumns({"__k1": _keys()[0], "__k2": _keys()[1]})
    spans = spans_of_texts(spark, docs.select("text")).withColumnsRenamed({"k1": "__s1", "k2": "__s2"})
    joined = keyed.join(spans, (F.col("__k1") == F.col("__s1")) & (F.col("__k2") == F.col("__s2")), "left").drop("__k1", "__k2", "__s1", "__s2")
    empty = {"base": "array<struct<kind:int,start:bigint,end:bigint>>", "terms": "array<struct<start:bigint,end:bigint,share:double>>"}
    filled = joined.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in empty.items()})
    return filled.withColumn("sanitised", F.when(F.size("base") == 0, F.col("text")).otherwise(_replaced(F.col("text"))))


def _replaced(text: Column) -> Column:
    """Spans that begin within an earlier one are left to it."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.get(names, b["kind"]).alias("by")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["share"] >= REMOVE, "").otherwise(f"[{KINDS[TERM].upper()}]").alias("by")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), x["by"])).alias("out")))
    return F.aggregate(F.array_sort(F.concat(base, terms)), start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text))))


def _of_kind(k: int):
    return lambda span: span["kind"] == k


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitise(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.array(*map(F.lit, KINDS))
    listed = F.transform("base", lambda b: F.concat_ws(":", F.get(name, b["kind"]), b["start"], b["end"]))
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit(KINDS[TERM]), t["start"], t["end"]))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(TERM)]
    return rows.select("doc_id", *counts, F.sha2(F.array_join(listed, ","), 256).alias("base_sha256"), F.array_join(F.concat(listed, terms), ",").alias("spans"))
