"""Each operator against brute force, on small tables with the hard cases: nulls, empty texts, ties, repeated rows, clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from brindle.llm import decontaminate, html_text, line_dedup, packing, pii, quality, sharding, simhash, substring, transport_stream

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 9, n), strict=True))


def texts() -> list[tuple]:
    base = sentence(1, 60)
    edited = base.split()
    edited[30] = "other"
    lines = "\n".join(sentence(k, 12) for k in range(5))
    return [
        (1, base), (2, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (None, base), (6, "   \n\t"), (7, sentence(2, 40) + " " + base[:250]),
        (8, lines), (9, lines.replace("alpha", "ALPHA")), (10, "one\n" + sentence(3, 12) + "\ntwo"), (11, "x " * 5000), (12, "mail a@b.cc or 4111 1111 1111 1111 and 10.0.0.256 or 10.0.0.1 +49 (30) 123456"),
        (13, "é" * 300), (14, base.upper()), (15, "\x1c odd\x1fspace <|endoftext|> é"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}", len(t or ""), 7) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone int").repartition(3).checkpoint()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def test_sharding(spark, docs, empty):
    rows = sharding.hypergeometric_shuffle(spark, docs, 4, cell_rows=2).collect()
    assert len(rows) == len(texts())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [4, 4, 4, 5]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in rows), key=key) == sorted(texts(), key=key)
    assert sharding.hypergeometric_shuffle(spark, empty, 4).count() == 0


def test_hypergeometric_law():
    import random

    rng = random.Random(3)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.1 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.25
    m = sharding.communication_matrix([5, 0, 12, 7], [8, 8, 8], rng)
    assert [sum(r) for r in m] == [5, 0, 12, 7] and [sum(c) for c in zip(*m, strict=True)] == [8, 8, 8]


def brute_spans(text: str) -> list[tuple[int, int, int]]:
    def luhn(s):
        d = [int(c) for c in reversed(s)]
        return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0

    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) < 256 for x in m[0].split("."))) or (k == 2 and 16 <= len(digits) <= 19 and luhn(digits)) or (k == 3 and 8 <= len(digits) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_pii_spans(spark, docs, empty):
    hard = ["x@y.zz_a@b.cc", "1.2.3.4.5.6.7.8", "a@b a@b.c. 4111-1111 11111111 é+49 30 123456", "+1 (743) 555-3824 1.2.3.0004", "@a.b", "9" * 3000, ("1." * 3000) + "@", "1.1.1.1 " * 300]
    df = docs.select("doc_id", "text", "gone").unionByName(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(hard)], "doc_id long, text string, gone int"))
    for r in pii.sanitise(spark, df).collect():
        assert [(b.kind, b.start, b.end) for b in r.base] == brute_spans(r.text or "")
        assert r.gone is not None
    assert pii.sanitise(spark, empty).count() == 0


def test_pii_terms(spark):
    rows = [(i, f"call project zephyrine at secret@host.org now {sentence(i, 5)}") for i in range(6)] + [(100 + i, f"call project now {sentence(i, 9)}") for i in range(60)]
    out = {r.doc_id: r for r in pii.sanitise(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[0].text[t.start : t.end] for t in out[0].terms] == ["zephyrine"]
    assert "secret@" not in out[0].sanitised and "zephyrine" not in out[0].sanitised and "[EMAIL]" in out[0].sanitised and "project" in out[0].sanitised
    assert out[100].terms == [] and out[100].sanitised == out[100].text


def test_packing(spark, docs, empty):
    rows = packing.pack(spark, docs, packing.tokenizer_file(), with_ids=True).collect()
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    want = sorted(tuple(t.encode(x or "", add_special_tokens=False).ids) + (2,) for _, x in texts())
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        whole[(r.doc_id, r.doc_tokens)].append((r.start, r.ids))
    once = [tuple(i for _, ids in sorted(v) for i in ids) for (d, _), v in whole.items() if d not in (2,)]
    assert all(o in want for o in once)
    assert sum(r.length for r in rows) == sum(map(len, want))
    assert packing.pack(spark, empty, packing.tokenizer_file()).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}, {"c": 5, "a": 1}])
def test_mixture(weights):
    totals = {"a": 1000, "b": 770, "c": 31, "d": 0}
    mix = packing.Mixture(totals, 64, weights)
    places = sorted((p, n) for q, n_all in totals.items() for start in range(0, n_all, 7) for p, _, n in mix.places(q, start, min(7, n_all - start)))
    at = 0
    for p, n in places:
        assert p == at
        at += n
    assert at == mix.tokens == 1801
    first = {q: sum(n for start in range(0, t, 7) for p, _, n in mix.places(q, start, min(7, t - start)) if p + n <= 64) for q, t in totals.items()}
    if weights == {"a": 3, "b": 1}:
        assert abs(first["a"] - 48) <= 7 and abs(first["b"] - 16) <= 7


def brute_fingerprint(text: str, words: int) -> int:
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: list[int], ids: list, radius: int) -> list:
    label, links = list(range(len(fps))), [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if i < j and (a ^ b).bit_count() <= radius]
    before = None
    while label != before:
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    best = defaultdict(list)
    for i, k in enumerate(label):
        best[k].append(ids[i])
    return [min((x for x in best[k] if x is not None), default=None) for k in label]


def test_simhash(spark, docs):
    out = simhash.near_duplicates(spark, docs, 4, 4).collect()
    want = [brute_fingerprint(t, 4) for _, t in texts()]
    comps = brute_components(want, [i for i, _ in texts()], 4)
    assert sorted(map(str, ((r.doc_id, r.fp % 2**64, r.component_id) for r in out))) == sorted(map(str, zip([i for i, _ in texts()], want, comps, strict=True)))


def test_linking_dense_groups(spark):
    """Balls of fingerprints in few buckets: components as by brute force."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-(2**62), 2**62, 6)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False)) for c in centres for _ in range(60)} | {int(x) for x in rng.integers(-(2**62), 2**62, 200)}
    fps = sorted(fps)
    out = {r.node: r.component for r in simhash.link(spark, spark.createDataFrame([(f,) for f in fps], "fp long"), 4).collect()}
    unsigned = [f % 2**64 for f in fps]
    want = brute_components(unsigned, fps, 4)
    assert [out.get(f, f) for f in fps] == want


def test_thresholds():
    costs = [[0, 5, 9, 20], [0, 1, 2, 50], [0, 2, 30, 90]]
    best = simhash.allocate(costs, 1)
    assert sum(best) == 1 and sum(c[t + 1] for c, t in zip(costs, best, strict=True)) == min(
        a + b + c for i, a in enumerate(costs[0]) for j, b in enumerate(costs[1]) for k, c in enumerate(costs[2]) if i + j + k == 4
    )


def test_quality(spark, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model, _ = quality.learnt(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    out = quality.with_score(docs.withColumn("quality_score", docs.gone), model).collect()
    assert len(out) == len(texts()) and all(0 <= r.quality_score <= 1 for r in out)
    assert quality.with_score(empty, model).count() == 0
    constant, _ = quality.learnt(spark, empty, labels)
    assert constant.constant == 0.5
    held = {r.doc_id: r for r in quality.op5_quality(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    own = [(held[d].predicted, q) for d, q in truth.items() if held[d].held_out]
    assert all(held[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in held)
    assert np.mean([a == b for a, b in own]) > 0.95


def test_substring(spark, docs, empty):
    for window in (5, 13):
        rows = texts()
        first = {}
        tokens = [(i, (t or "").encode().split()) for i, t in rows]
        for i, w in tokens:
            for k in range(len(w) - window + 1):
                s = b" ".join(w[k : k + window])
                if i is not None:
                    first[s] = min(i, first.get(s, 1 << 60))
        want = []
        for i, w in tokens:
            gone = [False] * len(w)
            for k in range(len(w) - window + 1):
                if i is not None and first[b" ".join(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
            want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
        out = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeated(spark, docs, window).collect()]
        assert sorted(map(str, out)) == sorted(map(str, want))
    assert substring.remove_repeated(spark, empty).count() == 0


def test_transport_stream(spark, docs, empty):
    rng = np.random.default_rng(1)
    for n in [0, 1, 148, 161, 162, 163, 191, 192, 15617, 15618, 15619, 15779, 15780, 15781, 40000]:
        payload = rng.bytes(n)
        s = transport_stream.demux(transport_stream.mux(payload))
        assert b"".join(u[4] for u in s.units) == payload
        assert (s.damaged, s.gaps, s.repeated, s.bad_tables) == (0, 0, 0, 0)
    whole = transport_stream.mux(rng.bytes(5000))
    cut = whole[: 188 * 5] + whole[188 * 6 :]
    again = whole[: 188 * 6] + whole[188 * 5 :]
    assert transport_stream.demux(cut).gaps == 1
    assert transport_stream.demux(again).repeated == 1 and transport_stream.demux(again).units == transport_stream.demux(whole).units
    assert transport_stream.demux(b"junk" * 100).damaged and transport_stream.demux(whole[:20] + b"\x00" + whole[21:]).bad_tables == 1
    rows = transport_stream.parse(transport_stream.store(docs)).collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted(transport_stream.payload_of(t) for _, t in texts())
    assert transport_stream.store(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies, please accept them.</div>
<div class="content"><h2>Title of it</h2><p>First <b>bold</b>word, with an&nbsp;entity &amp; more text here.<br>Next line.<p>Short.<ul><li>One item, in a list.</li></ul>
<form><input><label>Your mail</label></form></div><aside>Related things, to read.</aside><div id="comments"><p>A reader says, that it is good. Very good.</p></div><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Title of it First boldword, with an entity & more text here. Next line. Short. One item, in a list."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("<nav><a>x</a><article><p>Some text, here.</p><p>B</article>") == "Some text, here. B"
    assert html_text.main_text("plain text, only.") == "plain text, only."
    pages = spark.createDataFrame([(1, None, PAGE), (1, "u", PAGE), (None, "u", None)], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 3 and html_text.extract(pages.where("page_id = 9")).count() == 0


def within_one(a, b) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) == len(a) + 1 and a[k:] == b[k + 1 :]


def test_line_dedup(spark, docs, empty):
    base = [sentence(k, n).split() for k, n in ((50, 10), (51, 11), (52, 30))]
    variants = [w[:i] + w[i + 1 :] for w in base for i in (0, 4, 9)] + [w[:i] + ["new"] + w[i:] for w in base for i in (0, 5, len(w))] + [w[:i] + ["sub"] + w[i + 1 :] for w in base for i in (0, 5, 9)] + [base[2][:3] + base[2][4:20] + base[2][21:]]
    extra = [(200 + i, "\n".join([" ".join(w), "short line", " ".join(w)])) for i, w in enumerate(base + variants)]
    rows = texts() + extra
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_lines int, gone int")
    top = 1 << 62
    lines = {(i, t): [tuple(x.split()) for x in (t or "").split("\n")] for i, t in rows}
    first = {}
    for (i, _), ls in lines.items():
        for x in ls:
            if x:
                first[x] = min(top if i is None else i, first.get(x, top))
    want = []
    for i, t in rows:
        kept, seen = [], set()
        for raw, x in zip((t or "").split("\n"), lines[(i, t)], strict=True):
            d = top if i is None else i
            near = any(m < d and len(x) >= 10 and len(y) >= 10 and within_one(x, y) for y, m in first.items() if abs(len(x) - len(y)) <= 1)
            if not (x and (first[x] < d or x in seen or near)):
                kept.append(raw)
            seen.add(x)
        want.append((i, None if t is None else "\n".join(kept)))
    out = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark, df).collect()]
    assert sorted(map(str, out)) == sorted(map(str, want))
    assert line_dedup.dedup_lines(spark, empty).count() == 0


def test_decontaminate(spark, docs, empty):
    rng = np.random.default_rng(2)
    items = [(i, sentence(300 + i, 30)) for i in range(5)] + [(9, None), (10, ""), (11, "qzj")]
    rows = []
    for i in range(5):
        chars = list(items[i][1])
        for _ in range(int(0.04 * len(chars))):
            chars[rng.integers(len(chars))] = "q"
        rows += [(1000 + i, sentence(i, 20) + "\n" + items[i][1].upper() + " end"), (1010 + i, sentence(i, 500) + " " + "".join(chars) + " x")]
    rows += [(1020, "clean " + sentence(77, 400)), (1021, "here qzj is"), (1022, items[0][1][:40]), (1023, "x " + items[0][1][10:110])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark, df, bench).collect()}
    assert set(got) == {(1000 + i, i) for i in range(5)} | {(1010 + i, i) for i in range(5)} | {(1021, 11), (1023, 0)}
    assert all(got[(1000 + i, i)].edits == 0 and got[(1010 + i, i)].edits > 0 for i in range(5))
    assert decontaminate.contaminated(spark, empty, bench).count() == 0 == decontaminate.contaminated(spark, df, bench.where("item_id < 0")).count()


def test_alignment():
    def brute(p, t):
        row = [0] * (len(t) + 1)
        for j, c in enumerate(p, 1):
            new = [j]
            for i, d in enumerate(t, 1):
                new.append(min(row[i - 1] + (c != d), row[i] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = np.random.default_rng(4)
    for _ in range(30):
        p = "".join(rng.choice(list("abc"), 24))
        t = "".join(rng.choice(list("abc"), 30)) + p[:10] + "z" + p[11:] + "".join(rng.choice(list("abc"), 9))
        hit = decontaminate.align(p, t, 28, 32, 4)
        assert hit and hit[0] == brute(p, t)


def test_digest_columns(spark):
    """The thin queries give the contracts' columns."""
    shards = sharding.op1_sharding(spark, SF).toPandas()
    documents = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(shards.shard.unique()) == list(range(40)) and (shards.law == "rows").all()
    for r in shards.head(20).itertuples():
        raw = documents.loc[r.doc_id].text.encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    media = transport_stream.op7_transport_stream(spark, SF).toPandas()
    for r in media.head(20).itertuples():
        payload = transport_stream.payload_of(documents.loc[r.doc_id].text)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:]) and r.payload_bytes == len(payload)
        assert r.media_sha256 == hashlib.sha256(transport_stream.mux(payload)).hexdigest()


def test_simhash_of_tiny_tables(spark, empty):
    assert simhash.near_duplicates(spark, empty.select("doc_id", "text"), 4, 4).count() == 0
    one = simhash.near_duplicates(spark, spark.createDataFrame([(7, "a b c d e"), (3, "a b c d e")], "doc_id long, text string"), 4, 4).collect()
    assert [r.component_id for r in one] == [3, 3]


def test_pii_single_entities(spark):
    """Entities that stand once each are judged by their kind and group."""
    rows = [(i, f"reachable zephyrine under user{i}@mail{i % 2}.org now {sentence(i, 5)}") for i in range(12)] + [(100 + i, f"reachable now {sentence(i, 9)}") for i in range(60)]
    out = {r.doc_id: r for r in pii.sanitise(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("zephyrine" in {out[i].text[t.start : t.end] for t in out[i].terms} for i in range(12))
    assert all("reachable" not in {r.text[t.start : t.end] for t in r.terms} for r in out.values())


def test_pii_terms_anywhere(spark):
    """A term that discloses stands far from the entity, before and after it."""
    far = " ".join(["plain filler words"] * 40)
    rows = [(k, f"zephyrine {far} secret@mail.example {far} quorvane") for k in range(6)] + [(100 + k, f"{far} and so on") for k in range(60)]
    out = {r.doc_id: r for r in pii.sanitise(spark, spark.createDataFrame(rows[:1] + [(k, f"{t} {k % 3}") for k, t in rows[1:]], "doc_id long, text string")).collect()}
    assert all([out[k].text[t.start : t.end] for t in out[k].terms] == ["zephyrine", "quorvane"] for k in range(6))
    assert all(out[k].terms == [] for k in range(100, 160))
