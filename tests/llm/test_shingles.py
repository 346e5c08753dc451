"""Near duplicates by the similarity of shingles: against brute force, and no rows lost to null or shared ids."""

import numpy as np

import corpus_pipeline
from brindle.llm import shingles, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n)]


def brute(a: str, b: str) -> float:
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (a, b))
    return len(one & two) / len(one | two) if one | two else 1.0


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], COLUMNS)


def test_all_pairs_of_the_similarity_link(spark):
    """Copies with words changed at random: fingerprints are often over 4 bits apart, similarity decides."""
    rng, texts = np.random.default_rng(9), []
    for k in range(60):
        base = words(k, int(rng.integers(6, 300)))
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 1 + len(base) // 25))):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    texts += ["", "  ", "one two", "ONE  two", "three"]
    label = list(range(len(texts)))
    links = [(i, j) for j in range(len(texts)) for i in range(j) if brute(texts[i], texts[j]) >= shingles.SIMILARITY]
    far = [(i, j) for i, j in links if ((simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[j], 5)) % 2**64).bit_count() > 4]
    assert len(far) > 20
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    docs = frame(spark, enumerate(texts))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(label))


def test_rows_without_ids_of_their_own_stay(spark):
    a, b, c, d = (" ".join(words(100 + k, 40)) for k in range(4))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, c), (9, a)]
    out = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()
    assert sorted(((r.doc_id or 0), r.text) for r in out) == sorted([(9, a), (0, b), (7, c), (7, d)])


def test_only_contaminated_rows_go(spark):
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 150").first().text
    clean = [" ".join(words(200 + k, 40)) for k in range(3)]
    rows = [(None, item), (None, clean[0]), (5, clean[1]), (5, "see " + item), (6, clean[2]), (None, None)]
    out = corpus_pipeline.decontamination(spark, frame(spark, rows), sf).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(0, clean[0]), (5, clean[1]), (6, clean[2]), (0, "")])


def test_large_mixed_buckets(spark, monkeypatch):
    """Every pair of the similarity is linked when buckets are large and hardly anything links to pivots."""
    import random

    import numpy as np

    monkeypatch.setattr(shingles, "LARGE", 4)
    monkeypatch.setattr(shingles, "EASY", 0)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base, rows = [rng.choice(words) for _ in range(60)], []
    for k in range(120):
        text = list(base)
        for _ in range(rng.choice((1, 2, 3, 4))):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((k, " ".join(text)))
    texts = spark.createDataFrame([(f"{k:03}", t) for k, t in rows], "node string, text string")
    shared = {r.node: r.component for r in shingles.link(spark, texts, 5, 0.8).collect()}
    sets = [np.unique(shingles.shingle_hashes(t, 5)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if shingles.similarity(sets[i], sets[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {f"{k:03}": f"{root(k):03}" for k in range(len(rows))}
    assert {k: shared.get(k, k) for k in want} == want and len(set(want.values())) < len(rows)
