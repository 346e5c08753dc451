"""Mixtures of many sources, and of weights whose queues run dry."""

from collections import defaultdict

import pytest

from brindle.llm import packing


def windows(mix, totals, window):
    """{window: {queue: tokens}}, after a check that the stream has no gap or overlap."""
    stretches = sorted((p, n, q) for q, t in totals.items() for s in range(0, t, 7) for p, _, n in mix.places(q, s, min(7, t - s)))
    at, out = 0, defaultdict(lambda: defaultdict(int))
    for p, n, q in stretches:
        assert p == at
        at += n
        for x in range(p, p + n):
            out[x // window][q] += 1
    assert at == mix.tokens == sum(totals.values())
    return out


def test_weights_go_on_when_a_queue_is_dry():
    totals = {"a": 2000, "b": 130, "c": 1000, "u": 500, "v": 300}
    out = windows(packing.Mixture(totals, 100, {"a": 3, "b": 1, "c": 1}), totals, 100)
    dry = max(k for k, w in out.items() if w["b"])
    assert all(abs(out[k]["b"] - 20) <= 1 for k in range(dry))
    both = [w for k, w in out.items() if k > dry and w["c"] and w["a"] and not w["u"] + w["v"]]
    assert sum(abs(w["a"] - 75) <= 1 and abs(w["c"] - 25) <= 1 for w in both) >= 15
    weighted = [k for k, w in out.items() if w["a"] + w["b"] + w["c"]]
    assert max(weighted) <= min(k for k, w in out.items() if w["u"] + w["v"])


@pytest.mark.parametrize("weights", [{"s3": 5, "s1400": 3}, None])
def test_more_sources_than_a_driver_should_keep(spark, weights):
    rows = [(i, f"alpha beta gamma {i}", f"s{i % 1500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    window, packing.WINDOW_SEQUENCES, sequence, packing.SEQUENCE = packing.WINDOW_SEQUENCES, 1, packing.SEQUENCE, 4096
    try:
        out = packing.pack(spark, docs, packing.tokenizer_file(), weights).collect()
    finally:
        packing.WINDOW_SEQUENCES, packing.SEQUENCE = window, sequence
    places = sorted((r.sequence_id * 4096 + r.offset, r.length, r.doc_id) for r in out)
    at = 0
    for p, n, _ in places:
        assert p == at
        at += n
    tokens = {r.doc_id: r.doc_tokens for r in out}
    assert at == sum(tokens.values())
    if weights:
        ends = [max(p for p, _, d in places if d % 1500 == s) for s in (3, 1400)]
        assert max(ends) < sum(tokens[d] for d in (3, 1503, 1400, 2900))
    else:  # each source's share of the first window, to a token
        first = defaultdict(int)
        for p, n, d in places:
            first[d % 1500] += max(0, min(n, 4096 - p))
        total = sum(tokens.values())
        assert all(abs(first[s] - 4096 * (tokens[s] + tokens[s + 1500]) / total) < 1.01 for s in range(1500))
