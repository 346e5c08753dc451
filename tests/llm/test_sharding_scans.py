"""Sharding when a second scan of the input would cut other blocks."""

from brindle.llm import sharding


def test_one_scan_decides_the_blocks(spark, monkeypatch):
    option, draw = "spark.sql.files.maxPartitionBytes", sharding.communication_matrix
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    old = spark.conf.get(option)

    def later(*args):
        spark.conf.set(option, str(1 << 18))
        return draw(*args)

    monkeypatch.setattr(sharding, "communication_matrix", later)
    try:
        rows = sharding.hypergeometric_shuffle(spark, docs, 7).select("shard", "slot").collect()
    finally:
        spark.conf.set(option, old)
    n = docs.count()
    assert len(rows) == n
    for k, size in enumerate(sorted(sharding.split_evenly(n, 7))):
        assert size in (n // 7, n // 7 + 1) and sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
