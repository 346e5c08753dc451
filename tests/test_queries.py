"""Every query with SQL gives the rows that DuckDB gives; the others against brute force or plain properties."""

import hashlib
import math
import re
import subprocess
import sys
import unicodedata
import uuid
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.catalog_queries import QUERIES
from brindle.queries import SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_parts_of_a_brand_match_whatever_their_type(spark, duck, tmp_path):
    """All pairs of a brand that score enough: of one type or two, without a type, with negative keys."""
    rows = [(k, n, b, t, s, 1.0) for k, n, b, t, s in [
        (2, "red bolt", "x", "SMALL", 7), (1, "red bolt", "x", "SMALL", 7), (3, "old gear", "x", "PROMO", 7), (9, "old gear", "x", None, 7), (-3, "red bolt", "x", "PROMO", 7),
        (-9, "red bolt", "x", "SMALL", 7), (5, "red bolt", "x", "SMALL", 8), (11, "red bolt", "y", "SMALL", 7), (15, "red bolt", None, "SMALL", 7), (4, "red bolt", None, "SMALL", 7),
    ]]
    spark.createDataFrame(rows, spark.read.parquet(f"{SF}/part.parquet").schema).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in QUERIES["scored_match"](spark, str(tmp_path)).collect())
    assert [r[:3] for r in got] == [("x", 2, k) for k in (-9, -3, 3, 9)]
    assert got == sorted(duck.execute(SQL["scored_match"].replace("FROM part)", f"FROM '{tmp_path}/part.parquet/*.parquet')")).fetchall())


def test_greedy_by_brute_force(spark):
    """Best first; a pair with a free rival within three points is reported and not taken."""
    sf = SF.replace("0.001", "0.01")
    folders = defaultdict(list)
    for r in QUERIES["scored_match"](spark, sf).collect():
        folders[r.folder].append((-r.points / 1000.0, r.v_id, r.s_id))
    want = set()
    for folder, pairs in folders.items():
        taken = set()
        for x, v, s in sorted(pairs):
            if ("v", v) in taken or ("s", s) in taken:
                continue
            rivals = [y for y, w, t in pairs if (w == v) != (t == s) and ("v", w) not in taken and ("s", t) not in taken]
            ambiguous = any(abs(x - y) < 3.0 for y in rivals)
            want.add((folder, v, s, ambiguous))
            if not ambiguous:
                taken |= {("v", v), ("s", s)}
    got = {(r.folder, r.v_id, r.s_id, r.ambiguous) for r in QUERIES["greedy_matching"](spark, sf).collect()}
    assert got == want and {a for *_, a in got} == {True, False}


def test_texts_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    normal = unicodedata.normalize
    assert {r.doc_id: (r.digest, r.folded) for r in QUERIES["nfkc_title"](spark, SF).collect()} == {k: (md5(normal("NFKC", t)), md5(normal("NFC", t).casefold())) for k, t in texts.items()}

    def signed(raw):
        chunk = 64 * 1024
        h = hashlib.blake2b(len(raw).to_bytes(8, "little"), digest_size=16)
        for at in sorted({0, max(0, len(raw) - chunk)}) + ([len(raw) // 2 - chunk // 2] if len(raw) > 2 * chunk else []):
            h.update(at.to_bytes(8, "little") + raw[at : at + chunk])
        return h.hexdigest()

    assert {r.doc_id: r.signature for r in QUERIES["signature"](spark, SF).collect()} == {k: signed(t.encode()) for k, t in texts.items()}
    for r in QUERIES["long_names"](spark, SF).collect():
        name = re.sub(r"\s+", " ", texts[r.doc_id]) + ".mp4"
        assert r.uuid == str(uuid.uuid5(uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), texts[r.doc_id]))
        assert r.name == name if len(name.encode()) <= 240 else len(r.name.encode()) <= 240 and r.name.endswith(hashlib.sha1(name.encode()).hexdigest()[:10] + ".mp4")


def test_grid_by_brute_force(spark):
    """All paths by breadth, in Python."""
    nation = {(r.n_nationkey // 5, r.n_nationkey % 5): str(r.n_regionkey) for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    targets, paths = [["1", "2"], ["2", "3"]], [[(0, c)] for c in range(5)]
    holds = lambda p: all(any([nation[x] for x in p[i : i + 2]] == t for i in range(len(p))) for t in targets)
    while not any(map(holds, paths)):
        side = len(paths[0]) % 2
        paths = [[*p, x] for p in paths for x in sorted(nation) if x not in p and (x[1] == p[-1][1] if side else x[0] == p[-1][0])]
    want = min(p for p in paths if holds(p))
    assert [(r.row, r.col) for r in sorted(QUERIES["grid_path"](spark, SF).collect())] == want


def test_import_without_session():
    """In a new process, where no session exists."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = Path(entry.__file__).resolve().parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120, check=False).returncode == 0
