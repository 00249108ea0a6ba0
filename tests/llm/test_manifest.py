"""The Merkle manifest against plain loops and its SQL."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import manifest
from tests.llm.brute_manifest import brute, digest, levels, sha, way

COLS = ("doc_id", "source", "lang", "n_chars", "text")
key = lambda r: tuple(map(str, r))


def test_op12_of_awkward_rows(docs):
    want = brute([tuple(r) for r in docs.select(*COLS).collect()])
    got = [tuple(r) for r in manifest.op12(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("sizes", [(1,), (2, 3, 1), (33, 16, 17, 1), (65, 5)])
def test_small_blocks_exchange(spark, sizes):
    rows = [(i, None, f"l{g}" if g else None, i, "t") for g, n in enumerate(sizes) for i in range(g * 1000, g * 1000 + n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest.manifest(df, block=2).select("doc_id", "leaf", "subroot", "root", F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "").alias("p"), manifest.folded(F.col("leaf"), F.col("proof")).alias("f")).collect()
    want = {r[0]: r for r in brute(rows)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.leaf, r.subroot, r.root, sha(r.p), r.f) == (*want[r.doc_id][1:5], r.root)


@pytest.mark.parametrize("fanout", [3, 5])
def test_wider_fanout(spark, fanout):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    tree = levels([digest(r) for r in rows], fanout)
    for r in manifest.manifest(df, fanout=fanout, block=fanout).collect():
        assert [(s.left, s.right) for s in r.proof] == way(tree, r.doc_id, fanout)
        assert r.subroot == r.root == tree[-1][0]


def test_edges(spark, none):
    assert manifest.op12(none).count() == 0
    with pytest.raises(ValueError):
        manifest.manifest(none, fanout=1)
    long = [(1, "s", "en", 2**62, "x" * 3_000_000), (1, "s", "en", 2**62, "x" * 3_000_000), (1, None, None, None, "")]
    df = spark.createDataFrame(long, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, manifest.op12(df).collect()), key=key) == sorted(brute(long), key=key)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(manifest.OP12_SQL).fetchall()
    got = [tuple(r) for r in manifest.op12(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
