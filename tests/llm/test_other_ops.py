"""Embeddings, crawl records, components and the pipeline."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessera.llm import lattice, warc
from tessera.llm._common import connected_components


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000 + i * 37 % 101, 2000 + (i + 1) * 37 % 101) for i in range(100)] + [(5000 + i, 9999) for i in range(50)] + [(7, 7)]
    rng.shuffle(edges)
    rows = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    got = {r.node: r.component for r in rows}
    assert len(got) == len(rows)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if find(x) != x}


def test_lattice_points():
    """Both cosets' points are the nearest of brute force."""
    y = np.random.default_rng(0).normal(0, 1.2, (200, 8))
    near, other = lattice.e8_cosets(y)
    for p in (near, other):
        assert ((p % 2 == p[:, :1] % 2).all(axis=1)).all() and (p.sum(axis=1) % 4 == 0).all()
    shifts = np.array([s for s in np.ndindex(*[3] * 8)]) - 1
    for i in range(40):
        best = math.inf
        for half in (0.0, 0.5):
            c = np.floor(y[i] - half) + shifts + half
            c = c[(np.rint(c.sum(axis=1)) % 2 == 0) & (np.abs(c.sum(axis=1) - np.rint(c.sum(axis=1))) < 1e-9)]
            best = min(best, ((c - y[i]) ** 2).sum(axis=1).min())
        assert abs(((near[i] / 2 - y[i]) ** 2).sum() - best) < 1e-9


def brute(vectors):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    links = {i: set() for i in range(len(vectors))}
    for i in range(len(vectors)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = (np.array(v) / np.abs(v).max() for v in (vectors[i], vectors[j]))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                    links[i].add(j)
                    links[j].add(i)
    return links


def test_lattice(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    rows += [(20_000 + i, (base + rng.normal(size=64) * 0.1).tolist()) for i in range(60)]
    rows += [(30_000, None), (30_001, []), (30_002, [0.0] * 64), (30_003, [float("nan")] + [1.0] * 63), (30_004, [None] + [1.0] * 63), (30_005, [1.0, 2.0]), (30_006, [2.0, 4.0]), (None, rows[0][1]), (rows[1][0], rows[1][1]), (30_007, [1e-200] * 64), (30_008, [1.0] * 64), (30_009, [-0.0, 1.0]), (30_010, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cid string")
    links = brute([v for _, v in rows])
    total = sum(map(len, links.values()))
    got = lattice.op7(df).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert 0.9 * total <= found <= total
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for i in range(30_000, 30_005):
        assert (by[i][0].n_links, by[i][0].component_id, by[i][0].kept) == (0, i, True)
    assert by[30_006][0].component_id == 30_005 and by[30_008][0].component_id == 30_007 and by[30_010][0].component_id == 30_009
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert lattice.op7(df.limit(0)).count() == 0


def test_lattice_parts(spark, monkeypatch):
    """Cells cut into parts give the same links."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.05).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()
    whole = sorted(map(tuple, lattice.op7(df).collect()))
    monkeypatch.setattr(lattice, "CELL", 32)
    assert sorted(map(tuple, lattice.op7(df).collect())) == whole
    assert all(r[2] == 0 for r in whole) and sum(r[1] for r in whole) > 0.97 * 150 * 149


def test_canonical_url(spark):
    cases = {
        "http://WWW.Example.com:80/A/?ref=x&b=2#top": "example.com/A/?b=2", "https://m.x.org/": "x.org", "x.org": "x.org", "https://x.org:443": "x.org",
        "https://x.org/p/?utm_source=a": "x.org/p", "http://x.org:8080/a//": "x.org:8080/a", "": "", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    got = {r.url: r.c for r in df.select("url", warc.canonical_url(df["url"]).alias("c")).collect()}
    assert got == cases


def test_revisits(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit", None, "request"])
        rows.append((i, rng.choice([None, "", *[f"http://h{k}.org/a" for k in range(4)], "https://www.h0.org/a/"]), rng.choice([None, *range(60)]), kind, rng.choice([None, "A", "W/A", "B"]), rng.choice([None, "d1", "d2"]), rng.choice([None, {"etag": f"e{i}", "content-length": "0", "x": "y"}])))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>").cache()
    curl = {r.record_id: r.c for r in df.select("record_id", warc.canonical_url(df["url"]).alias("c")).collect()}
    want = []
    for i, _, ts, kind, tag, date, head in rows:
        if kind != "revisit":
            continue
        hits = [r for r in rows if r[3] == "response" and ts is not None and curl[i] is not None and curl[r[0]] == curl[i] and r[2] is not None and r[2] < ts]
        if not hits:
            want.append((i, "unmatched", None))
            continue
        h = max(hits, key=lambda r: (r[2], r[0]))
        strip = lambda x: x and x.removeprefix("W/")
        ok = strip(tag) == strip(h[4]) if tag and h[4] else date == h[5] if date and h[5] else not (tag or date or h[4] or h[5])
        want.append((i, "resolved" if ok else "validator_mismatch", h[0]))
    old = warc.SLICE_RECORDS
    try:
        for n in (7, 100_000):
            warc.SLICE_RECORDS = n
            got = warc.resolve_revisits(df).collect()
            assert sorted(((r.record_id, r.status, r.candidate_id) for r in got), key=lambda x: x[0]) == sorted(want)
    finally:
        warc.SLICE_RECORDS = old
    by = {r[0]: r for r in rows}
    for r in got:
        if r.status == "resolved":
            merged = dict(by[r.response_id][6] or {}) | {k: v for k, v in (by[r.record_id][6] or {}).items() if k in warc.PERMITTED}
            assert r.headers == merged
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as c
    from tessera.llm import exact, mixing
    from tests.llm.test_shingles import brute_kept

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = c.language_id(spark, docs, sf).cache()
    assert known.columns == docs.columns and known.count() >= 0.95 * docs.count()
    unique = c.exact_dedup(spark, known, sf).cache()
    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in exact.op3(known).where("kept").collect()}
    apart = c.simhash_near_dedup(spark, unique, sf).cache()
    assert {r.doc_id for r in apart.collect()} == {i for i, _ in brute_kept([(r.doc_id, r.text) for r in unique.collect()])}
    mixed = c.source_mixing(spark, apart, sf).cache()
    assert mixed.columns == docs.columns
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.op9(apart).collect()}
    for r in mixed.groupBy("doc_id").count().collect():
        t, n = taken[r.doc_id]
        assert abs(r["count"] - t / n) < 1
    out = c.sentencepiece(spark, mixed, sf)
    assert out.count() == mixed.count() and {n for n, _ in c.STAGES} == {"language_id", "exact_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"}
    assert sorted(r.decoded for r in out.collect()) == sorted(r.text for r in mixed.collect())


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op10_warc_revisits"])
def test_oracles(spark, name):
    import duckdb

    from tessera.llm.queries import oracle_sql, queries

    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    df = queries()[name](spark, at)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall()
    k = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.select(*cols).collect()), key=k) == sorted(want, key=k)
