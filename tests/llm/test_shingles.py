"""The pipeline's near-dedup stage against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import shingles


def brute_set(t, n=shingles.WORDS):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute_kept(rows, least=shingles.LEAST):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [r for i, r in enumerate(rows) if r[0] is None or r[0] == low[find(i)]]


def near_copies(n=60, seed=4):
    """Texts with near copies between 0.5 and 1, most of them too far apart for two bits of a fingerprint."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 400))]
        out.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            c = list(w)
            for _ in range(rng.randrange(1, 2 + len(w) // 50)):
                c[rng.randrange(len(c))] = "changed"
            out.append(" ".join(c))
    return list(enumerate(out))


def kept(df):
    return sorted((r.doc_id is None, r.doc_id, r.text or "") for r in df.collect())


def test_stage_keeps_one_of_near_copies(spark):
    rows = near_copies()
    want = brute_kept(rows)
    assert len(want) < len(rows) - 40
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert kept(got) == sorted((False, i, t) for i, t in want)


def test_stage_on_odd_rows(spark, docs, rows):
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert kept(got) == sorted((i is None, i, t or "") for i, t in brute_kept(rows))


def test_stage_on_a_crowd(spark):
    """One large group around a text, and texts that share a passage but little else."""
    rng = random.Random(9)
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        c = list(w)
        for _ in range(rng.randrange(3)):
            c[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(c)))
    rows += [(i, " ".join(w[:60] + [f"y{rng.randrange(10**6)}" for _ in range(20)])) for i in range(300, 360)]
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert kept(got) == sorted((False, i, t) for i, t in brute_kept(rows))


@pytest.mark.parametrize("cell", [1 << 11, 32])
def test_wide_crowd(spark, monkeypatch, cell):
    """Copies so far apart that a leader is near few of them: cells find the other links, in buckets split by size as well."""
    monkeypatch.setattr(shingles, "CELL", cell)
    monkeypatch.setattr(shingles, "LED", cell)
    rng = random.Random(11)
    made = [[f"w{i}" for i in range(150)]]
    for i in range(1, 260):
        c = list(made[0] if i < 200 else made[rng.randrange(i)])
        for _ in range(rng.randrange(2, 8) if i < 200 else 2):
            c[rng.randrange(150)] = f"x{i}"
        made.append(c)
    rows = [(i, " ".join(c)) for i, c in enumerate(made)]
    want = brute_kept(rows)
    assert 20 < len(want) < 250
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert kept(got) == sorted((False, i, t) for i, t in want)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_links_join_all_similar_sets(least):
    """Sets of all sizes around one, against all pairs; sets that are not the class's own are not compared with each other."""
    rng = random.Random(3)
    base = list(range(60))
    sets = [np.array(sorted(set(rng.sample(base, rng.randrange(1, 60))) | {rng.randrange(100, 130) for _ in range(rng.randrange(4))})) for _ in range(120)]
    sets += sets[:10] + [np.array([k]) for k in (1, 1, 2)]
    own = np.array([rng.random() < 0.7 for _ in sets])
    half = len(sets) // 2
    for first, second in ((range(len(sets)), range(len(sets))), (range(half), range(half, len(sets)))):
        part = np.arange(len(sets))
        links = shingles.links_between(sets, part, own, np.array(first), np.array(second), least)
        want = list(range(len(sets)))
        for i in first:
            for j in second:
                common = len(np.intersect1d(sets[i], sets[j]))
                if i != j and (own[i] or own[j]) and common >= least * (len(sets[i]) + len(sets[j]) - common):
                    want = [want[i] if x == want[j] else x for x in want]
        assert len({*zip(want, part.tolist())}) == len(set(want)) == len(set(part.tolist()))
        assert len(links) == len(sets) - len(set(want))


def test_very_long_texts(spark):
    rng = random.Random(5)
    w = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:70_000] + ["x"] + w[70_000:])), (3, " ".join(w[:100_000])), (4, "u" * 2_000_000)]
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == [1, 3, 4]


def test_empty_table(none):
    assert shingles.representatives(none).count() == 0
