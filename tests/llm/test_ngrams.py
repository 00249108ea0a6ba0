"""The n-gram model against plain loops over words."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ngrams

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BEGIN, END = "<begin>", "<end>"


def words(text):
    return [("w", x) for x in WORD.findall((text or "").translate(UP))] + [END]


def brute(train, texts, order):
    """Rows (n_tokens, n_known, train_tokens, base, score) of the texts; the formulas written out."""
    counts = {order: collections.Counter()}
    raw = collections.Counter()
    for t in train:
        w = [BEGIN] * (order - 1) + words(t)
        raw.update(w[order - 1 :])
        counts[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    d = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        d[k] = (0, *ngrams.TOO_FEW)
        if n[0] and n[1] and n[2]:
            y = n[0] / (n[0] + 2 * n[1])
            full = (0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
            if all(0 <= x <= i for i, x in enumerate(full)):
                d[k] = full
    followers = {k: collections.defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            followers[k][g[:-1]].append(v)
    sums = {k: {c: (sum(v), sum(d[k][min(x, 3)] for x in v)) for c, v in f.items()} for k, f in followers.items()}

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(raw) + 1)
        if g[:-1] not in sums[k]:
            return lower
        (total, rest), c = sums[k][g[:-1]], counts[k][g]
        return (max(c - d[k][min(c, 3)], 0) + rest * lower) / total

    total = sum(raw.values())
    out = []
    for t in texts:
        w = [BEGIN] * (order - 1) + words(t)
        real = w[order - 1 :]
        base = sum(math.log10((raw[x] + 0.5) / (total + 0.5 * (len(raw) + 1))) for x in real)
        out.append((len(real), sum(raw[x] > 0 for x in real), total, base, sum(math.log10(p(tuple(w[i : i + order]))) for i in range(len(real)))))
    return out, p, raw


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a[:-2] == b[:-2]
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[-2:], b[-2:])), (a, b)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_op11_of_awkward_rows(docs, rows):
    want, _, _ = brute([t for i, t in rows if not held(i)], [t for _, t in rows], ngrams.ORDER)
    same([tuple(r) for r in ngrams.op11(docs).collect()], [(i, held(i), *w) for (i, _), w in zip(rows, want)])


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders(spark, order, monkeypatch):
    rng = np.random.default_rng(order)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 40)) if x < 200) for _ in range(300)] + [None, "", "A a", "long " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    test = texts[::7] + ["never seen words at all", "w1 w2 unseen w1"]
    want, p, raw = brute(texts, test, order)
    model = ngrams.train(df, order)
    out = ngrams.score(spark.createDataFrame(list(enumerate(test)), "doc_id long, text string"), model)
    got = [tuple(r) for r in out.collect()]
    same([(r[0], *r[1:3], *r[3:5]) for r in got], [(i, *w[:2], *w[3:]) for i, w in enumerate(want)])
    assert all(math.isclose(r[5], 10 ** (-r[4] / r[1])) for r in got)
    # A distribution: known words, the end and one share for all others.
    for context in ((BEGIN,) * (order - 1), (("w", "w1"),) * (order - 1), (("w", "nowhere"),) * (order - 1)):
        assert math.isclose(sum(p((*context, w)) for w in [*raw, ("w", "nowhere")]), 1)


def test_many_flushes_and_shards(spark, monkeypatch):
    texts = ["the cat sat on the mat"] * 20 + [f"the dog {i} ran" for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    monkeypatch.setattr(ngrams, "FLUSH", 20)
    monkeypatch.setattr(ngrams, "SLICE_BYTES", 64)
    many = [r for rows in ngrams._counted(iter([batch]), 2, 4) for r in rows]
    monkeypatch.undo()
    (one,) = ngrams._counted(iter([batch]), 2, 4)
    assert len(many) > len(one)

    def total(rows):
        out = collections.Counter()
        for _, shard, n, columns in rows:
            a, b, c = map(ngrams._unpack, columns)
            assert len(a) == n and all(int(x) >> 60 == shard for x in b)
            for x, y, z in zip(a, b, c):
                out[int(x), int(y)] += int(z)
        return out

    assert total(many) == total(one)


def test_words_are_told_apart():
    text = pa.array(["Ab aB", "", "  x\ty\x0b ", "日本 é\xa0é", "x" * 100_000, "a" * 9 + " " + "a" * 10])
    h, counts = ngrams.word_hashes(text)
    assert counts.tolist() == [len(WORD.findall(t)) for t in text.to_pylist()]
    flat = [w.translate(UP) for t in text.to_pylist() for w in WORD.findall(t)]
    assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_without_training_documents(spark, none):
    assert ngrams.op11(none).count() == 0
    model = ngrams.train(none)
    (r,) = ngrams.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()
    assert (r.n_tokens, r.n_known, r.base_score, r.score, r.perplexity) == (3, 0, 0.0, 0.0, 1.0)
    with pytest.raises(ValueError):
        ngrams.train(none, 1)


def test_held_out_perplexity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", ngrams.held_out().alias("h"))
    model = ngrams.train(docs.where("NOT h"))
    r = ngrams.score(docs.where("h AND text IS NOT NULL"), model).selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert r.s > r.b and 10 ** (-r.s / r.n) < model.words
