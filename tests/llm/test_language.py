"""op8 against plain loops over every segmentation, word by word and language by language, in logarithms."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import language
from tessera.llm.pieces import SPACE, default_model


def runs(text):
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def add(x, y):
    x, y = max(x, y), min(x, y)
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def arcs(word, number):
    """(start, end, piece): pieces of the vocabulary, and 0 for a letter that is none."""
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - 40), e):
            p = number.get(word[s:e], 0 if s == e - 1 else None)
            if p is not None:
                yield s, e, p


def forward(n, found, log):
    a = [0.0] + [-math.inf] * n
    for s, e, p in found:
        a[e] = add(a[e], a[s] + log[p])
    return a


def backward(n, found, log):
    b = [-math.inf] * n + [0.0]
    for s, e, p in sorted(found, key=lambda x: -x[0]):
        b[s] = add(b[s], b[e] + log[p])
    return b


def normal(counts):
    whole = sum(c + 0.1 for c in counts)
    return [math.log((c + 0.1) / whole) for c in counts]


def brute(rows):
    number = language.pieces(default_model()).number
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(runs(text))
    lattice = {w: list(arcs(SPACE + w, number)) for _, t, _ in rows for w in runs(t or "")}
    logs = {lang: normal([1.0] * (len(number) + 1)) for lang in counts}
    for _ in range(2):
        for lang, words in counts.items():
            seen = [0.0] * (len(number) + 1)
            for w, c in words.items():
                n, found, log = len(w) + 1, lattice[w], logs[lang]
                a, b = forward(n, found, log), backward(n, found, log)
                for s, e, p in found:
                    seen[p] += c * math.exp(a[s] + log[p] + b[e] - a[n])
            logs[lang] = normal(seen)
    memo = {(w, lang): forward(len(w) + 1, lattice[w], logs[lang])[-1] for w in lattice for lang in logs}
    out = []
    for i, text, _ in rows:
        words = runs(text or "")
        total = {lang: math.fsum(memo[w, lang] for w in words) for lang in sorted(logs)}
        best = max(total, key=total.get) if words else "und"
        score = 1 / math.fsum(math.exp(x - total[best]) for x in total.values()) if words else 0.0
        out.append((i is None, i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, best, score))
    return sorted(out, key=str)


def test_against_plain_loops(docs):
    """The whole smallest table and the odd rows, words of thousands of letters among those that are learned from."""
    docs = docs.select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    assert any(lang and i and zlib.crc32(str(i).encode()) % 4 != 2 and max(map(len, runs(t or "")), default=0) > 999 for i, t, lang in rows)
    want = brute(rows)
    got = sorted(((r.doc_id is None, r.doc_id, r.held_out, r.lang_pred, r.score) for r in language.op8(docs).collect()), key=str)
    by = lambda found: sorted((r[:4] for r in found), key=str)
    assert by(got) == by(want)
    scores = lambda found: sorted((str(r[:4]), round(r[4], 6)) for r in found)
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=2e-6) for a, b in zip(scores(got), scores(want), strict=True))


def test_long_words_are_learned_as_short_ones():
    model, rng = default_model(), np.random.default_rng(2)
    prob = rng.random((language.pieces(model).n, 3))
    prob /= prob.sum(axis=0)
    counts = np.array([1.0, 2.0, 0.5])
    for word in ("the", "desnation" * 4, "日本語x"):
        out = np.zeros_like(prob)
        language.long_expected(SPACE + word, counts, prob, model, out)
        assert np.allclose(out, language.expected([SPACE + word], counts[None], prob, model))
