"""Operators on documents against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
import xxhash

from pyspark.sql import functions as F

from tessera.llm import exact, language, mixing, pieces, pii, secrets, simhash, substring

sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
key = lambda r: tuple((x is None, x) for x in r)


def same(got, want):
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b


@pytest.mark.parametrize("op", [secrets.op1, simhash.op2, exact.op3, substring.op4, pii.op5, pieces.op6, language.op8, mixing.op9])
def test_empty_table(op, none):
    assert op(none).count() == 0


def base_secrets(t):
    out = []
    for m in re.finditer(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or ""):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    for k, pattern, n in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, t or "") if m.end() - m.start() >= n]
    return sorted(out)


def linked_secrets(t, scope=secrets.SCOPE):
    t = t or ""
    weak = [(m.start(), 3 + next(i for i in range(3) if m[i + 1]), m.end()) for m in re.finditer(secrets.WEAK.replace("(?i)", "(?ia)"), t)]
    for m in re.finditer(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if 6 <= len(m[1]) <= 11:
            weak.append((m.start(), 4, m.end()))
    cls = lambda k: "I" if k in (1, 3) else "E" if k == 5 else "S"
    parts = [(a, cls(k)) for a, k, _ in base_secrets(t) + weak]
    out = set()
    for a, k, b in weak:
        near = {c for x, c in parts if abs(x - a) <= scope}
        c = cls(k)
        if c == "I" and "S" in near or c == "S" and near & {"I", "E"} or c == "E" and {"I", "S"} <= near:
            out.add((a, k, b))
    return out


def test_secrets(docs, rows):
    name = lambda x: ":".join((secrets.KINDS[x[1]], str(x[0]), str(x[2])))
    want = []
    for i, t in rows:
        base, more = base_secrets(t), linked_secrets(t)
        n = Counter(k for _, k, _ in base)
        want.append((i, n[0], n[1], n[2], sha(",".join(map(name, base))), ",".join(map(name, sorted([*base, *more])))))
    same(secrets.op1(docs).collect(), want)
    assert any("weak_secret" in w[5] for w in want) and any(w[1] for w in want)


def test_secrets_in_long_texts(spark):
    text = "token=abcdefghijklmnop " * 3000 + "user: bob " * 600 + "é" * 500 + " user: eve"
    got = secrets.op1(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    name = lambda x: ":".join((secrets.KINDS[x[1]], str(x[0]), str(x[2])))
    base = base_secrets(text)
    assert got.n_assign == 3000 and got.base_sha256 == sha(",".join(map(name, base)))
    assert got.spans.count("identifier") == sum(1 for _, k, _ in linked_secrets(text) if k == 3) > 0


def brute_print(t, n=3):
    w = words(lower(t))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(p) for p in prints]


def test_simhash(docs, rows):
    prints = [brute_print(t) for _, t in rows]
    parts = brute_components(prints)
    low = {}
    for (i, _), p in zip(rows, parts):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    same(simhash.op2(docs).collect(), [(i, f"{f:016x}", low.get(p)) for (i, _), f, p in zip(rows, prints, parts)])


def test_simhash_crowds(spark):
    """Chains and a crowd of prints within a few bits: buckets of more than two are linked exactly."""
    import random

    rng = random.Random(1)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(40):
            prints.add(p)
            p ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                p ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << i) ^ (1 << j) for i in range(0, 20) for j in range(i, 20)}
    prints |= {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.link(spark.createDataFrame([(p,) for p in signed], "fp long"))
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    from tessera.llm._common import connected_components

    comp = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    want = defaultdict(set)
    for p, c in zip(signed, brute_components(prints)):
        want[c].add(p)
    got = defaultdict(set)
    for p in signed:
        got[comp.get(p, p)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(c == min(g) for c, g in got.items())


def test_exact(docs, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        k = max(ids, default=None)
        want.append((i, k, len(groups[lower(t)]), k is None or i == k, sha(lower(t))))
    same(exact.op3(docs).collect(), want)


def test_fuse_filters():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 1000, 40_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        f = exact.build_filter(keys)
        assert exact.may_contain(keys, *f).all()
        assert exact.may_contain(rng.integers(0, 1 << 63, 20_000).astype(np.uint64), *f).mean() < 0.02
        assert n < 1000 or len(f[3]) < 1.5 * n


def test_substring(docs, rows):
    n = substring.LENGTH
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                first[g] = min(first.get(g, i), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        want.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    same(substring.op4(docs).collect(), want)
    assert any(w[2] for w in want)


def test_substring_contexts(spark):
    """A passage under several contexts, and anchors shared where windows are not."""
    import random

    rng = random.Random(2)
    w = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(80):
        t = []
        for _ in range(rng.randrange(1, 8)):
            a = rng.randrange(40)
            t += w[a : a + rng.randrange(5, 20)]
            t += [f"u{rng.randrange(5)}"] * rng.randrange(3)
        docs.append((rng.randrange(70), " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    test_substring(df, docs)


def brute_pii(t):
    t = t or ""
    out = [[(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]]
    out.append([(m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))])

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out.append([(m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))])
    out.append([(m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15])
    return out


def test_pii(docs, rows):
    want = []
    for i, t in rows:
        base = brute_pii(t)
        want.append((i, *map(len, base), sha(",".join(f"{k}:{a}:{b}" for k, s in zip(pii.BASE, base) for a, b in s))))
    got = pii.op5(docs)
    same(got.drop("spans").collect(), want)
    assert all(any(w[1 + k] for w in want) for k in range(4))
    spans = [r.spans for r in got.collect()]
    assert any("iban:" in s for s in spans)


def test_pieces(docs, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    same(pieces.op6(docs).collect(), want)


def test_pieces_columns(docs, rows):
    df = docs.select("doc_id", pieces.encode(docs["text"]).alias("ids"))
    df = df.select("doc_id", F.sha2(F.array_join(df["ids"].cast("array<string>"), ","), 256).alias("i"), F.sha2(pieces.decode(df["ids"]), 256).alias("d"))
    same(df.collect(), [(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in pieces.op6(docs).collect()])


@pytest.mark.parametrize("least", [2, 3, pieces.LONG])
def test_pieces_of_long_units(monkeypatch, least):
    """Unspaced text whose merges have to follow each other, by the heap from various lengths on, as the library encodes it."""
    monkeypatch.setattr(pieces, "LONG", least)
    rng = random.Random(least)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    v = pieces.vocabulary(pieces.default_model())
    words = [p.strip("▁") for p in v.pieces[259:] if p.strip("▁").isalpha()]
    texts = ["the" * 70_000, "the" * 5 + "日" + "then" * 50] + ["".join(rng.choices("theinasr", k=rng.choice((5, 50, 700)))) for _ in range(300)]
    texts += ["".join(rng.choices(words, k=200)) for _ in range(60)] + ["".join(rng.choices(words, k=40)) + " and so on" for _ in range(200)]
    for t, ids in zip(texts, pieces.encode_texts(texts, pieces.default_model())):
        assert list(ids) == sp.encode(t), t[:60]


def test_pieces_on_random_texts():
    import random

    rng = random.Random(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    v = pieces.vocabulary(pieces.default_model())
    letters = "abcdeéè ▁ \n\t0123日本ñß🙂ａ.,the  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    texts += ["".join(rng.choice(v.pieces[259:]) for _ in range(12)).replace("▁", " ") for _ in range(3000)]
    texts += [" " * n + "x" + " " * (n // 3) for n in range(1, 140)] + ["ab" * 2000, "the" * 1500, "=" * 999]
    for t, ids in zip(texts, pieces.encode_texts(texts, pieces.default_model())):
        assert ids.tolist() == sp.encode(t), repr(t)
        assert v.decode(ids) == sp.decode(ids), repr(t)


def test_language(docs):
    got = language.op8(docs.where("doc_id < 100000 OR doc_id IS NULL")).collect()
    lang = {r.doc_id: r.lang for r in docs.where("doc_id < 100000 AND text IS NOT NULL").collect()}
    judged = [r for r in got if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) / len(judged) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    assert any(r.lang_pred == "und" and r.score == 0 for r in got)


def test_language_forward():
    """The forward sum and the expectations against an enumeration of all segmentations."""
    import numpy as np

    model = pieces.default_model()
    p = language.pieces(model)
    rng = np.random.default_rng(0)
    prob = rng.random((p.n, 2))
    todo = ["▁thé", "▁and", "q☃z"]
    arcs = p.arcs(todo)
    alpha = language.forward(arcs, prob)

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            n = p.number.get(s[:k], 0 if k == 1 else None)
            if n is not None:
                for rest in ways(s[k:]):
                    yield (n, *rest)

    for i, s in enumerate(todo):
        assert np.allclose(alpha[i, len(s)], sum(np.prod(prob[list(w)], axis=0) for w in ways(s)))
    got = language.expected(todo, np.ones((3, 2)), prob, model)
    want = np.zeros_like(prob)
    for s in todo:
        all_ways = list(ways(s))
        each = np.array([np.prod(prob[list(w)], axis=0) for w in all_ways])
        for w, x in zip(all_ways, each / each.sum(axis=0)):
            for n in w:
                want[n] += x
    assert np.allclose(got, want)


def brute_targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(size.values()), {s: 0.0 for s in order}, list(order)
    left = float(total)
    while left > 1e-6 and open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 3 * size[s]:
                left += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                open_.remove(s)
    return target


def test_mixing(docs):
    got = mixing.op9(docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    assert sorted((key((r.doc_id, r.source)), r.size) for r in got) == sorted((key((r.doc_id, r.source)), len(words(r.text))) for r in rows)
    size = Counter()
    for r in rows:
        size[r.source] += len(words(r.text))
    target, taken = brute_targets(size), Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-3
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.03 * t + 4 * mixing.BLOCK
    again = sorted(key((r.doc_id, r.size, r.taken)) for r in mixing.op9(docs.repartition(7)).collect())
    assert again == sorted(key((r.doc_id, r.size, r.taken)) for r in got)
