"""Clashing names, very long texts, and the dealt methods' own promises, against brute force."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import exact, language, mixing, pieces, pii, simhash, substring, warc

PRIVATE = ("_id", "_sha", "_own", "_node", "_size", "_times", "_k", "_words", "_found", "_text", "lang_pred", "score", "id", "node")


def test_stages_keep_clashing_columns(spark, docs, sf):
    import corpus_pipeline as c

    given = docs
    for name in PRIVATE:
        given = given.withColumn(name, F.concat(F.lit(name), F.coalesce("text", F.lit(""))))
    at = given
    for name, stage in c.STAGES[:-1]:
        at = stage(spark, at, sf).cache()
        assert at.columns == given.columns, name
        assert at.count() and not at.where(" OR ".join(f"NOT {n} <=> concat('{n}', coalesce(text, ''))" for n in PRIVATE)).count(), name
    out = c.STAGES[-1][1](spark, at, sf)
    assert out.count() == at.count()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert sorted(r.decoded for r in out.collect()) == sorted(sp.decode(sp.encode(r.text or "")) for r in at.collect())


def test_stages_on_an_empty_table(spark, docs, sf):
    import corpus_pipeline as c

    at = docs.limit(0)
    for _, stage in c.STAGES:
        at = stage(spark, at, sf)
        assert at.count() == 0


def test_bytes_decide_where_digests_collide(docs, rows):
    """Without SHA-256 some groups of one length hold different texts; the byte check tells them apart."""
    lower = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in rows]
    groups = collections.defaultdict(list)
    for i, t in lower:
        groups[t].append(i)
    want = []
    for i, t in lower:
        known = [x for x in groups[t] if x is not None]
        keep = max(known) if known else None
        want.append((i, keep, len(groups[t]), keep is None or i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact.exact_duplicates(docs, sha_bytes=0).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    key = lambda r: tuple(map(str, r[:4]))
    assert sorted(map(key, got)) == sorted(map(key, want))
    coarse = collections.defaultdict(set)
    for _, t in lower:
        coarse[len(t.encode())].add(t)
    assert any(len(v) > 1 for v in coarse.values())


def test_snapshot_is_stored(spark, docs, tmp_path):
    rows = exact.digests(docs).cache()
    old, new = rows.where("id < 100"), rows.where("id >= 100 OR id IS NULL")
    made = exact.Snapshot.of(old)
    made.write(str(tmp_path / "s"))
    read = exact.Snapshot.read(spark, str(tmp_path / "s"))
    pick = lambda s: sorted((bytes(r.sha), str(r.keep_id), r.group_size) for r in exact.match(s, new).collect())
    assert pick(made) == pick(read)


def test_permutations(spark):
    n = [*range(1, 130), 1000, 4097]
    df = spark.createDataFrame([(k, x, turn) for k in n for x in range(k) for turn in (0, 1)], "n long, x long, turn long")
    got = df.select("n", "turn", "x", mixing.permuted(F.col("x"), F.col("n"), F.lit(7), F.col("turn")).alias("y")).collect()
    seen = collections.defaultdict(list)
    for r in got:
        seen[r.n, r.turn].append(r.y)
    assert all(sorted(v) == list(range(k)) for (k, _), v in seen.items())
    assert seen[1000, 0] != seen[1000, 1]
    steps = collections.Counter((b - a) % 4097 for a, b in zip(seen[4097, 0], seen[4097, 0][1:]))
    assert max(steps.values()) < 40  # no regular walk


@pytest.fixture(scope="module")
def shares(docs):
    return mixing._placed(docs, "doc_id", "text", "source", mixing.WEIGHTS, mixing.LIMIT)[1].cache()


def test_draws_are_multinomial_and_settle(spark, shares):
    sources = {r.sid: r for r in shares.collect()}
    total = sum(r.quota for r in sources.values())
    uses = collections.defaultdict(collections.Counter)
    for r in mixing.slots(shares).collect():
        uses[r.sid][r.block] += 1
    for sid, r in sources.items():
        assert sum(uses[sid].values()) == r.quota
        if r.quota:
            assert set(uses[sid]) <= set(range(r.blocks)) and max(uses[sid].values()) <= -(-r.quota // r.blocks) <= mixing.LIMIT
    big = spark.createDataFrame([(1, 300_000, 10**6), (2, 100_000, 10**6)], "sid int, quota long, blocks long")
    counts, shards = mixing.draws(big)
    first = [r.n for r in counts.where(f"sid = 1 AND shard < {shards - 1}").collect()]
    mean, sd = mixing.SHARD * 0.75, (mixing.SHARD * 0.75 * 0.25) ** 0.5
    z = (np.array(first) - mean) / sd
    assert len(first) == shards - 1 and abs(z.mean()) < 0.5 and 0.75 < z.std() < 1.3 and total > 0


def test_packed_blocks_are_the_mix(docs):
    slots = mixing.packed(docs).collect()
    words = collections.defaultdict(collections.Counter)
    for r in slots:
        assert len(r.text.split(" ")) == r.n_words <= mixing.BLOCK
        words[r.source].update(r.text.split(" "))
    taken = collections.Counter()
    for r in mixing.op9(docs).collect():
        taken[r.source] += r.taken
        assert r.taken <= mixing.LIMIT * r.size
    assert {s: sum(c.values()) for s, c in words.items()} == {s: n for s, n in taken.items() if n}
    texts = collections.defaultdict(collections.Counter)
    for r in docs.collect():
        texts[r.source].update((r.text or "").encode("utf-8", "surrogatepass").split())
    for s, c in words.items():
        assert all(n <= mixing.LIMIT * texts[s][w.encode("utf-8", "surrogatepass")] for w, n in c.items())


def test_small_sources_meet_their_target(spark):
    df = spark.createDataFrame([(1, "w " * 70, "a"), (2, "w " * 10_000, "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.op9(df).collect()}
    assert got[1].target == got[1].taken == 210
    assert abs(got[2].taken - got[2].target) <= mixing.BLOCK


def test_header_names_in_any_case(spark):
    full = (1, "http://a/x", 1.0, "response", '"t"', None, {"Content-Type": "text/html", "Cache-Control": "a", "ETag": '"t"'})
    again = (2, "http://a/x", 2.0, "revisit", 'W/"t"', None, {"CACHE-CONTROL": "b", "Content-Location": "/y", "Content-Length": "0"})
    df = spark.createDataFrame([full, again], "record_id long, url string, ts double, kind string, etag string, last_modified string, headers map<string,string>")
    got = warc.resolve_revisits(df.withColumns({"curl": F.lit("clash"), "hit": F.lit("clash"), "status": F.lit("clash"), "slice": F.lit(0)})).collect()
    assert [(r.record_id, r.status, r.headers) for r in got] == [(2, "resolved", {"content-type": "text/html", "cache-control": "b", "etag": '"t"', "content-location": "/y"})]


def test_numerals_are_no_letters(docs, spark):
    base = docs.where("doc_id < 100000").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(7_000_000, "²³ ½ ①", None), (7_000_001, "x²", None)], base.schema)
    got = {r.doc_id: r for r in language.op8(base.unionByName(odd)).where("doc_id >= 7000000").collect()}
    assert (got[7_000_000].lang_pred, got[7_000_000].score) == ("und", 0.0)
    assert got[7_000_001].lang_pred != "und"


def test_long_words_are_summed_whole():
    model = pieces.default_model()
    p = language.pieces(model)
    prob = np.random.default_rng(1).random((p.n, 3)) + 1e-3
    for word in ("▁thé", "▁understanding☃that", "▁" + "deseines" * 4):
        arcs = p.arcs([word])
        assert np.allclose(language.long_score(word, prob, model), np.log(language.forward(arcs, prob)[0, len(word)]))
    long = language.long_score("▁" + "thedeseinestion" * 200, prob / prob.sum(axis=0), model)
    assert np.isfinite(long).all() and (long < 0).all()


LONG = ("the quick brown fox says hello to der kleine hund and le petit chat " * 6000) + "bob@example.com 192.168.0.1 " + "x" * 20_000


@pytest.fixture(scope="module")
def long_docs(spark):
    passage = " ".join(f"shared{k}" for k in range(40))
    rows = [(1, "a few words " + passage, "en"), (2, LONG, "en"), (3, " ".join(f"w{k}" for k in range(60_000)) + " " + passage + " end", "en"), (4, "été " * 50_000, "fr"), (6, "und der hund", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_very_long_texts(long_docs):
    text = {r.doc_id: r.text for r in long_docs.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op6(long_docs).collect()}
    for i, t in text.items():
        ids = sp.encode(t)
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    prints = {r.doc_id: r.fingerprint for r in simhash.op2(long_docs).collect()}
    assert prints == {i: f"{simhash.fingerprint(t) & (1 << 64) - 1:016x}" for i, t in text.items()}
    found = {r.doc_id: r for r in pii.op5(long_docs).collect()}
    assert (found[2].n_email, found[2].n_ip, found[3].n_email) == (1, 1, 0)
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring.op4(long_docs).collect()}
    assert cut[1] == (43, 0) and cut[3] == (60_041, 40)
    assert cut[2][1] == 0 and cut[4][1] == 0  # windows that repeat only inside their own document
    said = {r.doc_id: r for r in language.op8(long_docs).collect()}
    assert all(said[i].lang_pred != "und" and 0 <= said[i].score <= 1 for i in text)


def test_slices_are_never_empty():
    import pandas as pd

    full = ["a" * pieces.SLICE_CHARS, None, "b" * pieces.SLICE_CHARS]
    assert list(pieces.text_slices(pd.Series(full))) == [full[:1], ["", full[2]]]
    assert list(pieces.text_slices(pd.Series([], dtype=object))) == []
