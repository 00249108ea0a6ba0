r"""Interpolated modified Kneser-Ney n-gram models (Chen and Goodman, 1998), counted in Spark.

Words (``[^\x20\x09-\x0D]+``, A-Z lower-cased) are told apart by 64-bit hashes of their bytes, n-grams by a hash of
their words' hashes. A document is padded with ``order`` - 1 begin marks and ends with one end token.

Counting: each task counts the n-grams of some millions of tokens at a time (``FLUSH``) and deals them out as packed
arrays, a row for each shard; a shard holds all n-grams with the same last n - 1 words, so it alone makes the
continuation counts (different words before them) of the next lower order, and so on down to words. Contexts (all words
but the last) are dealt out once more with the numbers of 1, 2, 3 and more followers that the discounts need. Shards
have about ``SHARD_TEXT`` bytes of text each, whatever the input's size. A frequent n-gram is one entry for each task.

Storage: for each order and shard a sorted array of hashes and an array of counts beside it (``.npy``), written to the
shared folder under their last name in one step, so that a task that runs again writes the same file. That folder has to
be mounted (a ``file:`` path): workers memory-map the shards, up to ``OPEN`` at a time, and look up each slice's
distinct n-grams in sorted order, so pages are read in turn and shared by a machine's workers.

Words' counts rest on different words having different hashes: of a billion words about three in a hundred such corpora
would hold one clash. All counts are over all training documents; nothing is pruned.

Defined cases: a null or empty text is one end token; a null id is not held out; words not seen in training share the
uniform part 1 / (V + 1); without training documents every token gets 1; where counts of counts are too few for the
discounts (a zero among n1 to n3, or a discount out of its range) they are 0.5, 1 and 1.5; repeated rows each count and
keep a row; very long texts are cut into no parts; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import materialize, shared_dir, text_of
from tessera.llm.arrow_text import slices, text_bytes

#: Bigrams: orders above need more disk than is granted (see the README).
ORDER = 2
FLUSH = 4_000_000
SLICE_BYTES = 4 << 20
SHARD_TEXT = 32 << 20
OPEN = 256
TOO_FEW = (0.5, 1.0, 1.5)

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _stream(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = _stream(256, 11)[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
END, BEGIN = _stream(2, 12)


def word_hashes(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, how many each text has): a multilinear hash of each word's bytes."""
    at, data = text_bytes(text)
    word = ~_BLANK[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = at[:-1][np.diff(at) > 0]
    begins[first] = word[first]
    start = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(start, at))
    if not len(start):
        return np.zeros(0, _U), counts
    inside = np.flatnonzero(word)
    cut = np.searchsorted(inside, start)
    length = np.diff(np.append(cut, len(inside)))
    place = inside - np.repeat(start, length)
    value = _BYTE[data[inside]] * (_stream(int(length.max()), 13) | _U(1))[place]
    return _mix(np.add.reduceat(value, cut) + length.astype(_U)), counts


def tokens(text: pa.StringArray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded hashes, places of the tokens among them, first token of each text): words and an end, begin marks before."""
    words, counts = word_hashes(text)
    n, pad = len(counts), order - 1
    doc = np.repeat(np.arange(n), counts)
    out = np.full(len(words) + n * order, BEGIN)
    at = np.arange(len(words)) + doc * order + pad
    out[at] = words
    ends = np.cumsum(counts + order) - 1
    out[ends] = END
    real = np.ones(len(out), bool)
    starts = np.cumsum(counts + order) - counts - order
    for j in range(pad):
        real[starts + j] = False
    return out, np.flatnonzero(real), np.cumsum(counts + 1) - counts - 1


def gram(words: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams given word by word; of one word, its own."""
    h = words[0]
    for w in words[1:]:
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w)
    return h


def _pack(a: np.ndarray) -> bytes:
    """An array of whole numbers from 0 in its narrowest type, compressed."""
    kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
    return kind.char.encode() + len(a).to_bytes(8, "little") + pa.compress(a.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    kind, n = np.dtype(chr(b[0])), int.from_bytes(b[1:9], "little")
    return np.frombuffer(pa.decompress(b[9:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), kind).astype(_U)


def _sums(order: np.ndarray, key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places where another key begins, sums of the columns over equal keys); all in the given order, in which equal keys meet."""
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return begins, [np.add.reduceat(c[order], begins) if len(key) else c for c in columns]


def _dealt(kind: str, shard_key: np.ndarray, bits: int, columns: list[np.ndarray]) -> list[tuple]:
    """A row (kind, shard, n, packed columns) for each shard that gets something."""
    order = np.argsort(shard_key)
    shard = (shard_key[order] >> _U(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
    columns = [c[order] for c in columns]
    return [(kind, int(shard[a]), b - a, [_pack(c[a:b]) for c in columns]) for a, b in zip(cuts, [*cuts[1:], len(shard)])]


ROW = "kind string, shard long, n long, columns array<binary>"


def _save(path: str, keys: np.ndarray, values: np.ndarray) -> None:
    """Sorted by key; each file appears whole or not at all."""
    order = np.argsort(keys)
    values = values[:, order]
    values = values.astype(np.min_scalar_type(int(values.max()) if values.size else 0))
    for name, a in ((f"{path}.values.npy", values), (f"{path}.keys.npy", keys[order])):
        part = f"{name}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            np.save(f, a)
        os.replace(part, name)


@lru_cache(OPEN)
def _load(path: str) -> tuple[np.ndarray, np.ndarray] | None:
    if not os.path.exists(f"{path}.keys.npy"):
        return None
    return np.load(f"{path}.keys.npy", mmap_mode="r"), np.load(f"{path}.values.npy", mmap_mode="r")


def _counted(texts: Iterator[pa.RecordBatch], order: int, bits: int) -> Iterator[list[tuple]]:
    """Rows of packed n-gram counts, after every ``FLUSH`` tokens."""
    held: list[list[np.ndarray]] = []
    size = 0

    def flush() -> list[tuple]:
        words = [np.concatenate([h[j] for h in held]) for j in range(order)]
        held.clear()
        key = gram(words)
        by = np.argsort(key)
        begins, (n,) = _sums(by, key[by], [np.ones(len(key), _U)])
        one = by[begins]
        words = [w[one] for w in words]
        return _dealt("gram", gram(words[1:]), bits, [*words, n])

    for part in slices(texts, "text", SLICE_BYTES):
        padded, at, _ = tokens(part.column("text"), order)
        held.append([padded[at - (order - 1) + j] for j in range(order)])
        size += len(at)
        if size >= FLUSH:
            yield flush()
            size = 0
    if held:
        yield flush()


def _reduced(rows: pd.DataFrame, shard: int, k: int, bits: int, at: str) -> list[tuple]:
    """Store a shard's k-grams; rows for the next order, its contexts and counts of counts.

    Columns of a row: the k words, the count (in lower orders: of different words before), the raw count if another.
    """
    found = [[_unpack(b) for b in r] for r in rows["columns"]]
    columns = [np.concatenate(c) for c in zip(*found)]
    words, count, raw = columns[:k], columns[k], columns[-1]
    key = gram(words)
    by = np.argsort(key)
    begins, (count, raw) = _sums(by, key[by], [count, raw])
    one = by[begins]
    words, key = [w[one] for w in words], key[one]
    _save(f"{at}/grams{k}-{shard}", key, count[None])
    suffix, context = gram(words[1:]), gram(words[:-1])
    by = np.argsort(suffix)
    begins, (before, raw) = _sums(by, suffix[by], [np.ones(len(key), _U), raw])
    tail = [w[by[begins]] for w in words[1:]]
    out = [("stat", k, len(count), [_pack(np.array([(count == i).sum() for i in range(1, 5)]))])]
    if k == 2:
        _save(f"{at}/words-{shard}", tail[0], np.stack([before, raw]))
        out += [("stat", 1, len(before), [_pack(np.array([(before == i).sum() for i in range(1, 5)])), _pack(np.array([before.sum(), raw.sum()]))])]
    else:
        out += _dealt("gram", gram(tail[1:]), bits, [*tail, before, raw])
    by = np.argsort(context)
    begins, sums = _sums(by, context[by], [count, *[(np.minimum(count, 3) == i).astype(_U) for i in (1, 2, 3)]])
    return out + _dealt("context", context[by[begins]], bits, [context[by[begins]], *sums])


def _contexts(rows: pd.DataFrame, shard: int, k: int, at: str) -> pd.DataFrame:
    found = [[_unpack(b) for b in r] for r in rows["columns"]]
    key, *columns = [np.concatenate(c) for c in zip(*found)]
    by = np.argsort(key)
    begins, sums = _sums(by, key[by], columns)
    _save(f"{at}/contexts{k}-{shard}", key[by[begins]], np.stack(sums))
    return pd.DataFrame({"shard": [shard]})


@dataclass(frozen=True)
class Model:
    """Where a model's arrays lie, and the few numbers beside them."""

    at: str
    order: int
    bits: int
    tokens: int
    words: int
    pairs: int
    discounts: dict[int, tuple[float, float, float]]
    rest: float


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Those of counts 1, 2, and 3 or more, from the numbers of n-grams that occur 1 to 4 times."""
    if min(n[:3]) <= 0:
        return TOO_FEW
    y = n[0] / (n[0] + 2 * n[1])
    d = tuple(i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3))
    return d if all(0 <= x <= i for i, x in enumerate(d, 1)) else TOO_FEW


def _folder(spark: SparkSession) -> str:
    at = urlparse(shared_dir(spark))
    if at.scheme not in ("", "file"):
        raise RuntimeError("workers map the model's arrays into memory: spark.checkpoint.dir must be a mounted folder (file:)")
    path = f"{at.path}/tessera/{uuid.uuid4().hex}/ngrams"
    os.makedirs(path, exist_ok=True)
    return path


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of the texts in ``docs``; the driver gets a few numbers from each shard."""
    if order < 2:
        raise ValueError("an n-gram model has order 2 or more")
    at = _folder(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, size / SHARD_TEXT)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("n", pa.int64()), ("columns", pa.list_(pa.binary()))])
        for rows in _counted(batches, order, bits):
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), schema.types)], schema=schema)

    rows = docs.select(text_of().alias("text")).mapInArrow(count, ROW)
    stats: dict[int, list] = {k: [[0] * 4, [0] * 2, 0] for k in range(1, order + 1)}
    reduce = lambda k: lambda key, pdf: pd.DataFrame(_reduced(pdf, key[0], k, bits, at), columns=["kind", "shard", "n", "columns"])
    finish = lambda k: lambda key, pdf: _contexts(pdf, key[0], k, at)
    for k in range(order, 1, -1):
        made = materialize(rows.groupBy("shard").applyInPandas(reduce(k), ROW), f"order{k}")
        for r in made.where("kind = 'stat'").collect():
            sums = stats[r["shard"]]
            sums[2] += r["n"]
            for i, b in enumerate(r["columns"]):
                sums[i] = [x + int(y) for x, y in zip(sums[i], _unpack(b))]
        made.where("kind = 'context'").groupBy("shard").applyInPandas(finish(k), "shard long").count()
        rows = made.where("kind = 'gram'")
    found = {k: discounts(s[0]) for k, s in stats.items()}
    (once, twice, *_), (pairs, all_tokens), words = stats[1]
    rest = sum(d * n for d, n in zip(found[1], (once, twice, words - once - twice)))
    return Model(at, order, bits, all_tokens, words, pairs, found, rest)


def _find(model: Model, name: str, key: np.ndarray, by: np.ndarray, columns: int) -> np.ndarray:
    """The values of each key (0 where there is none) from the shards told by ``by``; distinct keys are sought once, in order."""
    one, back = np.unique(key, return_inverse=True)
    where = np.zeros(len(one), np.int64)
    where[back] = np.arange(len(key))
    shard = (by[where] >> _U(64 - model.bits)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    out = np.zeros((columns, len(one)))
    cuts = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1])) if len(one) else []
    for a, b in zip(cuts, [*cuts[1:], len(one)]):
        rows = order[a:b]
        held = _load(f"{model.at}/{name}-{shard[rows[0]]}")
        if held is not None and len(held[0]):
            keys, values = held
            place = np.minimum(np.searchsorted(keys, one[rows]), len(keys) - 1)
            hit = keys[place] == one[rows]
            out[:, rows[hit]] = values[:, place[hit]]
    return out[:, back]


def log_probabilities(model: Model, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw counts, log10 probabilities) of the tokens at the given places."""
    word = lambda j: padded[at - j]
    before, raw = _find(model, "words", word(0), word(0), 2)

    def part(k: int, count: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *model.discounts[k]])
        return np.maximum(count - d[np.minimum(count, 3).astype(int)], 0)

    p = np.full(len(at), 1 / (model.words + 1))
    if model.pairs:
        p = (part(1, before) + model.rest * p) / model.pairs
    for k in range(2, model.order + 1):
        grams = [word(j) for j in range(k - 1, -1, -1)]
        count = _find(model, f"grams{k}", gram(grams), gram(grams[1:]), 1)[0]
        context = gram(grams[:-1])
        total, *followers = _find(model, f"contexts{k}", context, context, 4)
        known = total > 0
        rest = sum(d * n for d, n in zip(model.discounts[k], followers))
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(known, (part(k, count) + rest * p) / total, p)
    return raw, np.log10(p)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens, n_known, base_score (add 0.5), score (log10 probability) and perplexity of each text."""
    given = docs.select(*keep, text_of().alias("_text"))
    made = "n_tokens long, n_known long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE_BYTES):
            padded, at, starts = tokens(part.column("_text"), model.order)
            raw, logs = log_probabilities(model, padded, at)
            base = np.log10((raw + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            n = np.diff(np.append(starts, len(at)))
            known, base, logs = (np.add.reduceat(x, starts) for x in ((raw > 0).astype(np.int64), base, logs))
            columns = [n.astype(np.int64), known, base, logs, 10 ** (-logs / n)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *map(pa.array, columns)], [*keep, *[c.split()[0] for c in made.split(", ")]])

    return given.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in given.dtypes[:-1]) + ", " + made)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op11(docs: DataFrame) -> DataFrame:
    given = docs.select("doc_id", "text", held_out().alias("held_out"))
    model = train(given.where("NOT held_out"))
    out = score(given, model, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
