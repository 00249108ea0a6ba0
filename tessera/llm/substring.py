r"""Substring dedup by seed and extend.

Seeds are winnowed: of each ``LENGTH`` words in a row, the least hash among its ``SEED_WORDS``-word grams is the
window's anchor (rightmost of equal ones), so equal windows share their anchor. An anchor occurrence carries the run
of windows that it anchors. Documents meet on anchors: an anchor's first and last document (combined before the
shuffle) tell whether it is shared at all. A shared occurrence is extended both ways over its run: where all
occurrences of the anchor have the same words around them, the whole run is decided at once; elsewhere its windows are
compared one by one by an equality join of their hashes. The windows found repeated are merged into maximal repeats.
No pairs of documents are made, so a passage in a third of all documents costs each of them one row per anchor.

Defined cases: a null or empty text has no words; documents of fewer than ``LENGTH`` words lose none; a row with a
null id neither loses words nor makes others lose any; rows that share an id are one document for the comparison, so
they lose nothing to each other; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import discard, materialize

LENGTH = 13
SEED_WORDS = 5
#: Documents whose lists of runs are broadcast, if these also hold 1,000,000 runs at most; else they are joined by a shuffle.
LIST_ROWS = 20_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: exactly \x20 \x09-\x0D


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Windows:
    """Texts laid end to end, with prefix sums of polynomial hashes: the hash of any words in a row is one difference.

    A word of hash h at place j counts h * factor^j; a window's sum is divided by factor^start, as an odd factor has
    an inverse modulo 2^64. Windows that cross into the next text are told by ``text`` at their ends.
    """

    def __init__(self, words: list[list[bytes]]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        self.h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words), repeat(0)), np.uint64, n)
        self.text = np.repeat(np.arange(len(words), dtype=np.int32), self.sizes)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, at: np.ndarray | slice, size: np.ndarray | int, factor: np.uint64) -> np.ndarray:
        """Hashes of the windows of ``size`` words that start ``at`` these places; a slice takes all starts in it."""
        f = int(factor)
        if f not in self._sums:
            n = len(self.h)
            power = np.full(n, factor)
            back = np.full(n, np.uint64(_inverse(f)))
            power[:1] = back[:1] = 1
            np.multiply.accumulate(power, out=power)
            np.multiply.accumulate(back, out=back)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.h * power, out=sums[1:])
            self._sums[f] = sums, back
        sums, back = self._sums[f]
        if isinstance(at, slice):
            out = (sums[at.start + size : at.stop + size] - sums[at]) * back[at]
        else:
            out = (sums[at + size] - sums[at]) * back[at]
        out ^= out >> np.uint64(29)
        out *= _M3
        return out ^ (out >> np.uint64(32))

    def anchors(self, length: int = LENGTH, seed: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of all seeds, starts of the windows inside a text, place of each one's anchor)."""
        m = len(self.h) - length + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = self.hashes(slice(0, len(self.h) - seed + 1), seed, _M1)
        best, at = grams, np.arange(len(grams))
        per, span = length - seed + 1, 1  # least of ``per`` seeds, the right one of equals, from spans twice as wide each time
        while span < per:
            step = min(span, per - span)
            right = best[step:] <= best[:-step]
            best, at = np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step])
            span += step
        start = np.flatnonzero(self.text[:m] == self.text[length - 1 :])
        return grams, start, at[start]

    def runs(self, length: int = LENGTH, seed: int = SEED_WORDS):
        """(text, anchor, context, first window, windows): a text's windows in a row with one anchor, and a hash of all their words."""
        grams, start, at = self.anchors(length, seed)
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        first, n = start[head], np.diff(np.append(head, len(start)))
        context = self.hashes(first, n + (length - 1), _M2) ^ n.astype(np.uint64)
        text = self.text[first]
        return text, grams[at[head]], context, first - self.starts[text], n


#: Words laid end to end at a time.
FLAT = 1 << 17


def _slices(batches: Iterator[pd.DataFrame], least: int = 0) -> Iterator[tuple[list[int], list[list[bytes]], pd.DataFrame]]:
    """(rows, their words, their batch): some texts of at least ``least`` words at a time, about FLAT words."""
    for batch in batches:
        rows, words, n = [], [], 0
        for k, text in enumerate(batch["text"]):
            w = words_of(text)
            if len(w) >= least:
                rows.append(k), words.append(w)
                n += len(w)
            if n >= FLAT:
                yield rows, words, batch
                rows, words, n = [], [], 0
        if rows:
            yield rows, words, batch


#: h: 28 bits of the text's hash, to tell rows that share an id apart.
RUN_SCHEMA = "anchor long, context long, id long, h int, first int, n int"
HASH_BITS = 28


def _all_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows, words, batch in _slices(batches, LENGTH):
        text, anchor, context, first, n = Windows(words).runs()
        ids, keys = batch["id"].to_numpy(np.int64)[rows], batch["h"].to_numpy(np.int32)[rows]
        yield pd.DataFrame({"anchor": anchor.view(np.int64), "context": context.view(np.int64), "id": ids[text], "h": keys[text], "first": first.astype(np.int32), "n": n.astype(np.int32)})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of the windows in the listed runs."""
    for rows, words, batch in _slices(batches):
        w = Windows(words)
        lists = batch["listed"].to_numpy()[rows]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.array([(x["first"], x["n"]) for x in chain.from_iterable(lists)], np.int64).reshape(-1, 2)
        run = np.repeat(np.arange(len(flat)), flat[:, 1])
        first = flat[run, 0] + np.arange(len(run)) - (np.cumsum(flat[:, 1]) - flat[:, 1])[run]
        text = np.repeat(np.arange(len(rows)), size)[run]
        at = w.starts[text] + first
        one, two = w.hashes(at, LENGTH, _M1), w.hashes(at, LENGTH, _M2)
        ids, keys = batch["id"].to_numpy(np.int64)[rows], batch["h"].to_numpy(np.int32)[rows]
        yield pd.DataFrame({"one": one.view(np.int64), "two": two.view(np.int64), "id": ids[text], "h": keys[text], "first": first.astype(np.int32)})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for i, text, listed in zip(batch["id"], batch["text"], batch["listed"]):
            w = words_of(text)
            gone = maximal(listed, len(w))
            kept, at = [], 0
            for a, b in gone:
                kept += w[at:a]
                at = b
            kept += w[at:]
            rows.append((i, len(w), len(w) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), [dict(start=a, end=b) for a, b in gone]))
        yield pd.DataFrame(rows, columns=["id", "n_words", "n_removed", "kept", "repeats"])


def maximal(listed, n_words: int) -> list[tuple[int, int]]:
    """Word spans [start, end) covered by the listed windows (first, n), merged."""
    if listed is None or not len(listed):
        return []
    edge = np.zeros(n_words + 1, np.int64)
    first = np.array([x["first"] for x in listed], np.int64)
    n = np.array([x["n"] for x in listed], np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n - 1 + LENGTH, -1)
    covered = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
    change = np.flatnonzero(covered[1:] != covered[:-1]).tolist()
    return list(zip(change[::2], change[1::2]))


def _text_hash(col: str):
    return F.pmod(F.xxhash64(col), F.lit(1 << HASH_BITS)).cast("int")


def _listed(rows: DataFrame) -> DataFrame:
    """(id, h, listed): a document's runs together; as many as its words at most."""
    return rows.groupBy("id", "h").agg(F.collect_set(F.struct("first", "n")).alias("listed"))


def _with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Joins lists to texts. Lists of up to LIST_ROWS documents with 1,000,000 runs in all are broadcast."""
    size = lists.agg(F.count("*").alias("n"), F.sum(F.size("listed")).alias("m")).first()
    small = size.n <= LIST_ROWS and (size.m or 0) <= 1_000_000
    return docs.join(F.broadcast(lists) if small else lists, ["id", "h"], how)


#: Keys with over 1/HOT_KEYS of all rows are hot: there are fewer than HOT_KEYS of them, so they can be broadcast.
HOT_KEYS = 20_000


def _meet(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` (materialised) counts a group's rows in ``n_rows``.

    Hot groups come to the rows by broadcast, so their rows stay dealt as they are; the others meet by a shuffle.
    """
    bound = max(1000, (groups.agg(F.sum("n_rows")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col("n_rows") > bound).drop("n_rows"))
    rest = groups.where(F.col("n_rows") <= bound).drop("n_rows")
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys)
    return rows.join(hot, keys).unionByName(cold)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, first, n): runs of windows that also start in a document of smaller id; h is a hash of the text."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    docs = docs.where("id IS NOT NULL AND text IS NOT NULL")
    found = materialize(docs.mapInPandas(_all_runs, RUN_SCHEMA), "anchors")
    ends = [F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n_rows")]
    shared = found.groupBy("anchor").agg(*ends, F.min("context").alias("c1"), F.max("context").alias("c2"))
    shared = materialize(shared.where("low < high").select("anchor", "low", (F.col("c1") == F.col("c2")).alias("same"), "n_rows"), "shared_anchors")
    # Position, length and hash cross the shuffle as one number.
    packed = found.select("anchor", "id", F.expr(f"shiftleft(CAST(first AS BIGINT), {HASH_BITS + 4}) | shiftleft(CAST(h AS BIGINT), 4) | n").alias("at"))
    met = _meet(packed, shared, ["anchor"]).where("NOT same OR id > low")
    first, h = F.shiftright("at", HASH_BITS + 4), F.shiftright("at", 4).bitwiseAND((1 << HASH_BITS) - 1)
    met = met.select("id", h.cast("int").alias("h"), first.cast("int").alias("first"), F.col("at").bitwiseAND(15).cast("int").alias("n"), "same")
    met = materialize(met, "shared")
    discard(found)
    whole = met.where("same").select("id", "h", "first", "n")

    lists = materialize(_listed(met.where("NOT same")), "to_extend")
    windows = materialize(_with_lists(docs, lists, "inner").mapInPandas(_windows, "one long, two long, id long, h int, first int"), "windows")
    lows = materialize(windows.groupBy("one", "two").agg(*ends).where("low < high").drop("high"), "shared_windows")
    single = _meet(windows, lows, ["one", "two"]).where("id > low").select("id", "h", "first", F.lit(1).alias("n"))
    return whole.unionByName(single)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, ``n_words``, ``n_removed``, ``kept`` text and ``repeats`` (word spans)."""
    lists = materialize(_listed(repeats(docs, id_col, text_col)), "repeats")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    joined = _with_lists(texts, lists, "left").select("id", "text", "listed")
    out = joined.mapInPandas(_cut, "id long, n_words long, n_removed long, kept string, repeats array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def op4(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
