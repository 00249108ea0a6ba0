"""Near copies by word shingles: MinHash proposes pairs, the exact Jaccard similarity of their shingle sets decides.

Fingerprints of 64 bits do not reach a similarity of 0.8: two of them then differ in about 10 bits, often in 16, and
nine segments of seven bits would pair everything. Of ``BANDS`` bands of ``ROWS`` minima each, one agrees for 0.9998
of the pairs at 0.8 and for more above.

Buckets of up to ``SMALL`` members are compared pair by pair. A larger one is compared with one leader, another one in
each band; those near it are linked, the others are dealt anew by the next band's key as well. Thousands of copies thus
take one pair each. What these links leave in more than one component of a crowded bucket is compared in cells of
``CELL`` members or ``WEIGHT`` shingles, exactly: a prefix filter proposes, counts of common shingles decide. A task
returns links between components only, no pairs. A bucket of over ``CELL`` members is split before it into classes of
set sizes, of which only neighbours can be similar; n members of one class take n squared / ``CELL`` rows in this.

Defined cases: as in ``simhash``, with texts in place of fingerprints: a document with fewer words than a shingle is
one whole sequence, those without words are all equal; rows without an id stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import connected_components, discard, fresh, materialize

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 16, 4
#: Members of a bucket that are compared pair by pair.
SMALL = 8
#: Members, and shingles, of a cell; a bucket with more members is split by the sizes of their sets.
CELL = 1 << 11
WEIGHT = 1 << 20
#: Pairs with one leader that meet one copy of its set.
LED = 1 << 10
SEED = 42
CHUNK = 1 << 12

_rng = np.random.default_rng(SEED)
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    line = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(w) - words + 1
    parts = [line[i:j] for i, j in zip(starts[:n].tolist(), (ends[words - 1 :] - 1).tolist())]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n))


def minima(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        x = hashes[i : i + CHUNK, None] * _MULTIPLY + _ADD
        x ^= x >> np.uint64(32)  # low bits of a product depend on low bits only
        low = np.minimum(low, (x * _MULTIPLY).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(low.reshape(BANDS, ROWS))]


def keys_of(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([band_keys(minima(shingle_set(t, words))) for t in batch], dtype=object)

    return run(text)


def set_of(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t, words).view(np.int64) for t in batch], dtype=object)

    return run(text)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b, copies) whose shingle sets have a similarity of ``least`` or more; ``b``'s set is dealt in so many copies."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a", F.lit(SEED)), F.col("copies")))
    at = ["b", "copies", "salt"]
    second = salted.select(*at).distinct().join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = salted.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(second, at)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= least * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def links_between(sets: list[np.ndarray], part: np.ndarray, own: np.ndarray, first: np.ndarray, second: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (i, j) of i in ``first`` and j in ``second``, of which one is ``own``, that join the parts of all similar sets.

    Similar sets share one of their rarest elements: of a set of n all but ``least`` n - 1 are looked up in lists (prefix
    filter). What the lists propose is counted in full. ``part`` is changed as parts are joined.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(len(sets)), size)
    flat = rank[number]
    flat = flat[np.lexsort((flat, owner))]  # each set from its rarest element on
    prefix = size - np.ceil(least * size - 1e-6).astype(np.int64) + 1
    ahead = np.arange(len(flat)) - start[owner] < prefix[owner]
    chosen = np.zeros(len(sets), bool)
    chosen[second] = True
    listed = np.flatnonzero(ahead & chosen[owner])
    listed = listed[np.argsort(flat[listed], kind="stable")]
    heads = np.searchsorted(flat[listed], np.arange(len(count) + 1))
    lists = owner[listed]
    mark = np.zeros(len(count), bool)
    links = []
    for i in first.tolist():
        mine = flat[start[i] : start[i] + size[i]]
        near = np.unique(lists[_ranges(heads[mine[: prefix[i]]], heads[mine[: prefix[i]] + 1])])
        near = near[(part[near] != part[i]) & (own[near] | own[i]) & (size[near] >= least * size[i] - 1e-6) & (size[i] >= least * size[near] - 1e-6)]
        if not len(near):
            continue
        mark[mine] = True
        common = np.add.reduceat(mark[flat[_ranges(start[near], start[near] + size[near])]].astype(np.int64), np.cumsum(size[near]) - size[near])
        mark[mine] = False
        for j in near[common >= least * (size[i] + size[near] - common)].tolist():
            if part[j] != part[i]:  # not joined meanwhile
                links.append((i, j))
                part[part == part[j]] = part[i]
    return links


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each low to below its high, in a row."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


def across(keyed: DataFrame, sets: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between different components of ``edges`` within crowded buckets: as many as join what is similar."""
    members = keyed.select("node", F.explode("keys").alias("key"))
    crowds = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("key")
    parts = connected_components(edges, "a", "b")
    of = F.coalesce("component", "node").alias("component")
    crowded = materialize(members.join(crowds, "key").join(parts, "node", "left").select("node", "key", of), "crowded")
    whole = materialize(crowded.join(_mixed(crowded, "key"), "key").join(sets.select("node", F.size("s").alias("weight")), "node"), "crowds")
    discard(crowded)
    # Sets that lie two classes apart differ too much in size; a set also goes to the class above its own.
    cls = F.floor(F.log("weight") / F.log(F.lit(1 / least * (1 + 1e-9)))).cast("long")
    classes = F.when(F.col("n") > CELL, F.array(cls, cls + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    ranged = whole.withColumn("class", F.explode(classes)).withColumn("own", (F.col("class") < 0) | (F.col("class") == cls)).drop("n")
    groups = _mixed(ranged, "key", "class")
    cells = F.ceil(F.greatest(F.col("n") / CELL, F.col("weights") / WEIGHT)).cast("int").alias("cells")
    dealt = ranged.join(groups.select("key", "class", cells), ["key", "class"])
    dealt = dealt.withColumn("seat", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("cells")).cast("int")).join(sets, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")
    dealt = dealt.select("key", "class", "node", "component", "own", "s", "seat", other)
    dealt = dealt.withColumn("low", F.least("seat", "other")).withColumn("high", F.greatest("seat", "other"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        node, part, seat = (cell[c].to_numpy(np.int64, copy=True) for c in ("node", "component", "seat"))
        first, second = np.flatnonzero(seat == seat.min()), np.flatnonzero(seat == seat.max())
        if len(np.unique(part)) < 2 or (seat.min() == seat.max() and cell["low"].iloc[0] != cell["high"].iloc[0]):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        found = links_between(cell["s"].tolist(), part, cell["own"].to_numpy(bool), first, second, least)
        return pd.DataFrame([(node[i], node[j]) for i, j in found], columns=["a", "b"], dtype=np.int64)

    return materialize(dealt.groupBy("key", "class", "low", "high").applyInPandas(compare, "a long, b long").distinct(), "across")


def _mixed(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups with members of several components and (if there are such columns) one of their own: rows ``n`` and ``weights``."""
    found = [F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")]
    if "weight" in rows.columns:
        found += [F.sum("weight").alias("weights"), F.max("own").alias("any")]
    groups = rows.groupBy(*keys).agg(*found).where("x < y")
    return (groups.where("any") if "weight" in rows.columns else groups).drop("x", "y", "any")


def similar(docs: DataFrame, words: int = WORDS, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """Edges (a, b) between the ``xxhash64`` of texts whose shingle sets have a similarity of ``least`` or more."""
    text = F.col(text_col)
    signed = docs.select(F.xxhash64(text).alias("node"), keys_of(text, words).alias("keys"))
    keyed = materialize(signed.dropDuplicates(["node"]), "band_keys")
    members = keyed.select("node", F.posexplode("keys").alias("band", "key"))
    known = members.join(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi").select("node").distinct()
    texts = docs.select(F.xxhash64(text).alias("node"), text.alias("_text")).join(known, "node", "left_semi")
    sets = materialize(texts.select("node", set_of(F.col("_text"), words).alias("s")).dropDuplicates(["node"]), "shingle_sets")
    edges, turn = None, 0
    while True:
        sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "key"), "node"))["node"].alias("leader")).where("n > 1")
        members = materialize(members.join(sizes, "key"), "buckets")
        few, many = members.where(F.col("n") <= SMALL), members.where(F.col("n") > SMALL)
        met = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b")
        led = many.where("node <> leader")
        copies = F.ceil(F.col("n") / LED).alias("copies")
        both = met.select("a", "b", F.lit(1).cast("long").alias("copies")).unionByName(led.select(F.col("node").alias("a"), F.col("leader").alias("b"), copies))
        pairs = materialize(both.groupBy("a", "b").agg(F.max("copies").alias("copies")), "pairs")
        if pairs.isEmpty():
            break
        found = materialize(verified(pairs, sets, least), "similar")
        edges = found if edges is None else edges.unionByName(found)
        apart = led.join(found, (F.col("node") == F.col("a")) & (F.col("leader") == F.col("b")), "left_anti").select("node", "band", "key")
        if turn < BANDS - 1:  # crowds are split by one more band
            turn += 1
            finer = F.xxhash64("key", F.get("keys", (F.col("band") + turn) % BANDS))
            apart = apart.join(keyed, "node").select("node", "band", finer.alias("key"))
        old, members = members, materialize(apart, "band_members")
        discard(old), discard(pairs)
    if edges is None:
        return members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return edges.unionByName(across(keyed, sets, edges, least))


def compared(docs: DataFrame, proposed: DataFrame, words: int = WORDS, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """Those proposed pairs (a, b, n) of ``xxhash64`` of texts whose shingle sets have a similarity of ``least`` or more."""
    pairs = materialize(proposed.select("a", "b", F.ceil(F.col("n") / LED).alias("copies")), "proposed")
    known = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("_text")).join(known, "node", "left_semi").dropDuplicates(["node"])
    sets = materialize(texts.select("node", set_of(F.col("_text"), words).alias("s")), "proposed_sets")
    return materialize(verified(pairs, sets, least), "compared")


def representatives(docs: DataFrame, words: int = WORDS, least: float = LEAST, proposed: DataFrame | None = None) -> DataFrame:
    """Documents without near copies: of each component the smallest ``doc_id`` stays; rows without an id stay too. ``proposed``:
    pairs (a, b, n) of the ``xxhash64`` of texts from elsewhere, to be compared as well."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("node"))
    edges = similar(docs, words, least)
    if proposed is not None:
        edges = edges.unionByName(compared(docs, proposed, words, least))
    parts = materialize(connected_components(edges, "a", "b"), "parts")
    whole = parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())
    linked = materialize(rows.join(whole, "node"), "linked")
    firsts = linked.groupBy("component").agg(F.min("id").alias("first"))
    copies = rows.groupBy("node").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    alone = rows.join(copies, "node").join(whole, "node", "left_anti").where("id <> first").select("id", "node")
    one, two, own = fresh(docs, "_id"), fresh(docs, "_node"), fresh(docs, "_own")
    gone = linked.join(firsts, "component").where("id <> first").select("id", "node").unionByName(alone).distinct().toDF(one, two)
    return docs.withColumn(own, F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col(one)) & (F.col(own) == F.col(two)), "left_anti").drop(own)
