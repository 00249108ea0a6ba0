"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to 8 dimensions per block and decoded to the nearest point of the E8 lattice, in
``TABLES`` tables of ``BLOCKS`` blocks. A vector is put under its own cell and probes the neighbouring ones (the
nearest point of E8's other coset in each block). Vectors that share a cell are verified by cosine in double
precision, in blocks of a numpy product; a pair counts only in the least cell that it shares, so nothing is counted
twice and no pairs are written, only each vector's number of links and its local root.

Equal vectors are one class with a number of copies. A cell with more than ``CELL`` vectors is cut into parts, and each
two parts are compared in a task of their own: exact, however large.

Defined cases: null, empty or zero vectors and those with null or non-finite components link with nothing and are
their own component; vectors link only with those of their own length; null ids keep a row, count as links and never
name a component that has another id; repeated rows count as other vectors; an empty table gives no row; labels and
other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import connected_components, materialize

MIN_COSINE = 0.95
TABLES = 12
BLOCKS = 2
WIDTH = 1.6
CELL = 1024
ROWS = 512
COLUMNS = 1024
SMALL = 32
PAIRS = 4096
BATCH = 1024


def e8_cosets(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest points (doubled, so whole numbers) of E8's cosets D8 and D8 + 1/2, the nearer one first."""

    def d8(x: np.ndarray) -> np.ndarray:
        r = np.rint(x)
        odd = np.flatnonzero(r.sum(axis=1) % 2)
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(axis=1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return r

    a, b = d8(y), d8(y - 0.5) + 0.5
    swap = (((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1))[:, None]
    return (np.where(swap, b, a) * 2).astype(np.int64), (np.where(swap, a, b) * 2).astype(np.int64)


def _fold(points: np.ndarray, salt: int) -> np.ndarray:
    """A 56-bit number of each row of whole numbers."""
    h = np.full(len(points), salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in points.T:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h >> np.uint64(8)


def cells(vectors: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, width: float = WIDTH) -> np.ndarray:
    """(n, tables * 2**blocks) cell numbers of unit vectors; the table is in the upper bits."""
    out = []
    for t in range(tables):
        planes = np.random.default_rng([t, vectors.shape[1]]).standard_normal((vectors.shape[1], 8 * blocks))
        y = vectors @ planes / width
        own = [e8_cosets(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
        for probe in range(2**blocks):
            points = np.concatenate([own[b][probe >> b & 1] for b in range(blocks)], axis=1)
            out.append((_fold(points, vectors.shape[1]) | np.uint64(t << 56)).view(np.int64))
    return np.stack(out, axis=1)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells_of(vectors):
    @F.pandas_udf("array<bigint>")
    def run(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype=object)
        for n, at in v.groupby(v.str.len()).groups.items():
            if n:
                keys = np.sort(cells(_unit(v.loc[at])), axis=1)
                for i, row in zip(at, keys):
                    out.at[i] = row
        return out

    return run(vectors)


def _small(x: np.ndarray, keys: np.ndarray, key: np.ndarray, group: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (p, q) that count in their cell, over many small cells at once; ``apart`` numbers what may not pair, or is -1."""
    ps, qs = [], []
    for d in range(1, SMALL):
        p = np.flatnonzero(group[:-d] == group[d:]) if d < len(group) else np.empty(0, np.int64)
        if not len(p):
            break
        p = p[(apart[p] < 0) | (apart[p] != apart[p + d])]
        ps.append(p)
        qs.append(p + d)
    p, q = np.concatenate([*ps, np.empty(0, np.int64)]), np.concatenate([*qs, np.empty(0, np.int64)])
    near = [np.einsum("ij,ij->i", x[p[i : i + PAIRS]], x[q[i : i + PAIRS]]) >= MIN_COSINE for i in range(0, len(p), PAIRS)]
    p, q = (p[np.concatenate(near)], q[np.concatenate(near)]) if near else (p, q)
    here = np.ones(len(p), bool)
    for i in range(0, len(p), PAIRS):
        one, two, own = keys[p[i : i + PAIRS]], keys[q[i : i + PAIRS]], key[p[i : i + PAIRS]]
        for c in range(two.shape[1]):
            at = two[:, c]
            here[i : i + PAIRS] &= ~((one == at[:, None]).any(axis=1) & (at >= 0) & (at < own))
    return p[here], q[here]


def _large(x: np.ndarray, keys: np.ndarray, key: int, part: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same for one cell, or two parts of it, as matrix products."""
    # Cells below this one that at least two members have: a pair that shares one is counted there.
    at, col = np.nonzero((keys < key) & (keys >= 0))
    _, cell, n = np.unique(keys[at, col], return_inverse=True, return_counts=True)
    many = n[cell] > 1
    at, cell = at[many], np.unique(cell[many], return_inverse=True)[1]
    ps, qs = [], []
    for i in range(0, len(x), ROWS):
        hit = x[i : i + ROWS] @ x.T >= MIN_COSINE
        hit &= np.arange(len(x)) > np.arange(i, i + len(hit))[:, None]
        if split:
            hit &= part[i : i + ROWS, None] != part[None, :]
        for c in range(0, int(cell.max()) + 1 if len(cell) and hit.any() else 0, COLUMNS):
            some = (cell >= c) & (cell < c + COLUMNS)
            has = np.zeros((len(x), COLUMNS), np.float32)
            has[at[some], cell[some] - c] = 1
            hit &= has[i : i + ROWS] @ has.T < 0.5
        p, q = np.nonzero(hit)
        ps.append(p + i)
        qs.append(q)
    return np.concatenate(ps), np.concatenate(qs)


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """Some cells, or pairs of parts of large ones: links counted here and local roots."""
    pdf = pdf.sort_values(["key", "a", "b", "cid"], ignore_index=True)
    cid, copies, part, key = (pdf[c].to_numpy() for c in ("cid", "copies", "part", "key"))
    split = (pdf["a"] != pdf["b"]).to_numpy()
    group = pdf.groupby(["key", "a", "b"], sort=True).ngroup().to_numpy()
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    x = _unit(pdf["v"])
    width = pdf["keys"].str.len()
    keys = np.full((len(pdf), int(width.max())), -1, np.int64)
    keys[np.arange(keys.shape[1]) < width.to_numpy()[:, None]] = np.concatenate(pdf["keys"].to_numpy())

    few = np.flatnonzero((sizes < SMALL)[group])
    p, q = _small(x[few], keys[few], key[few], group[few], np.where(split, part, -1)[few])
    ps, qs = [few[p]], [few[q]]
    for at, n in zip(starts[sizes >= SMALL], sizes[sizes >= SMALL]):
        own = slice(at, at + n)
        p, q = _large(x[own], keys[own], int(key[at]), part[own], bool(split[at]))
        ps.append(p + at)
        qs.append(q + at)
    p, q = np.concatenate(ps), np.concatenate(qs)

    links = np.bincount(p, copies[q], len(pdf)) + np.bincount(q, copies[p], len(pdf))
    root = np.arange(len(pdf))
    while len(p):
        old = root.copy()
        np.minimum.at(root, p, root[q])
        np.minimum.at(root, q, root[p])
        root = root[root]
        if (old == root).all():
            break
    out = pd.DataFrame({"cid": cid, "links": links.astype(np.int64), "root": cid[root]})
    return out[out["links"] > 0].groupby(["cid", "root"], as_index=False)["links"].sum()[["cid", "links", "root"]]


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector: id, ``n_links``, ``component_id`` and ``kept``."""
    number = "float" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(valid, F.lit(False)), F.transform("v", lambda x: x + F.lit(0).cast(number))))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # The number is stable because the table is written at once.
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "first", "copies", "v"), "classes")
    keyed = materialize(classes.select("cid", _cells_of(F.col("v")).alias("keys")), "cells")

    # A vector's cells that hold others too, with how many; most vectors have few.
    members = keyed.select("cid", F.explode(F.array_distinct("keys")).alias("key"))
    crowds = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = members.join(crowds.hint("merge"), "key").groupBy("cid").agg(F.collect_list(F.struct("key", "n")).alias("shared"))
    shared = materialize(shared, "shared")
    parts = F.ceil(F.col("cell.n") / CELL)
    total = shared.select(F.aggregate("shared", F.lit(0).cast("long"), lambda s, c: s + F.ceil(c["n"] / CELL)).alias("n")).agg(F.sum("n")).first()[0] or 0

    full = shared.join(classes.select("cid", "copies", "v").hint("merge"), "cid").select("*", F.col("shared.key").alias("keys"))
    full = full.select("cid", "copies", "v", "keys", F.explode("shared").alias("cell"))
    full = full.select("cid", "copies", "v", "keys", F.col("cell.key").alias("key"), F.pmod(F.xxhash64("cid"), parts).alias("part"), parts.alias("parts"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    full = full.withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")}).drop("other")
    # Cells are dealt out in batches of about BATCH rows: a task of their own would cost more than their pairs do.
    batch = F.pmod(F.xxhash64("key", "a", "b"), F.lit(total // BATCH + 1))
    full = full.withColumns({"batch": batch, "dim": F.size("v")})
    verified = materialize(full.groupBy("batch", "dim").applyInPandas(_verify, "cid long, links long, root long"), "verified")

    counted = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(verified.where("cid <> root"), "cid", "root").toDF("cid", "component")
    rooted = classes.select("cid", "first", "copies").join(counted, "cid", "left").join(parts, "cid", "left")
    rooted = rooted.withColumn("component", F.coalesce("component", "cid"))
    firsts = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    named = rooted.join(firsts, "component").select("cid", n_links.alias("n_links"), "component_id")
    named = classes.select("cid", F.col("v").alias("v2")).join(named, "cid").drop("cid")
    out = rows.join(named, F.col("v") == F.col("v2"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op7(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
