"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at most two bits, one
segment differs in at most one bit; so each segment is indexed 32 times, each time with one bit as a wildcard, and
equal variants are joined and verified.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; equal
texts have equal fingerprints; a document with fewer words than a shingle is hashed as one whole sequence; rows with
a null id keep a row and take the smallest id of their group (null if the group has none); repeated rows each keep
a row; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import connected_components, materialize, maybe_broadcast

MAX_BITS = 2
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint: bit i is set if set in over half of the shingles' XXH64."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= words:
        shingles, n = [line], 1
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        n = len(w) - words + 1
        shingles = [line[i:j] for i, j in zip(starts[:n].tolist(), (ends[words - 1 :] - 1).tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(text: Column, words: int = 3) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    return run(text)


def link(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just what pairs of distinct ``fp`` at up to two differing bits connect.

    A bucket of two is its pair. Buckets of more are never paired inside, as they may hold near copies by the thousand
    and prints that share no more than half their bits: their members, each once however many such buckets it is in,
    are keyed by themselves and their 64 one-bit neighbours instead, at 65 rows a member (the index itself takes 64). Members of such a key (65 at most) all
    lie within two bits of each other, and any two within two bits share one, so a star on each key is exact.
    """
    variant = F.expr("shiftleft(v, 32) | ((CASE WHEN v < 32 THEN fp & 4294967295 ELSE shiftrightunsigned(fp, 32) END) & ~shiftleft(1L, CAST(v % 32 AS INT)))")
    variants = prints.select("fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("v")).select(variant.alias("key"), "fp")
    buckets = materialize(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    pairs = buckets.where(f"n = 2 AND bit_count(a ^ b) <= {MAX_BITS}").select("a", "b").distinct()
    crowded = buckets.where("n > 2").select("key")
    members = variants.join(maybe_broadcast(crowded), "key", "left_semi").select("fp").distinct()
    flips = F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))")
    near = members.select("fp", flips.alias("near")).groupBy("near").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    stars = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b").distinct()
    return pairs.unionByName(stars)


def text_pairs(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """Pairs (a, b, n) of the ``xxhash64`` of texts whose fingerprints are linked: of a print's texts each with the smallest, and
    the smallest of two prints with a direct link; ``n`` counts the texts that meet ``b``."""
    rows = materialize(docs.select(F.xxhash64(text_col).alias("node"), fingerprint_of(F.col(text_col), words).alias("fp")).distinct(), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("node").alias("b")), "distinct_fingerprints")
    inside = rows.join(prints, "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    first, second = (prints.select(F.col("fp").alias(k), F.col("b").alias(v)) for k, v in (("a", "y"), ("b", "x")))
    pairs = materialize(inside.unionByName(link(prints.select("fp")).join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct(), "print_pairs")
    return pairs.join(pairs.groupBy("b").agg(F.count("*").alias("n")), "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """A row per document: id, ``fp`` (signed long), ``component_id`` and the text's ``text_hash``."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), fingerprint_of(F.col(text_col), words).alias("fp")), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct_fingerprints")
    parts = connected_components(link(prints.select("fp")), "a", "b").withColumnRenamed("node", "fp")
    rooted = prints.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    named = rooted.join(firsts, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "text_hash")


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
