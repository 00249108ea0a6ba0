"""Exact dedup against an immutable snapshot, screened by static binary-fuse filters.

The snapshot's digests are dealt to buckets by hash and each bucket gets one binary-fuse filter (Graf and Lemire,
2022). A snapshot is immutable: its groups and filters are made once and can be stored (``Snapshot.write``). A batch's
digests are grouped among themselves first; those that their bucket's filter passes are joined with the snapshot's
exact groups, the others need no join. Groups of more than one row are then checked byte by byte: their normalised
texts, and only theirs, are grouped as they are (combined before the shuffle), so equal digests never decide alone.

Defined cases: a null text is an empty one; the largest id of equal texts stays (rows with a null id never do, unless
the whole group has none: then each row of it reports a null keep_id and is kept); repeated rows share a keep_id and
are all marked kept if it is theirs; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import fresh, lower_ascii, materialize, maybe_broadcast, text_of

BUCKET_KEYS = 32_768
FILTER_SCHEMA = "bucket long, seed long, segment long, segments long, slots binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Murmur3's 64-bit finaliser of key + seed."""
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment) >> np.uint64(32)).astype(np.int64)
    low = h.astype(np.int64) & 0x3FFFFFFF
    mask = segment - 1
    return np.stack([first, (first + segment) ^ ((low >> 15) & mask), (first + 2 * segment) ^ (low & mask)], axis=1)


def _tag(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(40))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, slots) of distinct uint64 keys, about 9 bits a key; peeled layer by layer."""
    n = len(keys)
    segment = 4 if n < 2 else 1 << min(18, max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
    room = int(np.ceil(n * (2.0 if n < 2 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)))))
    segments = max(1, -(-room // segment) - 2)
    for seed in range(1, 1000):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        at = _slots(h, segment, segments)
        size = (segments + 2) * segment
        count, alive, layers = np.bincount(at.ravel(), minlength=size), np.arange(n), []
        while len(alive):
            single = count[at[alive]] == 1
            peel = single.any(axis=1)
            if not peel.any():
                break
            gone = alive[peel]
            layers.append((gone, single[peel].argmax(axis=1)))
            count -= np.bincount(at[gone].ravel(), minlength=size)
            alive = alive[~peel]
        if not len(alive):
            slots, tags = np.zeros(size, np.uint8), _tag(h)
            for gone, own in reversed(layers):
                s = at[gone]
                mine = s[np.arange(len(gone)), own]
                slots[mine] = 0
                slots[mine] = tags[gone] ^ slots[s[:, 0]] ^ slots[s[:, 1]] ^ slots[s[:, 2]]
            return seed, segment, segments, slots.tobytes()
        if seed % 8 == 0:
            segments += max(1, segments // 8)
    raise ValueError("keys are not distinct")


def may_contain(keys: np.ndarray, seed: int, segment: int, segments: int, slots: bytes) -> np.ndarray:
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    s, at = np.frombuffer(slots, np.uint8), _slots(h, segment, segments)
    return (s[at[:, 0]] ^ s[at[:, 1]] ^ s[at[:, 2]]) == _tag(h)


def filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One filter for each bucket of the distinct ``digest`` (long) column."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["digest"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame([[pdf["bucket"].iloc[0], *build_filter(keys)]], columns=["bucket", "seed", "segment", "segments", "slots"])

    keyed = digests.select("digest", F.pmod("digest", F.lit(buckets)).alias("bucket"))
    return keyed.groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screen(fuses: DataFrame, digests: DataFrame, buckets: int) -> DataFrame:
    """(digest, maybe) for each of the distinct digests."""

    def probe(fuse: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["digest"].to_numpy(np.int64)
        hit = np.zeros(len(keys), bool)
        for f in fuse.itertuples():
            hit |= may_contain(keys.view(np.uint64), f.seed, f.segment, f.segments, f.slots)
        return pd.DataFrame({"digest": keys, "maybe": hit})

    keyed = digests.select("digest", F.pmod("digest", F.lit(buckets)).alias("bucket"))
    return fuses.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInPandas(probe, "digest long, maybe boolean")


KEY = ["digest", "sha", "bytes"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sha_bytes: int = 32) -> DataFrame:
    """(id, sha, bytes, digest) of the normalised texts; ``sha_bytes`` of SHA-256 are kept (fewer only in tests)."""
    text = lower_ascii(text_of(text_col))
    sha = F.unhex(F.sha2(text, 256))
    df = docs.select(F.col(id_col).alias("id"), (sha if sha_bytes == 32 else F.substring(sha, 1, sha_bytes)).alias("sha"), F.octet_length(text).alias("bytes"))
    return df.withColumn("digest", F.xxhash64("sha"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))


@dataclass
class Snapshot:
    """Groups (digest, sha, bytes, keep_id, n) of immutable rows, and the filters over their digests."""

    groups: DataFrame
    fuses: DataFrame
    buckets: int

    @staticmethod
    def of(rows: DataFrame, at_least: int = 0) -> Snapshot:
        """From rows made by ``digests``; with buckets for ``at_least`` rows that will come in, if these are more."""
        groups = materialize(_grouped(rows), "snapshot_groups")
        buckets = max(1, -(-max(groups.count(), at_least) // BUCKET_KEYS))
        return Snapshot(groups, materialize(filters(groups, buckets), "fuse_filters"), buckets)

    def write(self, path: str) -> None:
        self.groups.write.parquet(f"{path}/groups")
        self.fuses.withColumn("buckets", F.lit(self.buckets)).write.parquet(f"{path}/filters")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Snapshot:
        fuses = spark.read.parquet(f"{path}/filters")
        first = fuses.select("buckets").first()
        return Snapshot(spark.read.parquet(f"{path}/groups"), fuses.drop("buckets"), first.buckets if first else 1)


def match(snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """Groups (digest, sha, bytes, keep_id, group_size) of a snapshot and of a batch made by ``digests``."""
    old, new = snapshot.groups, materialize(_grouped(batch), "batch_groups")
    screened = screen(snapshot.fuses, new.select("digest").distinct(), snapshot.buckets)
    judged = materialize(new.join(screened, "digest"), "screened")
    maybe, fresh_ = judged.where("maybe").drop("maybe"), judged.where("NOT maybe")
    hits = old.join(maybe.select(*KEY, F.col("keep_id").alias("keep_new"), F.col("n").alias("n_new")), KEY, "full_outer")
    hits = hits.select(*KEY, F.greatest("keep_id", "keep_new").alias("keep_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("n_new", F.lit(0))).alias("group_size"))
    return hits.unionByName(fresh_.select(*KEY, "keep_id", F.col("n").alias("group_size")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sha_bytes: int = 32) -> DataFrame:
    """A row per document; the older half of the id range is the snapshot, the rest the incoming batch."""
    rows = materialize(digests(docs, id_col, text_col, sha_bytes), "digests")
    ends = rows.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).first()
    middle = (ends.a + ends.b) // 2 if ends.a is not None else 0
    old = F.coalesce(F.col("id") <= middle, F.lit(False))
    groups = materialize(match(Snapshot.of(rows.where(old), ends.n // 2), rows.where(~old)), "groups")

    # Byte check: the texts of rows that share a digest, grouped as they are.
    many = groups.where("group_size > 1").select(*KEY)
    text = lower_ascii(text_of(text_col))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    own = F.unhex(F.sha2(F.col("text"), 256))
    texts = texts.withColumn("sha", own if sha_bytes == 32 else F.substring(own, 1, sha_bytes)).withColumn("bytes", F.octet_length("text"))
    texts = texts.withColumn("digest", F.xxhash64("sha")).join(maybe_broadcast(many), KEY, "left_semi")
    same = materialize(texts.groupBy(*KEY, "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "same_bytes")
    torn = same.groupBy(*KEY).agg(F.count("*").alias("n_texts")).where("n_texts > 1").select(*KEY)
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    cols = [F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256"]
    named = rows.withColumn("text_sha256", F.lower(F.hex("sha")))
    if torn.isEmpty():
        return named.join(groups, KEY).select(*cols)
    # Different texts under one digest: their rows go by the text itself.
    whole = named.join(torn, KEY, "left_anti").join(groups, KEY).select(*cols)
    apart = texts.join(torn, KEY, "left_semi").withColumn("text_sha256", F.sha2("text", 256)).join(same.select(*KEY, "text", "keep_id", "group_size"), [*KEY, "text"])
    return whole.unionByName(apart.select(*cols))


def without_copies(docs: DataFrame) -> DataFrame:
    """Documents whose row stays, with their columns."""
    one, two, own = fresh(docs, "_id"), fresh(docs, "_sha"), fresh(docs, "_own")
    gone = exact_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(one), F.col("text_sha256").alias(two)).distinct()
    keyed = docs.withColumn(own, F.sha2(lower_ascii(text_of()), 256))
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(own) == F.col(two)), "left_anti").drop(own)


def op3(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
