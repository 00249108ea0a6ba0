"""Merkle manifest of a dataset: roots, and for each row the proof that leads from its digest to the root.

Rows are leaves of one tree for each group (``by``), in the order of their ids; the groups' roots are leaves of one more
tree. Leaves lie in aligned blocks of consecutive places. Blocks climb by a butterfly exchange: in round r a block swaps
its subtree's digest with blocks of the other subtrees in its aligned group of ``fanout``, and every block hashes the
ancestor itself. So after the last round each block holds its group's root and all siblings on its way up, and no
digest is sent down again. Where the last subtree is ragged, its blocks take turns in answering those that have no
partner at their own place.

Rows are numbered by a range partitioning and the counts of its slices; groups of any size are spread over slices and
blocks, so none lands in one task. A round moves one row for each block, and up to ``fanout`` - 1 more to its partners.

Defined cases: a null value is hashed as ``-``; a null id or group comes first; rows with one id are ordered by their
digest, repeated rows have places of their own next to each other; empty and long texts are hashed whole; an empty table
gives no row; columns that are not hashed are not looked at, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import discard, materialize, maybe_broadcast

#: What a row's digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEAVES = 4096
STEP = "struct<left:string,right:string>"


def digest_of(*values: Column) -> Column:
    """SHA-256 of the values, each as ``-`` if null, else its byte count, a colon and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def _sha(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(leaves: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The nodes of each level; ``height`` levels above the leaves, or as many as lead to one node."""
    levels = [leaves]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_sha(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def _numbered(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``df`` with ``_i``, the place of each row among those of its group in ascending order, and ``_n``, how many these are."""
    ranged = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    at = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    at = at.withColumn("_slice", F.shiftright("_at", 33))
    slices = at.groupBy("_slice", F.col(by).alias("_by")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    so_far = Window.partitionBy("_by").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_by")
    slices = slices.withColumns({"_skip": F.coalesce(F.sum("_rows").over(so_far), F.lit(0)) - F.col("_first"), "_n": F.sum("_rows").over(whole)})
    slices = materialize(slices.select(F.col("_slice").alias("_slice2"), "_by", "_skip", "_n"), "slices")
    found = at.join(maybe_broadcast(slices), (F.col("_slice") == F.col("_slice2")) & F.col(by).eqNullSafe(F.col("_by")))
    return found.withColumn("_i", F.col("_at") + F.col("_skip")).drop("_at", "_slice", "_slice2", "_by", "_skip")


def _exchanged(blocks: DataFrame, by: str, fanout: int) -> DataFrame:
    """Blocks (by, block, blocks, node) climb to their groups' roots: ``node`` becomes the root, ``proof`` the way from the block."""
    at = materialize(blocks.withColumn("proof", F.array().cast(f"array<{STEP}>")), "round")
    most = at.agg(F.max("blocks")).first()[0] or 0
    size = 1
    while size < most:
        mine = F.floor(F.col("block") / size)
        known = at.withColumns({"own": mine, "low": F.col("block") % size, "nodes": F.ceil(F.col("blocks") / size)})
        first = F.col("own") - F.col("own") % fanout
        partners = F.filter(F.sequence(first, F.least(first + fanout, F.col("nodes")) - 1), lambda q: q != F.col("own"))
        held = lambda place: F.least(F.lit(size), F.col("blocks") - place * size)
        sent = known.withColumn("to", F.explode(partners)).withColumns({"mine": held(F.col("own")), "theirs": held(F.col("to"))}).where("low < theirs")
        sent = sent.withColumn("place", F.explode(F.sequence(F.col("low").cast("long"), F.col("theirs").cast("long") - 1, F.col("mine").cast("long"))))
        none = F.lit(None)
        sent = sent.select(by, (F.col("to") * size + F.col("place")).alias("block"), "own", "node", none.cast("long").alias("blocks"), none.cast(at.schema["proof"].dataType).alias("proof"), none.cast("long").alias("self"))
        kept = known.select(by, "block", "own", "node", "blocks", "proof", F.col("own").alias("self"))
        one = lambda c: F.first(c, ignorenulls=True).alias(c)
        met = kept.unionByName(sent).groupBy(by, "block").agg(F.sort_array(F.collect_list(F.struct("own", "node"))).alias("met"), one("blocks"), one("proof"), one("self"))
        text = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda x: x["node"]), "")
        step = F.struct(text(lambda x: x["own"] < F.col("self")).alias("left"), text(lambda x: x["own"] > F.col("self")).alias("right"))
        climbs = F.col("blocks") > size
        new = met.select(
            by, "block", "blocks",
            F.when(climbs, F.sha2(text(lambda x: F.lit(True)), 256)).otherwise(F.element_at("met", 1)["node"]).alias("node"),
            F.when(climbs, F.concat("proof", F.array(step))).otherwise(F.col("proof")).alias("proof"),
        )
        old, at = at, materialize(new, "round")
        discard(old)
        size *= fanout
    return at


def _proved(leaves: DataFrame, by: str, fanout: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(numbered leaves with their block of ``height`` levels, blocks with their root and the proof above them)."""
    block = fanout**height
    at = leaves.withColumns({"_block": F.floor(F.col("_i") / block), "_blocks": F.ceil(F.col("_n") / block)})
    kind = dict(leaves.dtypes)[by]

    def root(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = int(pdf["_blocks"].iat[0])
        levels = _levels(pdf.sort_values("_i")["leaf"].tolist(), fanout, height if blocks > 1 else None)
        return pd.DataFrame({"by": [key[0]], "block": [key[1]], "blocks": [blocks], "node": [levels[-1][0]]})

    roots = at.select(by, "_block", "_blocks", "_i", "leaf").groupBy(by, "_block").applyInPandas(root, f"by {kind}, block long, blocks long, node string")
    return at, _exchanged(roots.withColumnRenamed("by", by), by, fanout)


def _assembled(at: DataFrame, above: DataFrame, by: str, fanout: int, height: int) -> DataFrame:
    """Leaves with the whole proof: that inside their block and that of the block; ``above``: (by, block, proof, ...)."""
    step = pa.struct([("left", pa.string()), ("right", pa.string())])
    more = [c for c in above.columns if c not in (by, "block", "proof")]
    given = [c for c in at.columns if not c.startswith("_")]
    schema = ", ".join([*[f"`{c}` {dict(at.dtypes)[c]}" for c in given], *[f"`{c}` {dict(above.dtypes)[c]}" for c in more], f"proof array<{STEP}>"])

    def prove(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows = rows.sort_by("_i")
        levels = _levels(rows["leaf"].to_pylist(), fanout, height if rows["_blocks"][0].as_py() > 1 else None)[:-1]
        left, right, base, place = [], [], [], np.arange(len(rows))
        for nodes in levels:
            base.append(len(left) + place)
            place = place // fanout
            for i in range(len(nodes)):
                start = i - i % fanout
                left.append("".join(nodes[start:i]))
                right.append("".join(nodes[i + 1 : start + fanout]))
        for s in top["proof"][0].as_py():
            base.append(np.full(len(rows), len(left)))
            left.append(s["left"])
            right.append(s["right"])
        index = pa.array(np.stack(base, axis=1).ravel() if base else np.zeros(0, np.int64))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()).take(index), pa.array(right, pa.string()).take(index)], fields=list(step))
        proof = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(len(base))), steps)
        wide = [pa.repeat(top[c][0], len(rows)) for c in more]
        return pa.table([*[rows[c] for c in given], *wide, proof], names=[*given, *more, "proof"])

    return at.groupBy(by, "_block").cogroup(above.groupBy(by, "block")).applyInArrow(prove, schema)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "lang", order: str = "doc_id", fanout: int = 2, block: int = BLOCK_LEAVES, carry: dict[str, Column] | None = None) -> DataFrame:
    """(order, by, carried columns, leaf, subroot, root, proof) of each row; ``block``: most leaves of a block.

    ``proof``: the siblings' digests to the left and right, level by level up to the root (see ``folded``).
    """
    if fanout < 2:
        raise ValueError("the fanout must be 2 or more")
    height = max(1, int(np.log(block) / np.log(fanout) + 1e-9))
    leaves = docs.select(F.col(order).alias("id"), F.col(by).alias("part"), digest_of(*map(F.col, fields)).alias("leaf"), *[v.alias(k) for k, v in (carry or {}).items()])
    # The salt deals out rows that are alike in everything.
    leaves = materialize(leaves.withColumn("_salt", F.monotonically_increasing_id()), "leaves")
    at = _numbered(leaves, "part", ["id", "leaf", "_salt"]).drop("_salt")
    at, tops = _proved(at, "part", fanout, height)
    roots = tops.where("block = 0").select(F.lit(0).alias("all"), F.col("part").alias("lang"), F.col("node").alias("leaf"))
    high, peak = _proved(_numbered(roots, "all", ["lang"]), "all", fanout, height)
    high = _assembled(high, peak.select("all", "block", F.col("node").alias("root"), "proof"), "all", fanout, height)
    high = materialize(high.select("lang", "root", F.col("proof").alias("rest")), "roots")
    above = tops.join(maybe_broadcast(high), F.col("part").eqNullSafe(F.col("lang")))
    above = above.select("part", "block", F.col("node").alias("subroot"), "root", F.concat("proof", "rest").alias("proof"))
    return _assembled(at, above, "part", fanout, height).withColumnsRenamed({"id": order, "part": by})


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a digest leads to by a proof."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def op12(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, and what the roots become where a row's n_chars was raised by 1."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    raised = [F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    found = manifest(docs, carry={"found": F.when(hit, digest_of(*raised)).otherwise(digest_of(*map(F.col, FIELDS)))})
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.withColumn("folded_root", folded(F.col("found"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels of all trees by recursion, in the group's trees first; 3988292384 is CRC-32's polynomial.
OP12_SQL = """
WITH RECURSIVE
crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT *, row_number() OVER () AS r, doc_id::VARCHAR AS k, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ord(k[j])::BIGINT) AS b FROM (SELECT doc_id, source, lang, n_chars, text, doc_id::VARCHAR AS k FROM documents)),
f AS (SELECT *, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 7 = 0 AS hit,
    concat(coalesce(strlen(k) || ':' || k, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM d, crc),
e AS (SELECT doc_id, lang, r, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || CASE WHEN hit THEN coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') ELSE coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') END || tail) AS altered FROM f),
leaves AS (SELECT *, coalesce('x' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM e),
low AS (
    SELECT g, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
    UNION ALL
    SELECT g, any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY g, i // 2),
subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i FROM low WHERE n = 1),
high AS (
    SELECT 0 AS level, i, h, count(*) OVER () AS n FROM subs
    UNION ALL
    SELECT any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY i // 2),
steps AS (
    SELECT r, a.level, b.h, b.i < a.i AS is_left FROM (SELECT r, leaves.g, level, leaves.i >> level AS i FROM leaves JOIN low ON low.g = leaves.g AND low.i = leaves.i >> level) a LEFT JOIN low b ON b.g = a.g AND b.level = a.level AND b.i <> a.i AND b.i // 2 = a.i // 2 WHERE a.level < (SELECT max(level) FROM low l WHERE l.g = a.g)
    UNION ALL
    SELECT r, 1000 + a.level, b.h, b.i < a.i FROM (SELECT r, level, subs.i >> level AS i FROM leaves JOIN subs ON subs.g = leaves.g JOIN high ON high.i = subs.i >> level) a LEFT JOIN high b ON b.level = a.level AND b.i <> a.i AND b.i // 2 = a.i // 2 WHERE a.level < (SELECT max(level) FROM high)),
proofs AS (SELECT r, sha256(string_agg(coalesce(h, ''), '' ORDER BY level)) AS proof_sha256, list(struct_pack(h := coalesce(h, ''), is_left := coalesce(is_left, false)) ORDER BY level) AS way FROM steps GROUP BY r),
climb AS (
    SELECT leaves.r, altered AS h, coalesce(way, []) AS way, 0 AS k FROM leaves LEFT JOIN proofs ON proofs.r = leaves.r
    UNION ALL
    SELECT r, sha256(CASE WHEN way[k + 1].is_left THEN way[k + 1].h || h ELSE h || way[k + 1].h END), way, k + 1 FROM climb WHERE k < len(way)),
top AS (SELECT h FROM high WHERE n = 1)
SELECT doc_id, leaf, subs.h AS subroot, top.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, climb.h AS folded_root, climb.h = top.h AS verified
FROM leaves JOIN subs ON subs.g = leaves.g LEFT JOIN proofs ON proofs.r = leaves.r JOIN climb ON climb.r = leaves.r AND climb.k = len(climb.way), top
"""
