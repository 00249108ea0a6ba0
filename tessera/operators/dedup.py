"""Removal and fusion of duplicate detections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.operators.components import components
from tessera.operators.spatial import CELL, overlapping_pairs, with_cells
from tessera.operators.storage import discard, materialize, maybe_broadcast, tasks

KEY = ["raster_id", "class_id"]


def owned(detections: DataFrame, cores: DataFrame) -> DataFrame:
    """Detections whose centre lies in their tile's core, half-open: each place has one owner."""
    cx, cy = B.centre(B.cols())
    df = detections.join(cores.select("raster_id", "tile_id", "cx1", "cy1", "cx2", "cy2"), ["raster_id", "tile_id"])
    return df.where((cx >= F.col("cx1")) & (cx < F.col("cx2")) & (cy >= F.col("cy1")) & (cy < F.col("cy2"))).select(*detections.columns)


def greedy(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Greedy choice over conflicts (winner, loser): (losers, winners that took them).

    A node that loses to no open node is kept and drops its losers; then again, until no edge is left. This equals
    the one-by-one scan, as a decision depends on higher ranks only. Rounds: the longest chain of dependent decisions.
    """
    open_ = materialize(edges.select("winner", "loser"), "conflicts")
    gone: DataFrame | None = None
    while True:
        heads = open_.select("winner").distinct().join(open_.select(F.col("loser").alias("winner")).distinct(), "winner", "left_anti")
        lost = materialize(open_.join(heads, "winner", "left_semi").select("loser", "winner").distinct(), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        if lost.isEmpty():
            discard(open_)
            return gone.select("loser").distinct(), gone
        dead = lost.select("loser").distinct()
        left = open_.join(dead, "loser", "left_anti").join(dead.withColumnRenamed("loser", "winner"), "winner", "left_anti")
        old, open_ = open_, materialize(left.select("winner", "loser"), "conflicts")
        discard(old)


def conflicts(detections: DataFrame, threshold: float, inclusive: bool = False, rank: str = "score", key: list[str] | None = None) -> DataFrame:
    """(winner, loser) of overlapping pairs; rank: score (descending, then id) or id."""
    pairs = overlapping_pairs(detections, key or KEY, threshold, inclusive, carry=() if rank == "id" else ("score",))
    if rank == "id":
        return pairs.select(F.col("a").alias("winner"), F.col("b").alias("loser"), "iou")
    first = F.col("a_score") >= F.col("b_score")  # a < b: of equal scores the lower id wins
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser"), "iou")


def nms(detections: DataFrame, threshold: float = 0.5, inclusive: bool = False, key: list[str] | None = None) -> DataFrame:
    """Exact greedy non-maximum suppression in a raster and class (or ``key``), in parallel rounds."""
    losers, _ = greedy(conflicts(detections, threshold, inclusive, key=key))
    return detections.join(losers.withColumnRenamed("loser", "det_id"), "det_id", "left_anti").select(*detections.columns)


def merge_clusters(detections: DataFrame, threshold: float = 0.5, edge: str | None = None) -> DataFrame:
    """Seeds in input order take all unused boxes at IoU >= threshold to the seed; weighted mean box, best score."""
    edges = materialize(conflicts(detections, threshold, True, "id").select("winner", "loser"), "overlaps")
    losers, _ = greedy(edges)
    # The first seed takes a box, whichever round decided it.
    seeds = edges.join(losers.withColumnRenamed("loser", "winner"), "winner", "left_anti")
    seed = seeds.groupBy("loser").agg(F.min("winner").alias("seed")).withColumnRenamed("loser", "det_id")
    w = F.col("score") * (F.when(F.col(edge), 0.5).otherwise(1.0) if edge else 1.0)
    df = detections.join(seed, "det_id", "left").withColumn("seed", F.coalesce("seed", "det_id")).withColumn("_w", w)
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("_w")), F.sum("_w")), F.avg(c))
    return df.groupBy("seed", *KEY).agg(*[mean(c).alias(c) for c in ("x1", "y1", "x2", "y2")], F.max("score").alias("score"), F.count("*").alias("n")).withColumnRenamed("seed", "det_id")


#: Edges up to which a component is scanned by one task, in a stream that keeps the ids of dropped boxes only.
SCAN_EDGES = 1_000_000


def scanned(edges: DataFrame, most: int = SCAN_EDGES) -> DataFrame:
    """Ids (``loser``) that a scan by rank drops, of conflicts (first, second, s1, s2, later): s, then the id, is a box's rank,
    ``first`` ranks before ``second``, and ``later`` tells that the second box wins.

    The scan takes boxes by rank. One that was not dropped before goes through its later conflicts in order and drops each
    that still stands, up to the first that wins against it: then it goes itself, and what it has dropped stays dropped.
    Components of the conflicts are independent. Sorted by component and rank, their edges pass through a small state
    machine, many components in a task. Components of over ``most`` edges are resolved in rounds over all tasks: a box
    takes its turn when no earlier box can still drop it or one of its later conflicts.
    """
    at = materialize(edges.select("first", "second", "s1", "s2", "later"), "conflicts")
    found = components(at.select(F.col("first").alias("a"), F.col("second").alias("b")))
    at = at.join(found.withColumnRenamed("node", "first"), "first", "left").withColumn("component", F.coalesce("component", "first"))
    wide = materialize(at.groupBy("component").count().where(F.col("count") > most).select("component"), "wide")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, gone = None, set()
        for b in batches:
            out = []
            for component, i, j, later in zip(b["component"].tolist(), b["first"].tolist(), b["second"].tolist(), b["later"].tolist()):
                if component != here:
                    here, gone = component, set()
                if i not in gone and j not in gone:
                    out.append(i if later else j)
                    gone.add(out[-1])
            yield pd.DataFrame({"loser": out}, dtype="int64")

    rank = ["s1", "first", "s2", "second"]
    one = at.join(wide, "component", "left_anti").repartition("component").sortWithinPartitions("component", *rank)
    lost = one.select("component", "first", "second", "later").mapInPandas(run, "loser long")
    return lost if wide.isEmpty() else lost.unionByName(_in_rounds(at.join(wide, "component", "left_semi").drop("component")))


def _in_rounds(edges: DataFrame) -> DataFrame:
    """``scanned`` for large components."""
    open_ = materialize(edges, "open")
    gone: DataFrame | None = None
    rank = lambda k: F.struct(f"s{k}", "first" if k == 1 else "second")
    while not open_.isEmpty():
        heads = open_.groupBy("second").agg(F.min(rank(1)).alias("head"))
        # Not yet: a box with an earlier conflict, or with a later one that an earlier box looks at first.
        waits = open_.join(heads, "second").where(F.col("head") < rank(1)).select("first").unionByName(heads.select(F.col("second").alias("first"))).distinct()
        turn = open_.join(waits, "first", "left_anti")
        stop = turn.where("later").groupBy("first").agg(F.min(rank(2)).alias("stop"))
        hit = turn.join(stop, "first", "left")
        took = hit.where(F.col("stop").isNull() | (rank(2) < F.col("stop"))).select(F.col("second").alias("loser"))
        done = materialize(took.withColumn("drops", F.lit(True)).unionByName(stop.select(F.col("first").alias("loser"), F.lit(True).alias("drops"))).unionByName(turn.select(F.col("first").alias("loser"), F.lit(False).alias("drops"))).distinct(), "done")
        lost = done.where("drops").select("loser")
        gone = lost if gone is None else gone.unionByName(lost)
        seen = done.select("loser").distinct()
        left = open_.join(seen.withColumnRenamed("loser", "first"), "first", "left_anti").join(lost.withColumnRenamed("loser", "second"), "second", "left_anti")
        old, open_ = open_, materialize(left.select(*edges.columns), "open")
        discard(old)
    return edges.select(F.col("first").alias("loser")).limit(0) if gone is None else gone.distinct()


def merge_preferring_inner(detections: DataFrame, threshold: float = 0.45, most: int = SCAN_EDGES) -> DataFrame:
    """Scan by score (then id): of overlapping boxes (IoU > threshold) of a raster and class one off the edge beats one on it,
    else the one farther from it wins, else the one scanned first. A box that loses has dropped those before."""
    pairs = overlapping_pairs(detections, KEY, threshold, carry=("edge", "border_dist", "score"))
    ahead = F.col("a_score") >= F.col("b_score")
    first, second = (lambda c: F.when(ahead, F.col(f"a{c}")).otherwise(F.col(f"b{c}"))), (lambda c: F.when(ahead, F.col(f"b{c}")).otherwise(F.col(f"a{c}")))
    later = (first("_edge") & ~second("_edge")) | ((first("_edge") == second("_edge")) & (second("_border_dist") > first("_border_dist")))
    edges = pairs.select(first("").alias("first"), second("").alias("second"), (-first("_score")).alias("s1"), (-second("_score")).alias("s2"), later.alias("later"))
    return detections.join(scanned(edges, most).withColumnRenamed("loser", "det_id"), "det_id", "left_anti").select(*detections.columns)


#: How much a box far from its tile's border weighs more, and what keeps the sum of weights above 0.
BORDER_ALPHA, TINY = 0.5, 1e-12


#: Boxes up to which a raster's class, or a group of a larger one that fuses, is folded by one task.
FOLD_BOXES = 20_000
#: Boxes nearby up to which they are looked at one by one.
NEAR = 64
XY = ("x1", "y1", "x2", "y2")
#: A box as it was from one place in the order (exclusive; null: from the start) to another (inclusive; null: to the end).
LAST = "det_id long, x1 double, y1 double, x2 double, y2 double, score double, border_dist double, edge boolean, tile_id int, n int"
VERSION = "_group long, det_id long, from_batch long, from_id long, to_batch long, to_id long, x1 double, y1 double, x2 double, y2 double, score double, border_dist double, edge boolean, tile_id int, n int"


def fuse_batches(detections: DataFrame, threshold: float = 0.45, most: int = FOLD_BOXES) -> DataFrame:
    """Batches are folded into the set one by one: a box joins the first box of its class at IoU >= threshold (above 0).

    Boxes are averaged by score * (1 + border distance / 2); the best score stays, ``edge`` only if both are on it, the
    tile of the heavier one. ``border_dist``, ``edge`` and ``tile_id`` may be missing. ``n`` counts a box's parts; its id is
    its first part's.

    The fold follows (batch, id) in each raster and class. Those of up to ``most`` boxes are folded as they are, many in a
    task. In larger ones boxes that never meet may be folded apart. Groups grow from single boxes: each is folded alone, and every box keeps a version for each change, with the time for which it held. A box that meets a
    version of another group at its own time shows that the two are one; they are joined and folded again, until no box
    meets another group. Then, by induction over the order, the groups' folds together are the whole fold. Where a group
    gets over ``most`` boxes, the earlier half of the order is folded before the later one, and so on: earlier boxes do
    not depend on later ones, and fewer boxes to come tie fewer groups together.
    """
    fill = {"border_dist": F.lit(0.0), "edge": F.lit(False), "tile_id": F.lit(None).cast("int")}
    given = detections.columns
    full = detections.withColumns({c: v for c, v in fill.items() if c not in given})
    full = materialize(full.withColumns({"n": F.lit(1), "_new": F.lit(True)}), "boxes")
    sizes = materialize(full.groupBy(*KEY).agg(F.count("*").alias("size")), "sizes")
    large = sizes.where(F.col("size") > most).select(*KEY)
    rows = sizes.agg(F.sum("size")).first()[0] or 0
    if large.isEmpty():
        return _folded_whole(full, threshold, rows).select(*given, "n")
    large = maybe_broadcast(large)
    small = _folded_whole(full.join(large, KEY, "left_anti"), threshold, rows)
    wide = materialize(full.join(large, KEY, "left_semi"), "large")
    return small.unionByName(_folded(None, wide, threshold, most)).select(*given, "n")


def _folded_whole(boxes: DataFrame, threshold: float, rows: int) -> DataFrame:
    """The boxes (about ``rows``) after each raster's class was folded by itself."""
    dealt = boxes.select(*KEY, *_typed_boxes()).repartition(tasks(boxes, rows), *KEY).sortWithinPartitions(*KEY, "batch_no", "det_id")
    last = dealt.mapInPandas(lambda b: _fold_all(b, threshold, len(KEY), True), LAST)
    return boxes.drop(*last.columns[1:]).join(last.hint("merge"), "det_id").select(*boxes.columns)


def _typed_boxes() -> list[Column]:
    doubles = [F.col(c).cast("double").alias(c) for c in (*XY, "score", "border_dist")]
    return ["_new", F.col("batch_no").cast("long").alias("batch_no"), F.col("det_id").cast("long").alias("det_id"), *doubles, "edge", "tile_id", "n"]


def _folded(done: DataFrame | None, coming: DataFrame, threshold: float, most: int) -> DataFrame:
    """The boxes of ``done``, none of them in another yet, after ``coming`` was folded into them."""
    boxes = coming if done is None else materialize(done.unionByName(coming), "boxes")
    order = lambda new: [F.when(new, F.col(c).cast("long")) for c in ("batch_no", "det_id")]
    at = boxes.withColumn("_group", F.col("det_id"))
    start, none = order(F.col("_new")), F.lit(None).cast("long")
    ended = {"from_batch": start[0], "from_id": start[1], "to_batch": none, "to_id": none}
    versions = at.withColumns(ended).selectExpr(*[f"CAST({c} AS {t}) AS {c}" for c, t in (x.split() for x in VERSION.split(", "))])
    label = stored = None
    while True:
        known = at.select(*KEY, "det_id", "_group")
        held = with_cells(versions.join(known.select(*KEY, "det_id"), "det_id").select(*KEY, F.col("_group").alias("_other"), "from_batch", "from_id", "to_batch", "to_id", *[F.col(c).alias(f"v{c}") for c in XY]), B.cols("v"))
        new = with_cells(at.where("_new").select(*KEY, "_group", F.col("batch_no").cast("long").alias("_b"), F.col("det_id").alias("_i"), *XY), B.cols())
        then = F.struct("_b", "_i")
        meet = (F.col("from_batch").isNull() | (F.struct("from_batch", "from_id") < then)) & (F.col("to_batch").isNull() | (then <= F.struct("to_batch", "to_id")))
        pairs = new.join(held.hint("merge"), [*KEY, "gx", "gy"]).where((F.col("_group") != F.col("_other")) & meet & (B.iou(B.cols("v"), B.cols()) >= threshold))
        met = materialize(pairs.select(F.col("_group").alias("a"), F.col("_other").alias("b")).distinct(), "met")
        if met.isEmpty():
            last = versions.where("to_id IS NULL").select("det_id", *XY, "score", "border_dist", "edge", "tile_id", "n")
            return boxes.drop(*last.columns[1:]).join(last, "det_id").select(*boxes.columns)
        joined = components(met)
        joined = materialize(joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct()), "joined")
        moved = at.select("det_id", "_group").join(joined, F.col("_group") == F.col("node")).select("det_id", F.col("component").alias("_group"))
        if label is not None:
            moved = moved.unionByName(label.join(joined, F.col("_group") == F.col("node"), "left_anti"))
        old, label = label, materialize(moved, "groups")
        if old is not None:
            discard(old)
        at = boxes.join(label, "det_id", "left").withColumn("_group", F.coalesce("_group", "det_id"))
        sizes = label.join(boxes.select("det_id", "_new"), "det_id").groupBy("_group").agg(F.count("*").alias("size"), F.sum(F.col("_new").cast("int")).alias("news"))
        if not sizes.where((F.col("size") > most) & (F.col("news") > 1)).isEmpty():
            cut = _half(coming)
            early = materialize(_folded(done, coming.where(cut), threshold, most).withColumn("_new", F.lit(False)), "wave")
            return _folded(early, coming.where(~cut), threshold, most)
        busy = at.join(joined.select(F.col("component").alias("_group")).distinct(), "_group", "left_semi")
        busy = busy.select("_group", *_typed_boxes())
        again = busy.repartition("_group").sortWithinPartitions("_group", "_new", "batch_no", "det_id").mapInPandas(lambda b: _fold_all(b, threshold), VERSION)
        rest = versions.join(joined, F.col("_group") == F.col("node"), "left_anti")
        old, stored = stored, materialize(rest.unionByName(again), "versions")
        versions = stored
        for df in (met, joined, old):
            if df is not None:
                discard(df)


def _half(coming: DataFrame) -> Column:
    """Whether a box is in the earlier part by (batch, id); neither part is empty."""
    for c in ("batch_no", "det_id"):
        low, mid, high = coming.agg(F.min(c), F.percentile_approx(c, 0.5), F.max(c)).first()
        if low < high:
            return F.col(c) <= mid if mid < high else F.col(c) < high
    raise ValueError("ids must differ")


def _fold_all(batches: Iterator[pd.DataFrame], threshold: float, keys: int = 1, last: bool = False) -> Iterator[pd.DataFrame]:
    """Versions of the boxes of all groups (by the first ``keys`` columns), which come one after the other; done boxes first,
    then those to come, in order. ``last``: only the last version of each box, without group and time."""
    names = [c.split()[0] for c in VERSION.split(", ")]
    rows: list[tuple] = []
    here: tuple | None = None

    def folded() -> list[tuple]:
        out = _fold(rows, threshold)
        return [(r[0], *r[5:]) for r in out if r[4] is None] if last else [(here[0], *r) for r in out]

    def frame(out: list[tuple]) -> pd.DataFrame:
        whole = ("tile_id",) if last else ("from_batch", "from_id", "to_batch", "to_id", "tile_id")
        return pd.DataFrame(out, columns=[names[1], *names[6:]] if last else names).astype({c: "Int64" for c in whole})

    for b in batches:
        out = []
        for r in b.itertuples(index=False, name=None):
            if r[:keys] != here:
                out += folded() if rows else []
                rows, here = [], r[:keys]
            rows.append(r[keys:])
        yield frame(out)
    yield frame(folded() if rows else [])


def _fold(rows: list[tuple], threshold: float) -> list[tuple]:
    """The versions of one group's boxes, without the group. A box is compared with those that share a grid cell with it."""
    box = np.empty((len(rows), 4))
    kept: list[list] = []  # what else is known of each box, in the order in which they began
    cells: dict[tuple | None, set[int]] = {None: set()}  # the boxes in each cell; None: those over many cells
    out: list[tuple] = []

    def around(x1: float, y1: float, x2: float, y2: float) -> list:
        if not (-1e15 < x1 <= x2 < 1e15 and -1e15 < y1 <= y2 < 1e15):
            return [None]
        a, b, c, d = int(x1 // CELL), int(y1 // CELL), int(x2 // CELL), int(y2 // CELL)
        return [None] if (c - a + 1) * (d - b + 1) > NEAR else [(x, y) for x in range(a, c + 1) for y in range(b, d + 1)]

    def first(xy: list[float], at: list) -> int | None:
        """The first box at IoU >= threshold."""
        x1, y1, x2, y2 = xy
        near = set().union(cells[None], *[cells.get(c, ()) for c in at])
        if len(near) > NEAR or at[0] is None:
            m = len(kept)
            w = np.clip(np.minimum(box[:m, 2:], xy[2:]) - np.maximum(box[:m, :2], xy[:2]), 0, None)
            inter = w[:, 0] * w[:, 1]
            both = (box[:m, 2] - box[:m, 0]) * (box[:m, 3] - box[:m, 1]) + (x2 - x1) * (y2 - y1) - inter
            with np.errstate(invalid="ignore", divide="ignore"):
                hit = np.flatnonzero((both > 0) & (inter / both >= threshold))
            return int(hit[0]) if len(hit) else None
        for j in sorted(near):
            a1, b1, a2, b2 = kept[j][8]
            w, h = min(a2, x2) - max(a1, x1), min(b2, y2) - max(b1, y1)
            if w > 0 and h > 0:
                inter = w * h
                both = (a2 - a1) * (b2 - b1) + (x2 - x1) * (y2 - y1) - inter
                if both > 0 and inter / both >= threshold:
                    return j
        return None

    def put(j: int, xy: list[float], at: list) -> None:
        box[j] = xy
        for c in at:
            cells.setdefault(c, set()).add(j)

    def ended(j: int, batch: int | None, i: int | None) -> tuple:
        first_id, since, score, dist, edge, tile, n, _, xy = kept[j]
        return (first_id, *since, batch, i, *xy, score, dist, edge, tile, n)

    for new, batch, i, *xy, score, dist, edge, tile, n in rows:
        tile = None if tile is None or tile != tile else int(tile)
        at = around(*xy)
        j = first(xy, at) if new else None
        since = (batch, i) if new else (None, None)
        if j is None:
            put(len(kept), xy, at)
            kept.append([i, since, score, dist, edge, tile, n, at, xy])
            continue
        out.append(ended(j, batch, i))
        k = kept[j]
        p, q = k[2] * (1 + BORDER_ALPHA * k[3]), score * (1 + BORDER_ALPHA * dist)
        p_part, q_part = p / (p + q + TINY), q / (p + q + TINY)
        mean = [u * p_part + v * q_part for u, v in zip(k[8], xy)]
        for c in k[7]:
            cells[c].discard(j)
        at = around(*mean)
        put(j, mean, at)
        kept[j] = [k[0], since, max(k[2], score), k[3] * p_part + dist * q_part, k[4] and edge, k[5] if p >= q else tile, k[6] + n, at, mean]
    return out + [ended(j, None, None) for j in range(len(kept))]


def legacy_composition(detections: DataFrame, threshold: float = 0.45, tight: float = 0.3, least_score: float = 0.01) -> DataFrame:
    """Suppression in each batch, fold of the batches, then suppression at both thresholds and the last validity filter.

    Cluster merges between these steps find no pair left at their threshold, nor does the merge that prefers inner
    boxes after the tighter pass, so they are not run.
    """
    batches = nms(detections, threshold, True, [*KEY, "batch_no"])
    fused = materialize(fuse_batches(batches, threshold), "fused")
    # Pairs are sought once for both thresholds; the tighter pass sees those of which the first left both boxes.
    edges = materialize(conflicts(fused, min(threshold, tight), True), "overlaps")
    first, _ = greedy(edges.where(F.col("iou") >= threshold))
    left = edges.where(F.col("iou") >= tight).join(first, "loser", "left_anti").join(first.withColumnRenamed("loser", "winner"), "winner", "left_anti")
    second, _ = greedy(left)
    out = fused.join(first.unionByName(second).withColumnRenamed("loser", "det_id"), "det_id", "left_anti").select(*fused.columns)
    return out.where((F.col("score") >= least_score) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def signature(detections: DataFrame) -> DataFrame:
    """One hash of all coordinates of a raster, whatever the rows' order: an unchanged result needs no redraw."""
    one = F.xxhash64(*[F.round(c, 3) for c in ("x1", "y1", "x2", "y2", "score")], "class_id")
    return detections.groupBy("raster_id").agg(F.count("*").alias("n"), F.bit_xor(one).alias("sig"))


def changed(detections: DataFrame, last: DataFrame) -> DataFrame:
    """Rasters whose signature differs from that of ``last``, or that it lacks: the others need no redraw."""
    now, then = signature(detections), signature(last)
    return now.join(then, ["raster_id", "n", "sig"], "left_anti").select("raster_id")
