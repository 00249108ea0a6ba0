"""Human corrections as events: undo and redo, current state, exports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.storage import materialize, maybe_broadcast


#: Events of a slice of a session.
SLICE = 4096


def effective(events: DataFrame, size: int = SLICE) -> DataFrame:
    """Events that stand after undo and redo on a linear history; a push drops what could be redone.

    Undo and redo move a cursor over the history. A session is cut into slices of up to ``size`` events by a range
    partitioning, so a long one is spread over tasks. Each slice is summed up as a function of the cursor and the
    history's length before it (``Summary``); these are run through in order, which gives each slice its start and the place
    below which its events outlive all later slices; then the slices are replayed from their starts, apart.
    """
    order, columns = ["session_id", "seq"], events.columns
    at = materialize(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "events")
    at = at.withColumn("_slice", F.floor(F.col("_at") / size).cast("long"))
    long = at.groupBy("session_id").agg(F.min("_slice").alias("a"), F.max("_slice").alias("b")).where("a < b").select("session_id")
    key = ["session_id", "_slice"]

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*key).sortWithinPartitions(*key, "_at")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(batches, key):
            yield pd.DataFrame({"session_id": run["session_id"].iloc[:1], "_slice": run["_slice"].iloc[:1], "summary": [Summary.of(run["action"].tolist()).packed()]})

    def started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(batches, key[:1]):
            cursor = length = 0
            rows, kept = [], []
            for s in run["summary"]:
                rows.append((cursor, length))
                cursor, length, cut = Summary.unpacked(s)(cursor, length)
                kept.append(cut)
            below = cursor
            for i in range(len(rows) - 1, -1, -1):
                rows[i] += (below,)
                below = min(below, kept[i])
            yield run[key].assign(**dict(zip(("_cursor", "_length", "_below"), zip(*rows))))

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(batches, key):
            cursor, length, below = (run[c].iloc[0] for c in ("_cursor", "_length", "_below"))
            cursor, length, _, placed = replay(run["action"].tolist(), int(cursor or 0), int(length or 0))
            below = cursor if pd.isna(below) else min(length, int(below))
            yield run.iloc[sorted(i for p, i in placed.items() if p < below)][columns]

    kind = dict(events.dtypes)["session_id"]
    sums = dealt(at.join(long, "session_id", "left_semi").select(*key, "_at", "action")).mapInPandas(summed, f"session_id {kind}, _slice long, summary binary")
    starts = sums.repartition("session_id").sortWithinPartitions(*key).mapInPandas(started, f"session_id {kind}, _slice long, _cursor long, _length long, _below long")
    starts = materialize(starts, "starts")
    full = at.join(maybe_broadcast(starts), key, "left").withColumns({"_cursor": F.coalesce("_cursor", F.lit(0)), "_length": F.coalesce("_length", F.lit(0))})
    return dealt(full).mapInPandas(replayed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema))


def runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys, put together over the batches' ends."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if len(b):
            values = b[key].to_numpy()
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), len(b)]
            if held and (held[-1][key].to_numpy()[-1] != values[0]).any():
                yield pd.concat(held)
                held = []
            for i, j in zip(cuts, cuts[1:]):
                held.append(b.iloc[i:j])
                if j < len(b):
                    yield pd.concat(held) if len(held) > 1 else held[0]
                    held = []
    if held:
        yield pd.concat(held)


def replay(actions: list[str], cursor: int, length: int) -> tuple[int, int, int | None, dict[int, int]]:
    """(cursor, length, least place written, place -> index of the last event written there) of events after a start."""
    cut, placed = None, {}
    for i, action in enumerate(actions):
        if action == "undo":
            cursor = max(0, cursor - 1)
        elif action == "redo":
            cursor = min(length, cursor + 1)
        else:
            placed[cursor] = i
            cut = cursor if cut is None else min(cut, cursor)
            cursor = length = cursor + 1
    return cursor, length, cut, placed


@dataclass
class Summary:
    """A slice as a function of the cursor and the history's length before it.

    Moves before the first push are steps between two walls, which together move the cursor by ``step`` and hold it between
    where the walls' own places go: tabulated for histories shorter than the moves' range, beyond that as far from the
    walls as always. From the first push on all depends on where the cursor was then: tabulated for places less deep than
    the undos reach, beyond that as far from there as always.
    """

    step: int
    low: np.ndarray  # where the lower wall's place goes; the last entry holds for all longer histories
    high: np.ndarray  # the same of the upper wall, less the history's length
    pushes: np.ndarray  # cursor, length and cut, each less the place of the first push; the last column for all deeper ones

    @classmethod
    def of(cls, actions: list[str]) -> Summary:
        moves = [-1 if a == "undo" else 1 if a == "redo" else 0 for a in actions]
        first = next((i for i, m in enumerate(moves) if not m), len(moves))
        sums = np.cumsum([0, *moves[:first]])
        wall = np.arange(sums.max() - sums.min() + 1)
        low, high = np.zeros(len(wall), np.int64), wall.copy()
        for m in moves[:first]:
            low, high = np.clip(low + m, 0, wall), np.clip(high + m, 0, wall)
        if first == len(moves):
            return cls(int(sums[-1]), low, high - wall, np.zeros((3, 0), np.int64))
        # How deep the cursor gets below the first push if nothing stops it.
        deep = here = top = 0
        for m in moves[first:]:
            here, top = (min(top, here + m), top) if m else (here + 1, here + 1)
            deep = min(deep, here)
        start = np.arange(1 - deep)
        cursor, length, cut = start.copy(), start.copy(), start.copy()
        for m in moves[first:]:
            if m:
                cursor = np.clip(cursor + m, 0, length)
            else:
                cut = np.minimum(cut, cursor)
                cursor = cursor + 1
                length = cursor
        return cls(int(sums[-1]), low, high - wall, np.stack([cursor, length, cut]) - start)

    def __call__(self, cursor: int, length: int) -> tuple[int, int, int | float]:
        i = min(length, len(self.low) - 1)
        cursor = int(min(length + self.high[i], max(self.low[i], cursor + self.step)))
        if not self.pushes.shape[1]:
            return cursor, length, float("inf")
        return tuple(int(x) + cursor for x in self.pushes[:, min(cursor, self.pushes.shape[1] - 1)])

    def packed(self) -> bytes:
        return np.concatenate([[self.step, len(self.low)], self.low, self.high, self.pushes.ravel()]).astype(np.int64).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Summary:
        a = np.frombuffer(data, np.int64)
        n = int(a[1])
        return cls(int(a[0]), a[2 : 2 + n], a[2 + n : 2 + 2 * n], a[2 + 2 * n :].reshape(3, -1))


BOX = ("x1", "y1", "x2", "y2")


def current_state(detections: DataFrame, events: DataFrame) -> DataFrame:
    """Raw and added boxes as the effective events leave them; the raw rows themselves never change.

    ``events`` as they were recorded, with undo and redo; ``event_id`` orders them over sessions. Those that add or
    edit may carry the new box (``BOX``) and ``raster_id``. A deleted box keeps its last coordinates; an added one
    has score 1.0 and class ``manual``. An edit or deletion of an unknown id keeps a row, with nulls for what no
    event says.
    """
    done = effective(events)
    status = F.when(F.col("action") == "delete", "eliminated").when(F.col("action") == "edit", "edited").otherwise("added")
    boxed = [c for c in (*BOX, "raster_id") if c in events.columns]
    drawn = F.when(F.col("action") != "delete", F.col("event_id"))
    news = [F.max_by(c, F.when(F.col(c).isNotNull(), drawn)).alias(f"_{c}") for c in boxed]
    last = done.groupBy("det_id").agg(F.max_by(status, "event_id").alias("status"), F.max(F.col("action") == "add").alias("_added"), *news)
    both = detections.join(last, "det_id", "full")
    named = F.col("class_name") if "class_name" in detections.columns else F.concat(F.lit("c"), F.col("class_id"))
    both = both.withColumns({c: F.coalesce(f"_{c}", c) for c in boxed})
    both = both.withColumns({"score": F.when(F.col("_added"), 1.0).otherwise(F.col("score")), "class_name": F.when(F.col("_added"), "manual").otherwise(named)})
    return both.withColumn("status", F.coalesce("status", F.lit("not_corrected"))).drop("_added", *[f"_{c}" for c in boxed])


def added_boxes(events: DataFrame, detections: DataFrame) -> DataFrame:
    """A row per added box (``events`` with ``raster_id`` and ``BOX``): ids go on from the raster's greatest, in the order of
    the events; score 1.0, class ``manual``, status ``added``."""
    last = detections.groupBy("raster_id").agg(F.max("det_id").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("raster_id").orderBy("event_id"))
    df = events.where("action = 'add'").withColumn("_nth", nth).join(last, "raster_id", "left")
    new = (F.coalesce("_last", F.lit(-1)) + F.col("_nth")).cast("long")
    return df.select("raster_id", "event_id", new.alias("det_id"), *BOX, F.lit(1.0).alias("score"), F.lit("manual").alias("class_name"), F.lit("added").alias("status"))


def corrected_export(state: DataFrame, events: DataFrame, least_score: float, reviewer: str, day: str) -> DataFrame:
    """Visible boxes with reviewer and date, both mandatory; none unless some action happened, be it undone since."""
    if not reviewer or not day:
        raise ValueError("reviewer and date are mandatory")
    acted = events.where("action NOT IN ('undo', 'redo')").select(F.lit(True).alias("_acted")).limit(1)
    visible = state.where((F.col("status") != "eliminated") & (F.col("score") >= least_score)).join(F.broadcast(acted), F.lit(True), "left_semi")
    return visible.withColumns({"reviewer": F.lit(reviewer), "corrected_on": F.lit(day).cast("date")})


def upserted(models: DataFrame) -> DataFrame:
    """Of each name the newest row."""
    w = Window.partitionBy("model_name").orderBy(F.desc("created_at"))
    return models.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
