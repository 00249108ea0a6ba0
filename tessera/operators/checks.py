"""Checks of boxes, polygons and selections before they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.operators.saved import numbered
from tessera.operators.spatial import with_bounds


def finite(v: Column) -> Column:
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def overlay_boxes(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """Finite boxes of positive size, clamped to the image; those that lose their size by it go."""
    b = B.cols()
    good = finite(b[0]) & finite(b[1]) & finite(b[2]) & finite(b[3]) & (b[2] > b[0]) & (b[3] > b[1])
    df = detections.where(good)
    clamped = dict(zip(("x1", "y1", "x2", "y2"), B.clamped(b, width, height)))
    return df.withColumns(clamped).where("x2 > x1 AND y2 > y1")


def final_boxes(detections: DataFrame, least_score: float, order: str = "det_id") -> DataFrame:
    """Valid boxes with ``pos``, their place in the raster's list before the check."""
    b = B.cols()
    good = finite(b[0]) & finite(b[1]) & finite(b[2]) & finite(b[3]) & (b[2] > b[0]) & (b[3] > b[1]) & (F.col("score") >= least_score)
    return numbered(detections, order).withColumn("pos", F.col("nth") - 1).drop("nth").where(good)


def usable_polygons(polygons: DataFrame, rasters: DataFrame) -> DataFrame:
    """Polygons of three finite vertices or more whose bounds meet their raster."""
    df = with_bounds(polygons).join(rasters.select("raster_id", "width", "height"), "raster_id")
    fine = (F.size("ring") >= 3) & F.forall("ring", lambda p: finite(p["x"]) & finite(p["y"]))
    meets = (F.col("bx2") >= 0) & (F.col("bx1") < F.col("width")) & (F.col("by2") >= 0) & (F.col("by1") < F.col("height"))
    return df.where(fine & meets).select(*polygons.columns)


def asserted(detections: DataFrame) -> DataFrame:
    """The rows as they are; the job fails at the first box that is not ordered."""
    wrong = F.raise_error(F.concat(F.lit("box without size: "), F.col("det_id").cast("string"))).cast("double")
    return detections.withColumn("x2", F.when((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.col("x2")).otherwise(wrong))


def selected(polygons: DataFrame, ids: DataFrame) -> DataFrame:
    """Drawn polygons that are selected, with three vertices at least."""
    return polygons.where(F.size("ring") >= 3).join(ids.select("polygon_id"), "polygon_id", "left_semi").select(*polygons.columns)


def without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti").select(*table.columns)


def without_last(table: DataFrame, key: str, order: str) -> DataFrame:
    """All rows but the last one by ``order``."""
    return without(table, table.agg(F.max_by(key, order).alias(key)), key)


def pending(required: DataFrame, loaded: DataFrame, loading: DataFrame, key: list[str]) -> DataFrame:
    return required.join(loaded.select(*key).unionByName(loading.select(*key)), key, "left_anti")


def largest_parts(parts: DataFrame, key: list[str], area: Column) -> DataFrame:
    """Of each feature's parts (``part``, ``ring``) the largest, the first of equals."""
    best = F.max_by(F.struct("part", "ring"), F.struct(area, -F.col("part"))).alias("p")
    return parts.groupBy(*key).agg(best).select(*key, "p.part", "p.ring")


def unknown_slots(given: DataFrame, expected: DataFrame, key: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Slots of a mapping (key, slot) that are not expected: they are ignored, and reported by this."""
    # Merged: sizes are guessed without the rows that explode adds, so a join by guess would broadcast the slots.
    return given.select(*key, "slot").distinct().join(expected.select(*key, "slot").hint("merge"), [*key, "slot"], "left_anti")


def active(boxes: DataFrame, hidden: DataFrame) -> DataFrame:
    """Boxes that are neither eliminated nor of a class hidden in their raster (hidden: raster_id, class_id)."""
    seen = boxes.where(F.coalesce(F.col("status"), F.lit("")) != "eliminated")
    return seen.join(hidden.select("raster_id", "class_id").distinct(), ["raster_id", "class_id"], "left_anti")
