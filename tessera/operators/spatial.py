"""Spatial joins on grid cells. No side is broadcast: both are dealt by (raster, cell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.functions import geo as G
from tessera.operators.storage import materialize

CELL = 128


def _span(low: Column, high: Column, cell: int) -> Column:
    return F.sequence(F.floor(low / cell).cast("int"), F.floor(F.greatest(low, high) / cell).cast("int"))


def with_cells(df: DataFrame, b: B.Box, cell: int = CELL) -> DataFrame:
    """A row for each grid cell that a box touches, as (gx, gy)."""
    return df.withColumn("gx", F.explode(_span(b[0], b[2], cell))).withColumn("gy", F.explode(_span(b[1], b[3], cell)))


def with_bounds(polygons: DataFrame) -> DataFrame:
    side = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    return polygons.withColumns({"bx1": side(F.array_min, "x"), "by1": side(F.array_min, "y"), "bx2": side(F.array_max, "x"), "by2": side(F.array_max, "y")})


#: Edges up to which a ring is copied into its cells; larger rings are cut by cells.
COPIED = 64


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: int = CELL, mode: str = "ring", copied: int = COPIED) -> DataFrame:
    """Points (raster_id, x, y, ...) x polygons (raster_id, polygon_id, ring, ...) that contain them, without the rings.

    ``mode``: ring (even-odd, lower and left borders inside), strict (points on the border are outside), or bbox. A ring of
    over ``copied`` edges is cut: each cell gets the edges that touch it and the parity of what lies above, so a point
    tests its cell's edges only, and what is shuffled grows with the edges instead of edges times cells.
    """
    x, y = F.col("x"), F.col("y")
    dealt = points.withColumn("gx", F.floor(x / cell).cast("int")).withColumn("gy", F.floor(y / cell).cast("int"))
    small = with_bounds(polygons if mode == "bbox" else polygons.where(F.size("ring") <= copied))
    small = with_cells(small, (F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2")), cell)
    inside = x.between(F.col("bx1"), F.col("bx2")) & y.between(F.col("by1"), F.col("by2"))
    if mode != "bbox":
        inside = inside & G.contains(F.col("ring"), x, y)
    if mode == "strict":
        inside = inside & ~G.on_border(G.edges(F.col("ring")), x, y)
    hit = dealt.join(small, ["raster_id", "gx", "gy"]).where(inside).drop("gx", "gy", "bx1", "by1", "bx2", "by2", "ring")
    large = polygons.where(F.size("ring") > copied)
    if mode == "bbox" or large.isEmpty():
        return hit
    cut = ring_cells(large, cell)
    right = (F.col("gx") + 1.0) * cell
    over = lambda e: ((e["ax"] > right) & (e["ay"] > y) & ~(e["bx"] > right)) | ((e["bx"] > right) & (e["by"] > y) & ~(e["ax"] > right))
    odd = F.aggregate("_edges", F.col("_above"), lambda s, e: s + G.crosses(e, x, y).cast("long") + over(e).cast("long")) % 2 == 1
    if mode == "strict":
        odd = odd & ~G.on_border(F.col("_edges"), x, y)
    return hit.unionByName(dealt.join(cut, ["raster_id", "gx", "gy"]).where(odd).drop("gx", "gy", "_edges", "_above"))


def ring_cells(polygons: DataFrame, cell: int = CELL) -> DataFrame:
    """The polygons' columns but the ring for each cell (gx, gy) that a ring may hold a point of, with the cell's ``_edges`` and ``_above``.

    ``_above``: edges from left to right over the cell's right side that lie wholly above the cell's row. A point is inside
    if this number, the cell's edges that its ray to the right crosses, and the right ends above the point of the cell's
    edges that pass the right side make an odd sum: edges further right cancel out around a closed ring.
    """
    # A ring's name is a number; only its few other columns go along with the cells.
    shapes = materialize(polygons.withColumn("_shape", F.monotonically_increasing_id()), "shapes")
    rest = [c for c in polygons.columns if c not in ("ring", "raster_id")]
    edges = shapes.select("raster_id", "_shape", F.explode(G.edges(F.col("ring"))).alias("e"))
    low = {c: F.least(F.col(f"e.a{c}"), F.col(f"e.b{c}")) for c in "xy"}
    high = {c: F.greatest(F.col(f"e.a{c}"), F.col(f"e.b{c}")) for c in "xy"}
    down = lambda v: F.floor(v / cell).cast("int")
    up = lambda v: F.ceil(v / cell).cast("int")
    # An edge that begins on a cell's right side passes it.
    touched = edges.withColumn("gx", F.explode(F.sequence(up(low["x"]) - 1, down(high["x"])))).withColumn("gy", F.explode(F.sequence(down(low["y"]), down(high["y"]))))
    held = touched.groupBy("raster_id", "_shape", "gx", "gy").agg(F.collect_list("e").alias("_edges"))
    passed = edges.where(up(low["x"]) <= up(high["x"]) - 1).withColumn("gx", F.explode(F.sequence(up(low["x"]) - 1, up(high["x"]) - 2)))
    tops = passed.groupBy("raster_id", "_shape", "gx", (down(low["y"]) - 1).alias("gy")).agg(F.count("*").alias("_tops"))
    bounds = edges.groupBy("raster_id", "_shape").agg(*[f(v).alias(n) for n, f, v in (("bx1", F.min, low["x"]), ("by1", F.min, low["y"]), ("bx2", F.max, high["x"]), ("by2", F.max, high["y"]))])
    cells = with_cells(bounds, (F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2")), cell).select("raster_id", "_shape", "gx", "gy", F.lit(True).alias("_cell"))
    key = ["raster_id", "_shape", "gx", "gy"]
    both = cells.join(held, key, "left").join(tops, key, "full")
    column = Window.partitionBy("raster_id", "_shape", "gx").orderBy(F.desc("gy"))
    both = both.withColumn("_above", F.coalesce(F.sum("_tops").over(column), F.lit(0))).where(F.col("_cell") & (F.col("_edges").isNotNull() | (F.col("_above") % 2 == 1)))
    both = both.withColumn("_edges", F.coalesce("_edges", F.array().cast(held.schema["_edges"].dataType)))
    return both.select(*key, "_edges", "_above").join(shapes.select("_shape", *rest), "_shape").drop("_shape")


def filter_by_polygons(points: DataFrame, polygons: DataFrame, key: list[str], cell: int = CELL) -> DataFrame:
    """Rows whose (x, y) is in an ``aoi`` polygon of their raster, if it has any, and in no ``exclude`` polygon."""
    hits = points_in_polygons(points.select(*key, "raster_id", "x", "y"), polygons, cell).select(*key, "role").distinct()
    marks = hits.groupBy(*key).agg(F.max((F.col("role") == "aoi").cast("int")).alias("_in"), F.max((F.col("role") == "exclude").cast("int")).alias("_out"))
    limited = polygons.where("role = 'aoi'").select("raster_id", F.lit(1).alias("_limited")).distinct()
    df = points.join(marks, key, "left").join(limited, "raster_id", "left")
    keep = (F.coalesce("_in", F.lit(0)) == 1) | F.col("_limited").isNull()
    return df.where(keep & (F.coalesce("_out", F.lit(0)) == 0)).select(*points.columns)


def tiles_meeting_polygons(tiles: DataFrame, polygons: DataFrame, exact: bool = False) -> DataFrame:
    """Tiles whose rectangle meets a polygon's bounds (closed), or with ``exact`` the polygon itself."""
    x1, y1, x2, y2 = F.col("x_off"), F.col("y_off"), F.col("x_off") + F.col("w"), F.col("y_off") + F.col("h")
    cell = 1024
    t = with_cells(tiles, (x1, y1, x2, y2), cell)
    p = with_bounds(polygons.select("raster_id", "ring"))
    p = with_cells(p, (F.col("bx1"), F.col("by1"), F.col("bx2"), F.col("by2")), cell)
    meets = (F.col("bx1") <= x2) & (F.col("bx2") >= x1) & (F.col("by1") <= y2) & (F.col("by2") >= y1)
    if exact:
        meets = meets & rectangle_meets(F.col("ring"), x1, y1, x2, y2)
    hit = t.join(p, ["raster_id", "gx", "gy"]).where(meets).select("raster_id", "tile_id").distinct()
    return tiles.join(hit, ["raster_id", "tile_id"], "left_semi")


def rectangle_meets(ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A vertex in the rectangle, a corner in the ring, or an edge that crosses the rectangle."""
    vertex = F.exists(ring, lambda p: p["x"].between(x1, x2) & p["y"].between(y1, y2))
    corner = G.contains(ring, x1.cast("double"), y1.cast("double"))
    side = lambda e, x, y: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])

    def crosses(e: Column) -> Column:
        near = (F.least(e["ax"], e["bx"]) <= x2) & (F.greatest(e["ax"], e["bx"]) >= x1) & (F.least(e["ay"], e["by"]) <= y2) & (F.greatest(e["ay"], e["by"]) >= y1)
        s = [side(e, x, y) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
        return near & (F.least(*s) <= 0) & (F.greatest(*s) >= 0)

    return vertex | corner | F.exists(G.edges(ring), crosses)


def overlapping_pairs(boxes: DataFrame, key: list[str], min_iou: float, inclusive: bool = False, cell: int = CELL, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key..., a, b, iou, a_ and b_ of ``carry``) of boxes (det_id, x1..y2) of one key; each pair once, in the cell of its corner.

    Equal cells are joined; a pair that shares several counts only where its intersection begins.
    """
    left = with_cells(boxes.select(*key, F.col("det_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2", *carry)]), B.cols("a_"), cell)
    right = with_cells(boxes.select(*key, F.col("det_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2", *carry)]), B.cols("b_"), cell)
    iou = B.iou(B.cols("a_"), B.cols("b_"))
    here = (F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("gx")) & (F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("gy"))
    meet = (F.least("a_x2", "b_x2") > F.greatest("a_x1", "b_x1")) & (F.least("a_y2", "b_y2") > F.greatest("a_y1", "b_y1"))
    pairs = left.join(right.hint("merge"), [*key, "gx", "gy"]).where((F.col("a") < F.col("b")) & here & meet)
    pairs = pairs.select(*key, "a", "b", iou.alias("iou"), *[f"{side}_{c}" for c in carry for side in "ab"])
    return pairs.where(F.col("iou") >= min_iou if inclusive else F.col("iou") > min_iou)


def nearest(clicks: DataFrame, points: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Each click's nearest point (raster_id, idx, x, y) within the tolerance; of equals the first index."""
    cell = max(1, int(tolerance))
    near = clicks.withColumn("gx", F.explode(_span(F.col("cx") - tolerance, F.col("cx") + tolerance, cell))).withColumn("gy", F.explode(_span(F.col("cy") - tolerance, F.col("cy") + tolerance, cell)))
    dealt = points.withColumn("gx", F.floor(F.col("x") / cell).cast("int")).withColumn("gy", F.floor(F.col("y") / cell).cast("int"))
    d = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    hit = near.join(dealt, ["raster_id", "gx", "gy"]).withColumn("distance", d).where(F.col("distance") <= tolerance)
    return hit.groupBy("raster_id", "click_id").agg(F.min(F.struct("distance", "idx")).alias("m")).select("raster_id", "click_id", "m.idx", "m.distance")
