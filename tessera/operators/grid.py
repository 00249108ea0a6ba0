"""Tile grids over rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _axis(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _grid(df: DataFrame, nx: Column, ny: Column, stride: Column, tile: int, clip: bool = True) -> DataFrame:
    df = df.withColumn("_nx", nx.cast("int")).withColumn("ty", _axis(ny)).withColumn("tx", _axis(F.col("_nx")))
    x, y = F.col("x0") + F.col("tx") * stride, F.col("y0") + F.col("ty") * stride
    w, h = F.least(F.lit(tile), F.col("x1") - x), F.least(F.lit(tile), F.col("y1") - y)
    size = (w, h) if clip else (F.lit(tile), F.lit(tile))
    out = df.select("raster_id", (F.col("ty") * F.col("_nx") + F.col("tx") + 1).cast("int").alias("tile_id"), x.cast("int").alias("x_off"), y.cast("int").alias("y_off"), size[0].cast("int").alias("w"), size[1].cast("int").alias("h"))
    return out


def _regions(rasters: DataFrame) -> DataFrame:
    if "x0" in rasters.columns:
        return rasters
    return rasters.select("raster_id", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))


def windows(rasters: DataFrame, tile: int = 640, overlap: int = 64) -> DataFrame:
    """Overlapping tiles; the last one of a row or column shrinks to the edge. Also over regions (x0, y0, x1, y1)."""
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be less than the tile")
    stride, df = tile - overlap, _regions(rasters)
    n = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a) - overlap) / stride))
    return _grid(df, n("x0", "x1"), n("y0", "y1"), F.lit(stride), tile)


def legacy_windows(rasters: DataFrame, tile: int = 640, overlap: int = 64) -> DataFrame:
    """A tile at every stride, slivers at the edge kept."""
    stride, df = max(1, tile - overlap), _regions(rasters)
    n = lambda a, b: F.ceil((F.col(b) - F.col(a)) / stride)
    return _grid(df, n("x0", "x1"), n("y0", "y1"), F.lit(stride), tile)


def training_windows(rasters: DataFrame, tile: int = 640, overlap: int = 64) -> DataFrame:
    """Full tiles only, at least one; the remainder at the edge is dropped."""
    stride, df = tile - overlap, _regions(rasters)
    n = lambda a, b: F.greatest(F.lit(1), F.floor((F.col(b) - F.col(a) - overlap) / stride))
    return _grid(df, n("x0", "x1"), n("y0", "y1"), F.lit(stride), tile, clip=False)


def core_bounds(tiles: DataFrame, rasters: DataFrame, overlap: int = 64, compat: bool = False) -> DataFrame:
    """Each tile's own part: half of the overlap is shaved off inner sides, so the parts of a raster do not overlap.

    An odd overlap gives the extra pixel to the earlier tile; ``compat`` shaves overlap // 2 off both sides instead.
    """
    near, far = overlap // 2 if compat else overlap - overlap // 2, overlap // 2
    df = tiles.join(rasters.select("raster_id", "width", "height"), "raster_id")
    low = lambda c: F.when(F.col(c) == 0, F.col(c)).otherwise(F.col(c) + near)
    high = lambda o, s, m: F.when(F.col(o) + F.col(s) >= F.col(m), F.col(o) + F.col(s)).otherwise(F.col(o) + F.col(s) - far)
    return df.select(*tiles.columns, low("x_off").alias("cx1"), low("y_off").alias("cy1"), high("x_off", "w", "width").alias("cx2"), high("y_off", "h", "height").alias("cy2"))


def crop_regions(rasters: DataFrame, vertices: DataFrame) -> DataFrame:
    """(x0, y0, x1, y1) around each raster's vertices (raster_id, x, y), in whole pixels; all of it if it has none."""
    box = vertices.groupBy("raster_id").agg(F.floor(F.min("x")).alias("a"), F.floor(F.min("y")).alias("b"), F.ceil(F.max("x")).alias("c"), F.ceil(F.max("y")).alias("d"))
    df = rasters.select("raster_id", "width", "height").join(box, "raster_id", "left")
    low = lambda v, m: F.coalesce(F.greatest(F.lit(0), F.least(F.col(v), F.col(m) - 1)), F.lit(0)).cast("int")
    df = df.withColumn("x0", low("a", "width")).withColumn("y0", low("b", "height"))
    high = lambda v, o, m: F.coalesce(F.greatest(F.col(o) + 1, F.least(F.col(v), F.col(m))), F.col(m)).cast("int")
    return df.select("raster_id", "x0", "y0", high("c", "x0", "width").alias("x1"), high("d", "y0", "height").alias("y1"))


def viewport_tiles(viewports: DataFrame, tile: int = 512, margin: int = 0) -> DataFrame:
    """(viewport columns, tx, ty) of the tiles that a viewport (x1, y1, x2, y2, width, height) needs."""
    top = lambda m: (F.ceil(F.col(m) / tile) - 1).cast("int")
    low = lambda v: F.greatest(F.lit(0), F.floor(F.col(v) / tile) - margin).cast("int")
    high = lambda v, m: F.least(top(m), F.ceil(F.col(v) / tile) - 1 + margin).cast("int")
    df = viewports.withColumn("_x0", low("x1")).withColumn("_y0", low("y1")).withColumn("_x1", high("x2", "width")).withColumn("_y1", high("y2", "height"))
    df = df.where("_x1 >= _x0 AND _y1 >= _y0").withColumn("ty", F.explode(F.sequence("_y0", "_y1"))).withColumn("tx", F.explode(F.sequence("_x0", "_x1")))
    return df.drop("_x0", "_y0", "_x1", "_y1")
