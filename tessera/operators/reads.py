"""Reads of pixel tables (raster_id, band, row, col, value): windows, decimated rasters, tile cells and areas to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fit(n: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), (n * scale).cast("int"))


def window(pixels: DataFrame, x: int, y: int, w: int, h: int, bands: list[int] | None = None, scale: float = 1.0, level_factor: int = 1) -> DataFrame:
    """A window's pixels, counted from its corner; ``bands`` also gives their order (``channel``). Coarser reads (``scale``,
    or the factor of an overview) are block means. The filters reach the scan; whole-size reads need no shuffle."""
    df = pixels.where(F.col("row").between(y, y + h - 1) & F.col("col").between(x, x + w - 1))
    channel = F.col("band") - 1
    if bands:
        df = df.where(F.col("band").isin(bands))
        channel = F.array_position(F.array(*map(F.lit, bands)), F.col("band")).cast("int") - 1
    scale = 1.0 / level_factor if level_factor > 1 else scale
    if scale >= 1:
        return df.select("raster_id", channel.alias("channel"), "band", (F.col("row") - y).alias("row"), (F.col("col") - x).alias("col"), "value")
    at = lambda c, start, n: F.floor((F.col(c) - start) * max(1, int(n * scale)) / n).cast("int").alias(c)
    return df.groupBy("raster_id", channel.alias("channel"), "band", at("row", y, h), at("col", x, w)).agg(F.avg("value").alias("value"))


def downsampled(pixels: DataFrame, rasters: DataFrame, max_dimension: int = 2048) -> DataFrame:
    """Whole rasters with a longest side of ``max_dimension`` at most, by block means."""
    scale = F.least(F.lit(1.0), F.lit(float(max_dimension)) / F.greatest("width", "height"))
    df = pixels.join(rasters.select("raster_id", "width", "height"), "raster_id")
    at = lambda c, n: F.floor(F.col(c) * _fit(F.col(n), scale) / F.col(n)).cast("int").alias(c)
    return df.groupBy("raster_id", "band", at("row", "height"), at("col", "width")).agg(F.avg("value").alias("value"))


def dual(pixels: DataFrame, rasters: DataFrame, display: int = 2048, detection: int = 4096) -> DataFrame:
    """Both resolutions in one pass, told by ``level``; where they are equal the coarser read serves for both."""
    side = F.greatest("width", "height")
    df = pixels.join(rasters.select("raster_id", "width", "height"), "raster_id")
    level = lambda name, n: F.struct(F.lit(name).alias("level"), F.least(F.lit(1.0), F.lit(float(n)) / side).alias("scale"))
    both = F.array(level("display", display), level("detection", detection))
    df = df.withColumn("l", F.explode(F.when(side <= min(display, detection), F.array(level("both", display))).otherwise(both)))
    at = lambda c, n: F.floor(F.col(c) * _fit(F.col(n), F.col("l.scale")) / F.col(n)).cast("int").alias(c)
    return df.groupBy("raster_id", F.col("l.level").alias("level"), "band", at("row", "height"), at("col", "width")).agg(F.avg("value").alias("value"))


def single_band(pixels: DataFrame, rasters: DataFrame, band: int, max_dimension: int = 4096) -> DataFrame:
    """One band, decimated; no rows for a band that a raster lacks."""
    known = rasters.where(F.lit(band).between(1, F.col("bands")))
    return downsampled(pixels.where(F.col("band") == band), known, max_dimension)


def tile_cell(tx: Column, ty: Column, width: Column, height: Column, tile: int) -> Column:
    """(x, y, w, h) of a tile of the fixed grid, clipped at the edge; null outside."""
    x, y = tx * tile, ty * tile
    w, h = F.least(F.lit(tile), width - x), F.least(F.lit(tile), height - y)
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def visible_region(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """(x, y, w, h) of a viewport inside a raster; all of it where they do not meet. Fractions are cut off."""
    a, b = (F.greatest(F.lit(0), F.least(v.cast("int"), m)) for v, m in ((x0, width), (y0, height)))
    c, d = F.least(width, F.greatest(x1.cast("int"), a)), F.least(height, F.greatest(y1.cast("int"), b))
    none = (c <= a) | (d <= b)
    pick = lambda inside, whole: F.when(none, whole).otherwise(inside)
    return F.struct(pick(a, F.lit(0)).alias("x"), pick(b, F.lit(0)).alias("y"), pick(c - a, width).alias("w"), pick(d - b, height).alias("h"))


def area_rings(mode: Column, visible: Column, drawn: Column) -> Column:
    """Rings to work on: the visible region's, none (null) for an entire raster, else the drawn ones; null if there are none."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x1, y1, x2, y2 = visible["x"], visible["y"], visible["x"] + visible["w"], visible["y"] + visible["h"]
    ring = F.array(p(x1, y1), p(x2, y1), p(x2, y2), p(x1, y2), p(x1, y1))
    return F.when(mode.startswith("Visible"), F.array(ring)).when(mode.startswith("Entire"), None).when(F.size(drawn) > 0, drawn)


def overlap_pixels(tile: Column, percent: Column, pixels: Column) -> tuple[Column, Column]:
    """(overlap, stride): the overlap by percent of a tile where given, else in pixels; the stride is 1 at least."""
    overlap = F.coalesce((tile * percent / 100).cast("int"), pixels)
    return overlap, F.greatest(F.lit(1), tile - overlap)


#: Seconds a tile takes, at least and at most.
TILE_SECONDS = (0.5, 2.0)


def estimate(width: Column, height: Column, stride: Column) -> tuple[Column, Column, Column]:
    """(tiles, least minutes, most minutes) of a run."""
    n = (F.floor(width / stride) + 1) * (F.floor(height / stride) + 1)
    return n, n * TILE_SECONDS[0] / 60, n * TILE_SECONDS[1] / 60


#: The centre tile and its neighbours, in the order in which they are fetched.
AROUND = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1)]


def prefetch(rasters: DataFrame, tile: int = 2048) -> DataFrame:
    """(raster_id, priority, tx, ty): tiles at a raster's centre that lie in it."""
    df = rasters.select("raster_id", "width", "height", F.posexplode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in AROUND])).alias("priority", "o"))
    centre = lambda n: F.floor(F.floor(F.col(n) / 2) / tile)
    df = df.withColumns({"tx": (centre("width") + F.col("o.i")).cast("int"), "ty": (centre("height") + F.col("o.j")).cast("int")})
    return df.where((F.col("tx") >= 0) & (F.col("ty") >= 0) & (F.col("tx") * tile < F.col("width")) & (F.col("ty") * tile < F.col("height"))).select("raster_id", "priority", "tx", "ty")


def padded(payload: Column, w: Column, h: Column, size: int) -> Column:
    """A payload of h rows of w values on a square of ``size``, zeros at the right and below; larger ones stay."""
    cell = lambda i: F.when((i % size < w) & (F.floor(i / size) < h), F.get(payload, (F.floor(i / size) * w + i % size).cast("int"))).otherwise(F.lit(0.0))
    return F.when((w >= size) & (h >= size), payload).otherwise(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), cell))
