"""Pixel tables (raster_id, band, row, col, value): statistics, stretches, pyramids, masks, zones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.selection import percentiles
from tessera.operators.spatial import points_in_polygons, with_bounds
from tessera.operators.storage import materialize, maybe_broadcast, spread, tasks

LEVELS = (2, 4, 8, 16, 32, 64, 128)


BAND = ["raster_id", "band"]


def band_stats(pixels: DataFrame, nodata: float = -9999.0, approx: bool = False) -> DataFrame:
    """p2, p98, min, max per band over valid pixels; over all pixels where none is valid."""
    valid = F.coalesce((F.col("value") != nodata) & ~F.isnan("value"), F.lit(False))
    df = pixels.withColumn("_ok", valid)
    if approx:
        q = lambda p: F.percentile_approx("value", p, 10_000)
        s = df.groupBy(*BAND, "_ok").agg(q(0.02).alias("p0"), q(0.98).alias("p1"), F.min("value").alias("low"), F.max("value").alias("high"))
    else:
        s = percentiles(df, [*BAND, "_ok"], F.col("value"), [0.02, 0.98])
    best = s.groupBy(*BAND).agg(F.max_by(F.struct("p0", "p1", "low", "high"), "_ok").alias("s"))
    return best.select(*BAND, F.col("s.p0").alias("p2"), F.col("s.p1").alias("p98"), F.col("s.low").alias("vmin"), F.col("s.high").alias("vmax"))


def input_means(pixels: DataFrame, step: int = 1) -> DataFrame:
    """Mean of the pixels above 0 of each band, of every ``step``-th row and column; 0 if none."""
    df = pixels.where((F.col("row") % step == 0) & (F.col("col") % step == 0))
    return df.groupBy("raster_id", "band").agg(F.coalesce(F.avg(F.when(F.col("value") > 0, F.col("value"))), F.lit(0.0)).alias("mean"))


def adaptive_mapping(pixels: DataFrame, slots: list[int], step: int = 10) -> DataFrame:
    """Band i fills the i-th of the sorted slots, stretched by percentiles of every ``step``-th row and column; slots and
    bands beyond the shorter list are left out."""
    every = F.array(*map(F.lit, sorted(slots)))
    df = adaptive_percentiles(pixels.where((F.col("row") % step == 0) & (F.col("col") % step == 0)))
    df = df.withColumn("slot", F.get(every, F.col("band") - 1)).where("slot IS NOT NULL")
    return df.select("raster_id", "slot", F.col("band").alias("input_band"), F.col("lo").alias("p_low"), F.col("hi").alias("p_high"))


def adaptive_percentiles(pixels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Percentiles of pixels above 0: (0, 255) if there are none, (min, max + 1e-6) if they are flat."""
    v = F.when(F.col("value") > 0, F.col("value"))
    df = _ranges(pixels, v, low, high).select(*BAND, "lo", "hi", F.col("low").alias("a"), F.col("high").alias("b"))
    flat = F.col("hi") <= F.col("lo")
    lo = F.when(F.col("lo").isNull(), 0.0).when(flat, F.col("a")).otherwise(F.col("lo"))
    return df.select("raster_id", "band", lo.alias("lo"), F.when(F.col("hi").isNull(), 255.0).when(flat, F.col("b") + 1e-6).otherwise(F.col("hi")).alias("hi"))


def _ranges(pixels: DataFrame, v: Column, low: float, high: float) -> DataFrame:
    """(raster_id, band, n, lo, hi, low, high) of the bands' values ``v``; n is 0 and the others null where a band has none."""
    found = percentiles(pixels, BAND, v, [low, high]).withColumnsRenamed({"p0": "lo", "p1": "hi"})
    return pixels.select(*BAND).distinct().join(found, BAND, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stretch(v: Column, lo: Column, hi: Column) -> Column:
    """0..255, truncated; 0 where flat."""
    return F.when(hi > lo, F.floor((F.greatest(lo, F.least(hi, v)) - lo) / (hi - lo) * 255)).otherwise(F.lit(0)).cast("int")


def _halves(v: Column) -> tuple[Column, Column]:
    big = v * 134217729.0
    return big - (big - v), v - (big - (big - v))


def _fused(x: Column, y: Column, z: Column) -> Column:
    """x * y + z with the product kept exact until the sum is rounded (Dekker); the plain sum where that overflows."""
    (xh, xl), (yh, yl), p, s = _halves(x), _halves(y), x * y, x * y + z
    product_left = (xh * yh - p) + xh * yl + xl * yh + xl * yl
    sum_left = (p - (s - (s - p))) + (z - (s - p))
    return F.nanvl(s + (sum_left + product_left), s)


def _between(values: Column, fraction: float) -> Column:
    """Percentile of a sorted list, both neighbours weighed and summed up with one rounding less than Spark's ``percentile``, as
    DuckDB does: pixels right on a step of a stretch depend on the last bit. Null for an empty list."""
    at = (F.size(values) - 1) * F.lit(fraction)
    low, high = (F.get(values, f(at).cast("int")) for f in (F.floor, F.ceil))
    share = at - F.floor(at)
    return F.when(low == high, low).otherwise(_fused(1 - share, low, high * share))


def tile_percentiles(pixels: DataFrame, tile: int = 32, least: float = 0.05) -> DataFrame:
    """Per tile and band: 1 % and 99 % of the pixels above 0, null if these are under ``least`` of the tile."""
    v = F.when(F.col("value") > 0, F.col("value"))
    df = pixels.groupBy("raster_id", F.floor(F.col("row") / tile).cast("int").alias("ty"), F.floor(F.col("col") / tile).cast("int").alias("tx"), "band")
    df = df.agg(F.sort_array(F.collect_list(v)).alias("v"), (F.count(v) / F.count("*")).alias("share"))  # a tile's values
    ok = F.col("share") > least
    lo, hi = (F.when(ok, _between(F.col("v"), p)).alias(c) for c, p in (("lo", 0.01), ("hi", 0.99)))
    return df.select("raster_id", "ty", "tx", "band", lo, hi, "share")


def prepared(pixels: DataFrame, mapping: DataFrame, tile: int = 32) -> DataFrame:
    """Slots from input bands (mapping: slot, input_band, p_low, p_high), stretched by the tile's own percentiles, else
    the mapping's, else (0, 255). A blank slot is 0."""
    own = tile_percentiles(pixels, tile)
    df = pixels.withColumn("ty", F.floor(F.col("row") / tile).cast("int")).withColumn("tx", F.floor(F.col("col") / tile).cast("int"))
    df = df.join(maybe_broadcast(mapping.withColumnRenamed("input_band", "band")), "band").join(own, ["raster_id", "ty", "tx", "band"])
    lo, hi = F.coalesce("lo", "p_low", F.lit(0.0)), F.coalesce("hi", "p_high", F.lit(255.0))
    filled = df.select("raster_id", "slot", "row", "col", stretch(F.col("value"), lo, hi).alias("value"))
    blank = mapping.where("input_band IS NULL").select("slot").crossJoin(pixels.select("raster_id", "row", "col").distinct())
    return filled.unionByName(blank.select("raster_id", "slot", "row", "col", F.lit(0).alias("value")))


def unit_range(pixels: DataFrame, least: int = 100) -> DataFrame:
    """2 % and 98 % of the pixels above 0 to 0..1; values under -9999 and NaN count as 0, and so does a whole band of at most
    ``least`` pixels above 0, or a flat one."""
    v = F.when((F.col("value") >= -9999) & ~F.isnan("value"), F.col("value")).otherwise(0.0)
    valid = F.when(v > 0, v)
    df = pixels.join(_ranges(pixels, valid, 0.02, 0.98).drop("low", "high"), BAND)
    scaled = F.try_divide(F.greatest(F.col("lo"), F.least(F.col("hi"), v)) - F.col("lo"), F.col("hi") - F.col("lo"))
    good = (F.col("n") > least) & (F.col("hi") > F.col("lo"))
    return df.select("raster_id", "band", "row", "col", F.when(good, scaled).otherwise(0.0).alias("value"))


def display(pixels: DataFrame) -> DataFrame:
    """Display values: percentiles of pixels that are neither 0 nor NaN; 128 where flat."""
    v = F.when((F.col("value") != 0) & ~F.isnan("value"), F.col("value"))
    s = _ranges(pixels, v, 0.02, 0.98)
    out = F.when(F.col("hi") > F.col("lo"), stretch(F.col("value"), F.col("lo"), F.col("hi"))).otherwise(F.lit(128))
    return pixels.join(s, ["raster_id", "band"]).select("raster_id", "band", "row", "col", out.cast("int").alias("value"))


def composite(pixels: DataFrame, bands: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    return pixels.groupBy("raster_id", "row", "col").pivot("band", list(bands)).agg(F.first("value"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b)


def decimated(pixels: DataFrame, factor: int) -> DataFrame:
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return pixels.groupBy("raster_id", "band", *cell).agg(F.avg("value").alias("value"))


def pyramid(pixels: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Averages at each level; a level's sums and counts come from the level before, so pixels are shuffled once."""
    base = pixels.groupBy("raster_id", "band", F.floor(F.col("row") / levels[0]).cast("int").alias("row"), F.floor(F.col("col") / levels[0]).cast("int").alias("col")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    df = base.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    f = F.col("level") / levels[0]
    df = df.groupBy("raster_id", "level", "band", F.floor(F.col("row") / f).cast("int").alias("row"), F.floor(F.col("col") / f).cast("int").alias("col")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return df.select("raster_id", "level", "band", "row", "col", F.try_divide("s", "n").alias("value"))


def best_level(zoom: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    """Number of the level, 0 for the base, whose factor is nearest to 1/zoom, the first of equals; 0 from zoom 1 on."""
    gaps = F.array(*[F.abs(F.lit(float(f)) - 1 / F.greatest(zoom, F.lit(1e-6))) for f in (1, *levels)])
    return F.when(zoom >= 1, F.lit(0)).otherwise((F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))


def area_resampled(pixels: DataFrame, scale: float) -> DataFrame:
    """Area-weighted means on a grid ``scale`` times as fine (scale < 1: coarser)."""
    df = pixels
    for c in ("row", "col"):
        a, b = F.col(c) * scale, (F.col(c) + 1) * scale
        df = df.withColumn(f"o{c}", F.explode(F.sequence(F.floor(a).cast("int"), (F.ceil(b) - 1).cast("int"))))
        df = df.withColumn(f"w{c}", F.least(b, F.col(f"o{c}") + 1) - F.greatest(a, F.col(f"o{c}")))
    w = F.col("wrow") * F.col("wcol")
    return df.groupBy("raster_id", "band", F.col("orow").alias("row"), F.col("ocol").alias("col")).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))


def _kept(pixels: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pixels with ``keep``: inside a raster's AOI polygons, if it has any, and outside exclude ones, by pixel centres."""
    at = pixels.select("raster_id", "row", "col").distinct().withColumn("x", F.col("col") + 0.5).withColumn("y", F.col("row") + 0.5)
    hit = points_in_polygons(at, polygons).groupBy("raster_id", "row", "col").agg(F.bool_or(F.col("role") == "aoi").alias("i"), F.bool_or(F.col("role") == "exclude").alias("o"))
    limited = polygons.where("role = 'aoi'").select("raster_id", F.lit(True).alias("limited")).distinct()
    df = pixels.join(hit, ["raster_id", "row", "col"], "left").join(limited, "raster_id", "left")
    keep = (F.coalesce("i", F.lit(False)) | F.col("limited").isNull()) & ~F.coalesce("o", F.lit(False))
    return df.select("raster_id", "band", "row", "col", "value", keep.alias("keep"))


def masked(pixels: DataFrame, polygons: DataFrame) -> DataFrame:
    """0 outside a raster's AOI polygons, if it has any, or inside an exclude one, by pixel centres."""
    return _kept(pixels, polygons).select("raster_id", "band", "row", "col", F.when(F.col("keep"), F.col("value")).otherwise(0.0).alias("value"))


def box_means(pixels: DataFrame, boxes: DataFrame, polygons: DataFrame, cell: int = 32) -> DataFrame:
    """Mean of a box (raster_id, det_id, x1..y2) and band over its finite pixels within AOI polygons and outside exclude
    ones; null if none is left. For rasters with polygons; without any, a box takes its centre's value instead."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell).cast("int"), F.greatest(F.floor(F.col(a) / cell), F.ceil(F.col(b) / cell) - 1).cast("int")))
    z = boxes.select("raster_id", "det_id", "x1", "y1", "x2", "y2").withColumn("gx", span("x1", "x2")).withColumn("gy", span("y1", "y2"))
    dealt = lambda df: df.withColumns({"gx": F.floor(F.col("col") / cell).cast("int"), "gy": F.floor(F.col("row") / cell).cast("int")})
    near = dealt(pixels).join(z.select("raster_id", "gx", "gy").distinct(), ["raster_id", "gx", "gy"], "left_semi")
    p = dealt(_kept(near, polygons))  # polygons meet pixels of the boxes' cells only
    inside = (F.col("col") >= F.floor("x1")) & (F.col("col") < F.ceil("x2")) & (F.col("row") >= F.floor("y1")) & (F.col("row") < F.ceil("y2"))
    fine = F.col("keep") & ~F.isnan("value") & (F.abs("value") < float("inf"))
    df = p.join(z.hint("merge"), ["raster_id", "gx", "gy"]).where(inside)
    return df.groupBy("raster_id", "det_id", "band").agg(F.avg(F.when(fine, F.col("value"))).alias("mean"))


def zonal_means(zones: DataFrame, pixels: DataFrame, nodata: float = -9999.0, cell: int = 32) -> DataFrame:
    """Mean per zone (raster_id, zone_id, x1..y2) and band over the pixels that the square touches; null if none is valid."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor(F.col(b) / cell).cast("int")))
    z = zones.withColumn("gx", span("x1", "x2")).withColumn("gy", span("y1", "y2"))
    p = pixels.withColumn("gx", F.floor(F.col("col") / cell).cast("int")).withColumn("gy", F.floor(F.col("row") / cell).cast("int"))
    touch = (F.col("col") < F.col("x2")) & (F.col("col") + 1 > F.col("x1")) & (F.col("row") < F.col("y2")) & (F.col("row") + 1 > F.col("y1"))
    df = p.join(z.hint("merge"), ["raster_id", "gx", "gy"]).where(touch)
    return df.groupBy("raster_id", "zone_id", "band").agg(F.avg(F.when((F.col("value") != nodata) & ~F.isnan("value"), F.col("value"))).alias("mean"))


#: What a pixel's inside leaves out on each side.
MARGIN = 1e-6


def mean_touched(pixels: DataFrame, polygons: DataFrame, nodata: float = -9999.0, cell: int = 32) -> DataFrame:
    """Mean per polygon and band over all pixels whose inside a polygon touches; null if none of them is valid.

    Which pixels a polygon touches is found once for each of its cells, as a row of bits for each row of pixels; the pixels
    of all bands then look up their bit.
    """
    zones = touched_cells(polygons, cell)
    p = pixels.withColumn("gx", F.floor(F.col("col") / cell).cast("int")).withColumn("gy", F.floor(F.col("row") / cell).cast("int"))
    bits = F.get("_rows", (F.col("row") - F.col("gy") * cell).cast("int"))
    df = p.join(zones.hint("merge"), ["raster_id", "gx", "gy"]).where(F.bit_get(bits, (F.col("col") - F.col("gx") * cell).cast("int")) == 1)
    valid = F.when((F.col("value") != nodata) & ~F.isnan("value"), F.col("value"))
    return df.groupBy("raster_id", "polygon_id", "band").agg(F.avg(valid).alias("mean"), F.count("*").alias("n"))


def touched_cells(polygons: DataFrame, cell: int) -> DataFrame:
    """(raster_id, polygon_id, gx, gy, _rows) of the cells in which a polygon touches the inside of a pixel: bit c of entry r
    tells whether it touches the cell's pixel in row r and column c, as ``rectangle_meets`` does. ``cell``: up to 62."""
    axis = lambda k: F.transform("ring", lambda p: p[k].cast("double"))
    given = with_bounds(polygons.select("raster_id", "polygon_id", "ring")).where("bx1 IS NOT NULL AND by1 IS NOT NULL")
    given = spread(given.select("raster_id", "polygon_id", axis("x").alias("xs"), axis("y").alias("ys"), "bx1", "by1", "bx2", "by2"))
    kind = dict(given.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for raster, polygon, xs, ys, *bounds in b.itertuples(index=False, name=None):
                x1, y1, x2, y2 = (int(v // cell) for v in bounds)
                ax, ay = np.asarray(xs, float), np.asarray(ys, float)
                shape = np.stack([ax, ay, np.roll(ax, -1), np.roll(ay, -1)])
                for gx in range(x1, x2 + 1):
                    for gy in range(y1, y2 + 1):
                        mask = _touched(shape, gx * cell, gy * cell, cell, bounds)
                        if mask.any():
                            out.append((raster, polygon, gx, gy, mask @ (1 << np.arange(cell))))
                        if len(out) == 1024:
                            yield pd.DataFrame(out, columns=names)
                            out = []
            yield pd.DataFrame(out, columns=names)

    names = ["raster_id", "polygon_id", "gx", "gy", "_rows"]
    return given.mapInPandas(run, f"raster_id {kind['raster_id']}, polygon_id {kind['polygon_id']}, gx int, gy int, _rows array<long>")


def _touched(shape: np.ndarray, left: int, top: int, cell: int, bounds: list[float], most: int = 256) -> np.ndarray:
    """Whether the edges (ax, ay, bx, by) of a ring touch each pixel of a cell, or hold its corner: [row, column]."""
    n = np.arange(cell)
    x1, y1, x2, y2 = left + n + MARGIN, top + n + MARGIN, left + n + (1 - MARGIN), top + n + (1 - MARGIN)
    box = ((bounds[1] < y2) & (bounds[3] > y1))[:, None] & ((bounds[0] < x2) & (bounds[2] > x1))
    odd, met = np.zeros((cell, cell), bool), np.zeros((cell, cell), bool)
    low, high = np.minimum(shape[1], shape[3]), np.maximum(shape[1], shape[3])
    across = shape[:, (low <= y2[-1]) & (high >= y1[0])]
    for i in range(0, across.shape[1], most):
        ax, ay, bx, by = across[:, i : i + most, None]
        turns = (ay > y1) != (by > y1)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (bx - ax) * (y1 - ay) / (by - ay) + ax
        odd ^= (turns[:, :, None] & (x1 < at[:, :, None])).sum(0) % 2 == 1
        beside = (np.minimum(ax, bx) <= x2) & (np.maximum(ax, bx) >= x1)
        some = beside.any(1)
        ax, ay, bx, by, beside = ax[some], ay[some], bx[some], by[some], beside[some]
        vertex = ((ay >= y1) & (ay <= y2))[:, :, None] & ((ax >= x1) & (ax <= x2))[:, None, :]
        near = ((np.minimum(ay, by) <= y2) & (np.maximum(ay, by) >= y1))[:, :, None] & beside[:, None, :]
        (u1, u2), (v1, v2) = [((bx - ax) * (y - ay))[:, :, None] for y in (y1, y2)], [((by - ay) * (x - ax))[:, None, :] for x in (x1, x2)]
        sides = [u1 - v1, u1 - v2, u2 - v2, u2 - v1]
        low_side, top_side = np.minimum.reduce(sides), np.maximum.reduce(sides)
        met |= (vertex | (near & (low_side <= 0) & (top_side >= 0))).any(0)
    return box & (odd | met)


def display_bands(n: Column, wanted: Column | None = None) -> Column:
    """Bands to show: those wanted that exist, else band 1; without a wish 1 to 3 as far as they go."""
    if wanted is None:
        return F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(3))))
    some = F.filter(wanted, lambda b: b.between(1, n))
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(1)))


#: What letterboxes are filled with, and the largest value up to which a tile counts as scaled to 0..1.
FILL, UNIT_TOP = 114.0, 1.5


def letterboxed(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """Payloads (h rows of w values) resized by bilinear interpolation with their aspect kept, in the middle of a
    height x width tile; adds ``scale``, ``left`` and ``top``."""
    import numpy as np

    def axis(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        i = np.floor(at).astype(int)
        return i, np.minimum(i + 1, n - 1), at - i

    def run(batches):
        for b in batches:
            out, metas = [], []
            for payload, h, w in zip(b["payload"], b["h"], b["w"]):
                x, scale = np.asarray(payload, float).reshape(h, w), min(height / h, width / w)
                nh, nw = max(1, min(height, round(h * scale))), max(1, min(width, round(w * scale)))
                (i, j, u), (k, m, v) = axis(h, nh), axis(w, nw)
                rows = x[i] * (1 - u)[:, None] + x[j] * u[:, None]
                small = rows[:, k] * (1 - v) + rows[:, m] * v
                top, left = (height - nh) // 2, (width - nw) // 2
                full = np.full((height, width), FILL if small.max() > UNIT_TOP else FILL / 255)
                full[top : top + nh, left : left + nw] = small
                out.append(full.ravel().astype("float32")), metas.append((scale, left, top))
            yield b.assign(payload=out, scale=[m[0] for m in metas], left=[m[1] for m in metas], top=[m[2] for m in metas])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema)
    return tiles.mapInPandas(run, f"{kept}, scale double, left int, top int")


def overview(pixels: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Overview bytes: 2 % and 98 % of pixels that are neither 0 nor NaN (of all where there are none), or ``p2`` and ``p98``
    of ``stats`` (raster_id, band); flat ones use minimum and maximum, then a width of 1e-5."""
    key, v = ["raster_id", "band"], F.col("value")
    valid = F.coalesce((v != 0) & ~F.isnan(v), F.lit(False))
    s = percentiles(pixels.withColumn("_ok", valid), [*key, "_ok"], v, [0.02, 0.98])
    s = s.groupBy(*key).agg(F.max_by(F.struct(F.col("p0").alias("lo"), F.col("p1").alias("hi"), F.col("low").alias("a"), F.col("high").alias("b")), "_ok").alias("s")).select(*key, "s.*")
    if stats is not None:
        s = s.join(stats.select(*key, "p2", "p98"), key, "left").withColumns({"lo": F.coalesce("p2", "lo"), "hi": F.coalesce("p98", "hi")})
    flat = F.col("hi") <= F.col("lo")
    s = s.withColumns({"lo": F.when(flat, F.col("a")).otherwise(F.col("lo")), "hi": F.when(flat, F.col("b")).otherwise(F.col("hi"))})
    s = s.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1e-5).otherwise(F.col("hi")))
    return pixels.join(s.select(*key, "lo", "hi"), key).select("raster_id", "band", "row", "col", stretch(v, F.col("lo"), F.col("hi")).alias("value"))


def preview(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Preview bytes by percentiles of the pixels above 0; 0 for a band without any, or a flat one."""
    v = F.when(F.col("value") > 0, F.col("value"))
    s = _ranges(pixels, v, low, high)
    out = F.coalesce(stretch(F.col("value"), F.col("lo"), F.col("hi")), F.lit(0))
    return pixels.join(s, ["raster_id", "band"]).select("raster_id", "band", "row", "col", out.alias("value"))


def grayscale(pixels: DataFrame, rasters: DataFrame) -> DataFrame:
    """One value a pixel: the mean of two bands where a raster has two, else band 1."""
    df = pixels.where("band <= 2").join(maybe_broadcast(rasters.select("raster_id", "bands")), "raster_id")
    df = df.where((F.col("band") == 1) | ((F.col("bands") == 2) & (F.col("band") == 2)))
    key = ["raster_id", "row", "col"]
    df = df.repartition(tasks(df, pixels.where("band <= 2").count()), *key)
    return df.groupBy(*key).agg(F.avg("value").alias("value"))


def mean_in_polygons(pixels: DataFrame, polygons: DataFrame) -> DataFrame:
    """Mean of finite pixels of each polygon and band."""
    at = pixels.withColumn("x", F.col("col") + 0.5).withColumn("y", F.col("row") + 0.5)
    hit = points_in_polygons(at, polygons)
    fine = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return hit.groupBy("raster_id", "polygon_id", "band").agg(F.avg(fine).alias("mean"), F.count(fine).alias("n"))


def _tile(c: str, tile: int) -> Column:
    return F.floor(F.col(c) / tile).cast("int")


def display_tiles(pixels: DataFrame, tile: int = 32, normalise: bool = True, stats: DataFrame | None = None) -> DataFrame:
    """Display bytes tile by tile. Tiles within 0..1 are always stretched (128 where flat); others if ``normalise`` (0 where
    flat), else they are scaled by the range that their maximum fits in. ``stats`` (raster_id, band, p2, p98) go before a
    tile's own percentiles where they have the band."""
    key = ["raster_id", "ty", "tx", "band"]
    df = pixels.withColumns({"ty": _tile("row", tile), "tx": _tile("col", tile)})
    v = F.col("value")
    s = df.groupBy(*key).agg(F.sort_array(F.collect_list(v)).alias("v"), F.min(v).alias("low"), F.max(v).alias("top"))
    s = s.select(*key, _between(F.col("v"), 0.02).alias("lo"), _between(F.col("v"), 0.98).alias("hi"), "low", "top")
    if stats is not None:
        s = s.join(stats.select("raster_id", "band", "p2", "p98"), ["raster_id", "band"], "left").withColumns({"lo": F.coalesce("p2", "lo"), "hi": F.coalesce("p98", "hi")}).drop("p2", "p98")
    reflectance = (F.col("top") <= 1) & (F.col("low") >= 0)
    full = F.when(F.col("top") <= 255, 255.0).when(F.col("top") <= 65535, 65535.0).otherwise(F.col("top"))
    stretched = F.when(F.col("hi") > F.col("lo"), stretch(v, F.col("lo"), F.col("hi"))).otherwise(F.when(reflectance, 128).otherwise(0))
    raw = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v / full * 255))).cast("int")
    return df.join(s, key).select("raster_id", "band", "row", "col", (stretched if normalise else F.when(reflectance, stretched).otherwise(raw)).alias("value"))


def as_bytes(df: DataFrame, tile: list[str]) -> DataFrame:
    """Exported values of tiles (columns ``tile``, value, dtype): floats of a tile that stays within 1 are scaled by 255, other
    floats and wide integers are cut to a byte."""
    df = df.join(df.groupBy(*tile).agg(F.max("value").alias("top")), tile)
    as_byte = lambda v: F.pmod(v.cast("long"), F.lit(256))
    out = F.when(F.col("dtype").isin("uint8", "uint16"), F.col("value").cast("long")).when(F.col("dtype").startswith("float") & (F.col("top") <= 1), as_byte(F.col("value") * 255)).otherwise(as_byte(F.col("value")))
    return df.withColumn("value", out).drop("top", "dtype")


def export_bytes(pixels: DataFrame, dtype: Column, tile: int = 32) -> DataFrame:
    """Values as tiles that lie side by side export them."""
    df = pixels.withColumns({"ty": _tile("row", tile), "tx": _tile("col", tile), "dtype": dtype})
    return as_bytes(df, ["raster_id", "ty", "tx"]).select("raster_id", "band", "row", "col", "value")


def needs_stretch(pixels: DataFrame, rasters: DataFrame) -> DataFrame:
    """Per raster: floats, or no value above 1."""
    top = pixels.groupBy("raster_id").agg(F.max("value").alias("top"))
    return rasters.join(top, "raster_id", "left").select("raster_id", F.coalesce(F.col("dtype").startswith("float") | (F.col("top") <= 1), F.lit(False)).alias("needs_stretch"))


def standardised(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """(value - mean) / std of a band (stats: band, mean, std)."""
    return pixels.join(stats, "band").select("raster_id", "band", "row", "col", F.try_divide(F.col("value") - F.col("mean"), F.col("std")).alias("value"))


def bilinear(pixels: DataFrame, scale: float, nodata: float | None = None) -> DataFrame:
    """Each output cell from the pixels around its centre by a triangular kernel: one pixel wide on each side, and wider by the
    factor when it shrinks, so that every pixel counts. Weights are those of the pixels that exist and are not ``nodata``,
    brought to a sum of 1; a cell without any is ``nodata``. A row per input pixel and cell it serves, summed before they are
    shuffled: pixels are dealt by blocks, and cells then, to tasks whose number grows with the pixels."""
    size = materialize(pixels.groupBy("raster_id", "band").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.count("*").alias("n")), "sizes")
    count = tasks(pixels, size.agg(F.sum("n")).first()[0] or 0)
    dealt = pixels.withColumns({"_by": _tile("row", 64), "_bx": _tile("col", 64)}).repartition(count, "raster_id", "band", "_by", "_bx")
    df = dealt.join(maybe_broadcast(size.drop("n")), ["raster_id", "band"])
    for c, n in (("row", "height"), ("col", "width")):
        cells = F.greatest(F.lit(1), F.floor(F.col(n) * F.lit(float(scale)))).cast("int")
        df = df.withColumn("cells", cells).withColumn("step", F.col(n) / F.col("cells")).withColumn("reach", F.greatest(F.lit(1.0), "step"))
        first = F.floor((F.col(c) + 0.5 - F.col("reach")) / F.col("step") - 0.5).cast("int")
        last = F.ceil((F.col(c) + 0.5 + F.col("reach")) / F.col("step") - 0.5).cast("int")
        df = df.withColumn(f"o{c}", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.col("cells") - 1))))
        weight = 1 - F.abs(F.col(c) + 0.5 - (F.col(f"o{c}") + 0.5) * F.col("step")) / F.col("reach")
        df = df.withColumn(f"w{c}", weight).where(F.col(f"w{c}") > 1e-12)
    w = F.col("wrow") * F.col("wcol")
    if nodata is not None:
        w = F.when(F.col("value") != nodata, w)
    key = ["raster_id", "band", F.col("orow").alias("row"), F.col("ocol").alias("col")]
    df = df.groupBy("_by", "_bx", *key).agg(F.sum(F.col("value") * w).alias("v"), F.sum(w).alias("w"))  # in the block's task
    cells = count * max(1, round(float(scale) ** 2))
    df = df.repartition(cells, "raster_id", "band", "row", "col").groupBy("raster_id", "band", "row", "col").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    value = F.col("v") / F.col("w")
    return df.select("raster_id", "band", "row", "col", (value if nodata is None else F.coalesce(value, F.lit(float(nodata)))).alias("value"))


def optimal_dimension(width: Column, height: Column, bands: Column, dtype: Column, budget_mb: float = 200.0) -> Column:
    """Longest side at which a raster fits in ``budget_mb``."""
    each = F.when(dtype.contains("uint16"), 2).when(dtype.contains("float"), 4).otherwise(1)
    mb, side = width.cast("double") * height * bands * each / 2**20, F.greatest(width, height)
    return F.when(mb <= budget_mb, side).otherwise(F.floor(side * F.sqrt(budget_mb / mb))).cast("long")


def optimal_scale(width: Column, height: Column, target: float) -> Column:
    return F.least(F.lit(1.0), F.lit(float(target)) / F.greatest(width, height))


def channels(pixels: DataFrame, count: int) -> DataFrame:
    """Bands 1 to ``count``: later ones go, missing ones are 0."""
    key = ["raster_id", "row", "col"]
    mine = F.when(F.col("band") <= count, F.struct("band", "value"))  # the list leaves nulls out, places stay
    wide = pixels.groupBy(*key).agg(F.map_from_entries(F.collect_list(mine)).alias("m"))
    wide = wide.withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(count))))
    return wide.select("raster_id", "band", "row", "col", F.coalesce(F.try_element_at("m", "band"), F.lit(0.0)).alias("value"))


def remapped(pixels: DataFrame, order: list[int], n_bands: int) -> DataFrame:
    """Channel k is band ``order[k]`` (from 0), or band 0 where there is none such."""
    wanted = [(b if b < n_bands else 0) + 1 for b in order]
    out = F.filter(F.transform(F.array(*map(F.lit, wanted)), lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda s: s["b"] == F.col("band"))
    return pixels.select("raster_id", F.explode(out).alias("s"), "row", "col", "value").select("raster_id", F.col("s.i").alias("channel"), "row", "col", "value")
