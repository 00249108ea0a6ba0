"""Detections read back from saved tables, metrics of centroids, and the registry of models and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.functions import geo as G

#: Fixed value: label of a detection without one.
LABEL = "sawit"
SIDES = ("x1", "y1", "x2", "y2")


def _first(df: DataFrame, names: tuple[str, ...], default) -> Column:
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default))


def box_from_ring(ring: Column, t: tuple[Column, ...], width: Column, height: Column) -> Column:
    """Pixel box of a ring in the CRS: of its vertices inside the raster, or of the ring as it is if none is; sides of
    no length become 1. Null without vertices."""
    pixel = F.filter(G.ring_to_pixel(ring, t), lambda p: p["x"].between(0, width) & p["y"].between(0, height))
    points = F.when(F.size(pixel) > 0, pixel).otherwise(ring)
    side = lambda f, k: f(F.transform(points, lambda p: p[k]))
    x1, y1, x2, y2 = side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")
    return F.when(F.size(ring) > 0, F.struct(x1.alias("x1"), y1.alias("y1"), F.when(x2 <= x1, x1 + 1).otherwise(x2).alias("x2"), F.when(y2 <= y1, y1 + 1).otherwise(y2).alias("y2")))


def _classed(df: DataFrame, names: Column | None) -> DataFrame:
    """``class_id`` by the order in which labels first come up (``row_no``) in a raster, or by ``names``: an error if unknown."""
    if names is not None:
        at = F.array_position(names, F.col("label"))
        return df.withColumn("class_id", F.when(at > 0, at.cast("int") - 1).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.col("label"))).cast("int")))
    first = df.groupBy("raster_id", "label").agg(F.min("row_no").alias("seen"))  # few labels a raster
    ids = first.withColumn("class_id", F.row_number().over(Window.partitionBy("raster_id").orderBy("seen")) - 1)
    return df.join(ids.select("raster_id", "label", "class_id"), ["raster_id", "label"])


def from_fields(saved: DataFrame) -> DataFrame:
    """Boxes, scores and classes by the fields alone (raster_id, row_no, x1_px.., confidence, kelas)."""
    label = F.coalesce(F.when(F.col("kelas") != "", F.col("kelas")), F.lit(LABEL))
    df = saved.select("raster_id", "row_no", *[_first(saved, (f"{c}_px",), 0.0).alias(c) for c in SIDES], _first(saved, ("confidence",), 0.0).alias("score"), label.alias("label"))
    return _classed(df, None)


def from_geometry(saved: DataFrame, rasters: DataFrame, names: Column | None = None) -> DataFrame:
    """The same with the ring as the truth: fields count only where there is none. Fields may have their short names."""
    label = _first(saved, ("kelas", "class", "label"), LABEL)
    df = saved.join(rasters.select("raster_id", "width", "height", *"abcdef"), "raster_id")
    old = [_first(saved, (f"{c}_px", c), 0.0) for c in SIDES]
    fields = F.struct(old[0].alias("x1"), old[1].alias("y1"), F.when(old[2] <= old[0], old[0] + 1).otherwise(old[2]).alias("x2"), F.when(old[3] <= old[1], old[1] + 1).otherwise(old[3]).alias("y2"))
    box = F.coalesce(box_from_ring(F.col("ring"), G.transform_cols(), F.col("width"), F.col("height")), fields)
    df = df.select("raster_id", "row_no", box.alias("b"), _first(saved, ("confidence", "score"), 0.0).alias("score"), F.when(label != "", label).otherwise(LABEL).alias("label"))
    return _classed(df.select("raster_id", "row_no", "b.*", "score", "label"), names)


def centroid_metrics(detections: DataFrame, rasters: DataFrame, digits: int = 8, metric_digits: int | None = None) -> DataFrame:
    """Latitude, Longitude, radius_m, diameter_m, area_m2 of each box, rounded half to even; (0, 0) without a CRS."""
    df = detections.join(rasters.select("raster_id", "epsg", *"abcdef"), "raster_id")
    lon, lat = G.to_lonlat(*G.to_crs(*B.centre(B.cols()), G.transform_cols()), F.col("epsg"))
    m = B.circle(B.cols(), F.col("a"), F.col("e"))
    at = lambda v: F.bround(F.coalesce(v, F.lit(0.0)), digits)
    size = {k: F.bround(m[k], digits if metric_digits is None else metric_digits).alias(k) for k in ("radius_m", "diameter_m", "area_m2")}
    return df.select("raster_id", "det_id", at(lat).alias("Latitude"), at(lon).alias("Longitude"), *size.values())


def centroid_points(centroids: DataFrame) -> DataFrame:
    """Centroids (raster_id, id, geo_x, geo_y, radius_m, epsg) as points with two digits; no radius counts as 0."""
    r = F.coalesce("radius_m", F.lit(0.0))
    two = lambda v, k: F.bround(v, 2).alias(k)
    return centroids.select("raster_id", "id", F.col("geo_y").alias("lat"), F.col("geo_x").alias("lon"), two(r, "radius_m"), two(r * 2, "diameter_m"), two(F.pi() * r * r, "area_m2"), F.coalesce("epsg", F.lit(4326)).alias("epsg"))


def canopy_circles(centroids: DataFrame) -> DataFrame:
    """Ring of 65 points around each centroid with a radius."""
    return centroids.where("radius_m > 0").select("raster_id", "id", G.circle_ring(F.col("geo_x"), F.col("geo_y"), F.col("radius_m")).alias("ring"))


def zonal_table(means: DataFrame, zones: DataFrame, bands: list[int]) -> DataFrame:
    """Zonal means (raster_id, zone_id, band, mean) as a wide table: ID, Easting, Northing, Band_k_mean."""
    wide = means.groupBy("raster_id", "zone_id").pivot("band", bands).agg(F.first("mean"))
    named = wide.select("raster_id", "zone_id", *[F.col(str(b)).alias(f"Band_{b}_mean") for b in bands])
    df = zones.select("raster_id", "zone_id", "easting", "northing").join(named, ["raster_id", "zone_id"], "left")
    return df.select("raster_id", F.col("zone_id").alias("ID"), F.col("easting").alias("Easting"), F.col("northing").alias("Northing"), *[f"Band_{b}_mean" for b in bands])


def centre_values(detections: DataFrame, pixels: DataFrame) -> DataFrame:
    """Value of each band at the pixel nearest to a box's centre (half to even); null outside the raster."""
    at = lambda v: F.rint(v).cast("int")
    cx, cy = B.centre(B.cols())
    df = detections.select("raster_id", "det_id", at(cx).alias("col"), at(cy).alias("row"))
    return df.join(pixels, ["raster_id", "row", "col"], "left").select("raster_id", "det_id", "band", "value")


def registered(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Runs of models that are registered: only these may go on."""
    return runs.join(models.select("model_name").distinct(), "model_name", "left_semi")


def model_named(models: DataFrame, name: str) -> DataFrame:
    """The model of this name; an error if it is not registered."""
    df = models.where(F.col("model_name") == name)
    if df.isEmpty():
        raise ValueError(f"model {name!r} is not registered")
    return df


def model_list(models: DataFrame) -> DataFrame:
    """Names and descriptions, by name; the stored files are not read."""
    return models.select("model_name", F.coalesce("description", F.lit("")).alias("description")).orderBy("model_name")


def without_models(models: DataFrame, names: DataFrame) -> DataFrame:
    return models.join(names.select("model_name"), "model_name", "left_anti")


def deletions(models: DataFrame, names: DataFrame) -> DataFrame:
    """Whether each name to be deleted was registered."""
    return names.select("model_name").distinct().join(models.select("model_name", F.lit(True).alias("hit")).distinct(), "model_name", "left").select("model_name", F.coalesce("hit", F.lit(False)).alias("hit"))


def appended_runs(log: DataFrame, new: DataFrame) -> DataFrame:
    """Run log with new rows; their ids follow the largest. New runs (``created_at`` in order) come in small numbers."""
    top = log.agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("top"))
    nth = F.row_number().over(Window.orderBy("created_at"))
    numbered = new.join(F.broadcast(top), F.lit(True)).withColumn("run_id", (F.col("top") + nth).cast("long")).drop("top")
    return log.unionByName(numbered.select(*log.columns))


def log_rows(rows: DataFrame) -> DataFrame:
    """Rows as JSON text, one in a line."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def numbered(df: DataFrame, order: str, by: str = "raster_id", slice_ids: int = 1 << 16) -> DataFrame:
    """Adds ``nth``, the place from 1 in each group by ``order`` (whole numbers, none twice): counted in slices of ids, so that
    a task holds ``slice_ids`` rows at most, and sums over slices give where each begins."""
    at = F.floor(F.col(order) / slice_ids)
    df = df.withColumn("_slice", at)
    before = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(by, "_slice").agg(F.count("*").alias("_n")).select(by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(by, "_slice").orderBy(order))
    return df.withColumn("nth", inside).join(starts, [by, "_slice"]).withColumn("nth", F.col("nth") + F.col("_start")).drop("_slice", "_start")


#: Lengths to which the text fields of a saved table are cut, and what an untouched detection is called.
NAME_CHARS, MODEL_CHARS, UNTOUCHED = 20, 30, "not_corrected"


def raw_detections(detections: DataFrame, rasters: DataFrame, model: Column, names: Column, order: str = "det_id") -> DataFrame:
    """Saved table of a run: id from 1 in each raster, kelas, confidence, model, box in pixels, status and a closed ring.

    The ring runs between the box's corners in the CRS, each in the middle of its pixel and the sides along the axes; without a
    CRS pixels are one unit with y downwards negative. Numbers are rounded half to even.
    """
    plain = dict(zip("abcdef", (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)))
    place = rasters.select("raster_id", *[F.when(F.col("epsg").isNull(), v).otherwise(F.col(k)).alias(k) for k, v in plain.items()])
    df = numbered(detections, order).join(place, "raster_id")
    (ax, ay), (bx, by) = (G.to_crs(F.col(x) + 0.5, F.col(y) + 0.5, G.transform_cols()) for x, y in (SIDES[:2], SIDES[2:]))
    return df.select(
        "raster_id", F.col("nth").cast("long").alias("id"), F.substring(B.class_name(F.col("class_id"), names), 1, NAME_CHARS).alias("kelas"), F.bround("score", 4).alias("confidence"),
        F.substring(model, 1, MODEL_CHARS).alias("model"), *[F.bround(c, 1).alias(f"{c}_px") for c in SIDES], F.lit(UNTOUCHED).alias("status"), B.ring((ax, ay, bx, by)).alias("ring"),
    )
