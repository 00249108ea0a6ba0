"""Tables of centroids and of drawn polygons, kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.functions import geo as G

PLACE = ["raster_id", *"abcdef"]


def circles(detections: DataFrame, rasters: DataFrame) -> DataFrame:
    """Each detection's centre, in pixels and in the CRS, with its inscribed circle."""
    df = detections.join(rasters.select(*PLACE), "raster_id")
    x, y = B.centre(B.cols())
    gx, gy = G.to_crs(x, y, G.transform_cols())
    sizes = [v.alias(k) for k, v in B.circle(B.cols(), F.col("a"), F.col("e")).items()]
    return df.select("raster_id", F.col("det_id").alias("id"), x.alias("x"), y.alias("y"), gx.alias("geo_x"), gy.alias("geo_y"), *sizes, F.lit("detection").alias("source"))


def with_manual(centroids: DataFrame, points: DataFrame, rasters: DataFrame) -> DataFrame:
    """Adds points (raster_id, point_id, x, y) set by hand: their ids follow the raster's largest, they have no circle."""
    top = centroids.groupBy("raster_id").agg(F.max("id").alias("top"))
    df = points.join(rasters.select(*PLACE), "raster_id").join(top, "raster_id", "left")
    nth = F.row_number().over(Window.partitionBy("raster_id").orderBy("point_id"))
    gx, gy = G.to_crs(F.col("x"), F.col("y"), G.transform_cols())
    new = df.select("raster_id", (F.coalesce("top", F.lit(0)) + nth).cast("long").alias("id"), "x", "y", gx.alias("geo_x"), gy.alias("geo_y"), F.lit("manual").alias("source"))
    return centroids.unionByName(new, allowMissingColumns=True)


def replaced(table: DataFrame, new: DataFrame) -> DataFrame:
    """``table`` with the rows of every raster that ``new`` has replaced by its rows."""
    return table.join(new.select("raster_id").distinct(), "raster_id", "left_anti").unionByName(new)


def _shaped(df: DataFrame, rasters: DataFrame) -> DataFrame:
    """Adds the ring in the CRS and its area in m2."""
    df = df.join(rasters.select(*PLACE, "epsg"), "raster_id").withColumn("ring_crs", G.ring_to_crs(F.col("ring"), G.transform_cols()))
    return df.withColumn("area", G.area_m2(F.col("ring_crs"), F.col("epsg")))


def _record(number: Column) -> list[Column | str]:
    return ["raster_id", "polygon_id", number.alias("number"), F.concat(F.lit("Polygon "), number).alias("name"), "ring", "ring_crs", "area"]


def polygon_records(polygons: DataFrame, rasters: DataFrame) -> DataFrame:
    """Polygons numbered and named in their raster, with both rings and the area."""
    nth = F.row_number().over(Window.partitionBy("raster_id").orderBy("polygon_id"))
    return _shaped(polygons.select("raster_id", "polygon_id", "ring"), rasters).select(*_record(nth))


def refreshed(records: DataFrame, edits: DataFrame, rasters: DataFrame) -> DataFrame:
    """Upsert of edits (raster_id, polygon_id, ring): known polygons keep number and name, others are numbered on."""
    key = ["raster_id", "polygon_id"]
    known = records.select(*key, "number")
    top = known.groupBy("raster_id").agg(F.max("number").alias("top"))
    df = edits.select(*key, "ring").join(known, key, "left").join(top, "raster_id", "left")
    nth = F.row_number().over(Window.partitionBy("raster_id", F.col("number").isNull()).orderBy("polygon_id"))
    df = df.withColumn("number", F.coalesce("number", F.coalesce("top", F.lit(0)) + nth))
    return records.join(edits.select(*key), key, "left_anti").unionByName(_shaped(df, rasters).select(*_record(F.col("number"))))


def without_layers(tables: dict[str, DataFrame], layers: DataFrame) -> dict[str, DataFrame]:
    """The tables without any row of the layers (raster_id) that were removed; all of a table goes where it has no other."""
    gone = layers.select("raster_id").distinct()
    return {name: df.join(gone, "raster_id", "left_anti") for name, df in tables.items()}


def layer_contents(rasters: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows that each table holds of each raster; counted before they are joined."""
    df = rasters.select("raster_id")
    for name, t in tables.items():
        df = df.join(t.groupBy("raster_id").agg(F.count("*").alias(name)), "raster_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return df


def samples(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``order``; groups are cut to ``k`` before the shuffle too."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("nth", nth).where(F.col("nth") <= k)
