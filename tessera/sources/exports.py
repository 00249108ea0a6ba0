"""Sinks: features as GeoJSON text, one in a line, and the tables of a training export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.functions import geo as G
from tessera.operators import grid
from tessera.operators import pixels as values


def feature(kind: str, coordinates: Column, **properties: Column) -> Column:
    """One GeoJSON feature as text."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")), {"ignoreNullFields": "false"})


def _pairs(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(p["x"], p["y"]))


def centroid_features(detections: DataFrame, names: Column) -> DataFrame:
    """Box centres as points in longitude and latitude; (0, 0) without a CRS. Detections carry a..f and epsg."""
    lon, lat = G.to_lonlat(*G.to_crs(*B.centre(B.cols()), G.transform_cols()), F.col("epsg"))
    at = F.array(*[F.when(F.col("epsg").isNull(), 0.0).otherwise(v) for v in (lon, lat)])
    return detections.select(feature("Point", at, id=F.col("det_id"), raster_id=F.col("raster_id"), class_name=B.class_name(F.col("class_id"), names)).alias("value"))


def polygon_features(polygons: DataFrame) -> DataFrame:
    """Drawn polygons (ring in pixels, a..f, epsg) in longitude and latitude, closed; those without a CRS go."""
    ring = F.transform(G.closed(F.col("ring")), lambda p: G.lonlat_point(*G.to_crs(p["x"], p["y"], G.transform_cols()), F.col("epsg")))
    df = polygons.where("epsg IS NOT NULL")
    name = F.concat(F.lit("Polygon "), F.col("polygon_id"))
    return df.select(feature("Polygon", F.array(_pairs(ring)), id=F.col("polygon_id"), raster_id=F.col("raster_id"), name=name, valid=G.simple(F.col("ring"))).alias("value"))


def polygon_rows(polygons: DataFrame) -> DataFrame:
    """Drawn polygons in the CRS: closed, exterior clockwise, with number, name and area in m2."""
    df = polygons.withColumn("ring", G.clockwise(G.ring_to_crs(F.col("ring"), G.transform_cols())))
    return df.select("raster_id", "polygon_id", F.concat(F.lit("Polygon "), F.col("polygon_id")).alias("name"), G.area_m2(F.col("ring"), F.col("epsg")).alias("area"), "ring")


def detection_features(detections: DataFrame, names: Column, lonlat: bool = False) -> DataFrame:
    """Boxes as polygons in the CRS or in longitude and latitude; in pixels without a CRS."""
    known = F.col("epsg").isNotNull()

    def place(p: Column) -> Column:
        at = G.point(*G.to_crs(p["x"], p["y"], G.transform_cols()))
        at = G.let(at, lambda q: G.lonlat_point(q["x"], q["y"], F.col("epsg"))) if lonlat else at
        return G.let(F.when(known, at).otherwise(p), lambda q: F.array(q["x"], q["y"]))

    ring = F.transform(G.closed(B.ring(B.cols())), place)
    return detections.select(feature("Polygon", F.array(ring), id=F.col("det_id"), class_name=B.class_name(F.col("class_id"), names), score=F.round("score", 4)).alias("value"))


def detection_records(detections: DataFrame, names: Column) -> DataFrame:
    """Raw detections in pixels, to be written as JSON partitioned by raster_id."""
    score = F.col("score")
    return detections.select(F.col("det_id").alias("id"), "raster_id", B.class_name(F.col("class_id"), names).alias("class"), score, F.array(*B.cols()).alias("box"))


def training_tiles(rasters: DataFrame, tile: int = 640, overlap: int = 64) -> DataFrame:
    """Full tiles with the names of their files; to be written partitioned by raster_id."""
    stride = tile - overlap
    df = grid.training_windows(rasters, tile, overlap)
    ty, tx = F.floor(F.col("y_off") / stride).cast("int"), F.floor(F.col("x_off") / stride).cast("int")
    return df.select("raster_id", "x_off", "y_off", *[F.format_string(f"{kind}_%04d_%04d", ty, tx).alias(f"{kind}_name") for kind in ("tile", "mask")])


def training_pixels(pixels: DataFrame, rasters: DataFrame, tile: int = 640, overlap: int = 64, gray: bool = False) -> DataFrame:
    """Exported pixels of the full tiles, by tile name and place in the tile; to be written partitioned by raster_id.

    A pixel goes to each tile that covers it, four at most where the overlap is under half a tile; what lies beyond the last full
    tile goes nowhere. ``gray`` leaves one band. Rasters carry width, height, bands and dtype.
    """
    stride = tile - overlap
    df = values.grayscale(pixels, rasters).withColumn("band", F.lit(1)) if gray else pixels
    df = df.join(rasters.select("raster_id", "width", "height", "dtype"), "raster_id")
    for at, c, m in (("ty", "row", "height"), ("tx", "col", "width")):
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - tile + 1) / stride)).cast("int")
        last = F.least(F.floor(F.col(c) / stride), F.greatest(F.lit(1), F.floor((F.col(m) - overlap) / stride)) - 1).cast("int")
        df = df.withColumn(at, F.explode(F.when(first <= last, F.sequence(first, last))))
    place = [(F.col(c) - F.col(at) * stride).alias(c) for at, c in (("ty", "row"), ("tx", "col"))]
    name = F.format_string("tile_%04d_%04d", "ty", "tx").alias("tile_name")
    return values.as_bytes(df, ["raster_id", "ty", "tx"]).select("raster_id", name, "band", *place, "value")


def export_metadata(rasters: DataFrame, tile: int = 640, overlap: int = 64, masks: bool = False, grayscale: bool = False) -> DataFrame:
    """What a training export consists of, a row per raster."""
    stride = tile - overlap
    count = lambda n: F.greatest(F.lit(1), F.floor((F.col(n) - overlap) / stride)).cast("long")
    return rasters.select(
        "raster_id", F.lit(tile).alias("tile_size_px"), F.lit(overlap).alias("overlap_px"), F.lit(stride).alias("stride_px"),
        count("width").alias("num_tiles_x"), count("height").alias("num_tiles_y"), (count("width") * count("height")).alias("total_tiles"),
        F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.when(F.lit(grayscale), 1).otherwise(F.col("bands")).alias("image_channels"),
        F.lit(masks).alias("exported_masks"), F.lit(grayscale).alias("exported_as_grayscale"),
    )
