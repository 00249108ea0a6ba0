"""GeoJSON as tables: a collection in a file (``lines=False``) or, for what grows, a feature in a line (``lines=True``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo as G

#: ``coordinates`` stays JSON text: its depth depends on the type.
FEATURE = "type string, geometry struct<type: string, coordinates: string>, properties map<string, string>"
XY = "array<double>"


def read_features(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Rows (kind, coordinates, properties); features without a geometry are left out."""
    if lines:
        df = spark.read.schema(FEATURE).json(path)
    else:
        df = spark.read.schema(f"type string, features array<struct<{FEATURE.replace(' string', ': string', 1).replace('geometry ', 'geometry: ').replace('properties ', 'properties: ')}>>").option("multiLine", True).json(path)
        df = df.select(F.explode("features").alias("f")).select("f.*")
    return df.select(F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"), "properties").where("kind IS NOT NULL AND coordinates IS NOT NULL")


def _points(json: Column, nested: str) -> Column:
    return F.from_json(json, nested)


def parts(features: DataFrame) -> DataFrame:
    """A row per part: properties, kind, ``part`` from 0, ``rings`` (the first one outer, the others holes)."""
    c, kind = F.col("coordinates"), F.col("kind")
    line, poly, multi = f"array<{XY}>", f"array<array<{XY}>>", f"array<array<array<{XY}>>>"
    shape = (
        F.when(kind == "Polygon", F.array(_points(c, poly)))
        .when(kind == "MultiPolygon", _points(c, multi))
        .when(kind == "LineString", F.array(F.array(_points(c, line))))
        .when(kind == "MultiLineString", F.transform(_points(c, poly), lambda r: F.array(r)))
        .when(kind == "Point", F.array(F.array(F.array(_points(c, XY)))))
        .when(kind == "MultiPoint", F.transform(_points(c, line), lambda p: F.array(F.array(p))))
    )
    as_rings = lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: G.point(p[0], p[1])))
    return features.select("properties", "kind", F.posexplode(shape).alias("part", "r")).select("properties", "kind", "part", as_rings(F.col("r")).alias("rings"))


def outer_rings(features: DataFrame, least: int = 3) -> DataFrame:
    """The outer ring of each polygon part; rings of fewer than ``least`` points go."""
    df = parts(features).where(F.col("kind").isin("Polygon", "MultiPolygon"))
    return df.select("properties", "part", F.get("rings", F.lit(0)).alias("ring")).where(F.size("ring") >= least)


def lonlat_to_pixel(ring: Column, t: tuple[Column, ...], epsg: Column) -> Column:
    return F.transform(ring, lambda p: G.both(G.crs_point(p["x"], p["y"], epsg), lambda x, y: G.to_pixel(x, y, t)))


def either_to_pixel(ring: Column, t: tuple[Column, ...], epsg: Column) -> Column:
    """Longitude and latitude to pixels if all vertices can be such and the CRS is known, else coordinates of the CRS."""

    def choose(ring: Column) -> Column:
        plausible = F.forall(ring, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
        placed = F.when(plausible, lonlat_to_pixel(ring, t, epsg))
        return G.let(placed, lambda q: F.when(F.exists(q, lambda p: p["x"].isNotNull()), q).otherwise(G.ring_to_pixel(ring, t)))

    return G.let(ring, choose)


def extents(features: DataFrame, by: list[Column]) -> DataFrame:
    """Number of parts and bounds per layer."""
    points = F.flatten("rings")
    side = lambda f, k: f(F.transform(points, lambda p: p[k]))
    df = parts(features).select(*by, side(F.array_min, "x").alias("ax"), side(F.array_min, "y").alias("ay"), side(F.array_max, "x").alias("bx"), side(F.array_max, "y").alias("by"))
    agg = [F.count("*").alias("n"), F.min("ax").alias("min_x"), F.min("ay").alias("min_y"), F.max("bx").alias("max_x"), F.max("by").alias("max_y")]
    return df.groupBy(*df.columns[: len(by)]).agg(*agg)


def layer_summary(features: DataFrame, by: list[Column], order: Column) -> DataFrame:
    """Per layer: number of features, type of the first one by ``order``, all names of fields (sorted), parts and bounds."""
    fields = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("properties")))))  # as many as a layer has fields
    df = features.select(*by, "kind", "properties", order.alias("_order"))
    key = df.columns[: len(by)]
    top = df.groupBy(*key).agg(F.count("*").alias("n_features"), F.min_by("kind", "_order").alias("kind"), fields.alias("fields"))
    return top.join(extents(features, by).withColumnRenamed("n", "n_parts"), key)
