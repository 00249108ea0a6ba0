"""Queries over vector sources, exports, calibration and the remaining pixel operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo as G
from tessera.operators import pixels
from tessera.operators.storage import shared_dir, spread
from tessera.plans.queries import query, r6
from tessera.sources import exports, vector

TIE = 0.0000000123


def names():
    return F.create_map(F.lit(0), F.lit("palm"), F.lit(1), F.lit("tree"))


def written(features: DataFrame) -> DataFrame:
    """The features as GeoJSON text in the shared folder, read again."""
    path = f"{shared_dir(features.sparkSession)}/tessera/{uuid.uuid4().hex}/features"
    features.write.text(path)
    return vector.read_features(features.sparkSession, path)


def prop(name: str, kind: str = "bigint"):
    return F.col("properties")[name].cast(kind).alias(name)


NAME_SQL = "CASE class_id WHEN 0 THEN 'palm' WHEN 1 THEN 'tree' ELSE CAST(class_id AS VARCHAR) END"


@query("k10_detection_features", f"SELECT det_id AS id, {NAME_SQL} AS class_name, CAST(5 AS INT) AS n_points, round(CASE WHEN epsg IS NULL THEN x1 ELSE c+x1*a END,7) AS min_x, round(CASE WHEN epsg IS NULL THEN y2 ELSE f+y1*e END,7) AS max_y FROM detections JOIN rasters USING (raster_id)", "detections rasters")
def _(t):
    rings = vector.outer_rings(written(exports.detection_features(t.detections.join(t.rasters, "raster_id"), names())))
    side = lambda f, k: F.round(f(F.transform("ring", lambda p: p[k])), 7)
    return rings.select(prop("id"), prop("class_name", "string"), F.size("ring").alias("n_points"), side(F.array_min, "x").alias("min_x"), side(F.array_max, "y").alias("max_y"))


@query("k10_lonlat_features", f"SELECT det_id AS id, {NAME_SQL} AS class_name, round(CASE WHEN epsg IS NULL THEN x1 ELSE c+x1*a END,7) AS min_x, round(CASE WHEN epsg IS NULL THEN y2 ELSE f+y1*e END,7) AS max_y FROM detections JOIN rasters USING (raster_id) WHERE epsg IS NULL OR epsg=4326 UNION ALL SELECT det_id, {NAME_SQL}, round(x1,3), round(y1,3) FROM detections JOIN rasters USING (raster_id) WHERE epsg=32648", "detections rasters")
def _(t):
    """Projected rings are brought back to pixels to be compared."""
    rings = vector.outer_rings(written(exports.detection_features(spread(t.detections.join(t.rasters, "raster_id")), names(), lonlat=True)))
    df = rings.select(prop("id"), prop("class_name", "string"), "ring").join(t.detections.select(F.col("det_id").alias("id"), "raster_id"), "id").join(t.rasters, "raster_id")
    df = spread(df).withColumn("back", vector.lonlat_to_pixel(F.col("ring"), G.transform_cols(), F.col("epsg")))
    projected = F.col("epsg") == 32648
    x = F.when(projected, F.round(F.array_min("back.x"), 3)).otherwise(F.round(F.array_min("ring.x"), 7))
    y = F.when(projected, F.round(F.array_min("back.y"), 3)).otherwise(F.round(F.array_max("ring.y"), 7))
    return df.select("id", "class_name", x.alias("min_x"), y.alias("max_y"))


@query("k10_raw_records", f"SELECT det_id, raster_id, {NAME_SQL} AS class_name, round(score,6) AS score, x1, y1, x2, y2 FROM detections", "detections")
def _(t):
    """Written as JSON lines and read again."""
    path = f"{shared_dir(t.spark)}/tessera/{uuid.uuid4().hex}/records"
    exports.detection_records(t.detections, names()).write.partitionBy("raster_id").json(path)
    df = t.spark.read.schema("id bigint, class string, score double, box array<double>, raster_id int").json(path)
    return df.select(F.col("id").alias("det_id"), "raster_id", F.col("class").alias("class_name"), r6(F.col("score"), "score"), *[F.col("box")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("k4_centroid_features", f"SELECT det_id AS id, {NAME_SQL} AS class_name, CASE WHEN epsg IS NULL THEN 0 ELSE round((x1+x2)/2,3) END AS x, CASE WHEN epsg IS NULL THEN 0 ELSE round((y1+y2)/2,3) END AS y FROM detections JOIN rasters USING (raster_id)", "detections rasters")
def _(t):
    points = vector.parts(written(exports.centroid_features(t.detections.join(t.rasters, "raster_id"), names())))
    df = points.select(prop("id"), prop("class_name", "string"), prop("raster_id", "int"), F.col("rings")[0][0].alias("p")).join(t.rasters, "raster_id")
    x, y = G.to_pixel(*G.from_lonlat(F.col("p.x"), F.col("p.y"), F.col("epsg")), G.transform_cols())
    known = lambda v: F.when(F.col("epsg").isNull(), 0.0).otherwise(F.round(v, 3))
    return df.select("id", "class_name", known(x).alias("x"), known(y).alias("y"))


@query("s8_polygons_from_features", "SELECT polygon_id AS id, 'Polygon ' || polygon_id AS name, CAST(CASE WHEN polygon_id%2=1 THEN 4 ELSE 5 END AS INT) AS n_points, round(px,2) AS min_x, round(py,2) AS min_y, round(CASE WHEN polygon_id%2=1 THEN side*side/2 ELSE side*side END) AS area FROM polygons JOIN rasters USING (raster_id) WHERE epsg IS NOT NULL", "polygons rasters")
def _(t):
    rings = vector.outer_rings(written(exports.polygon_features(t.polygons.join(t.rasters, "raster_id"))))
    df = rings.select(prop("id"), prop("name", "string"), prop("raster_id", "int"), "ring").join(t.rasters, "raster_id")
    df = df.withColumn("ring", vector.lonlat_to_pixel(F.col("ring"), G.transform_cols(), F.col("epsg")))
    low = lambda k: F.round(F.array_min(F.transform("ring", lambda p: p[k])), 2)
    return df.select("id", "name", F.size("ring").alias("n_points"), low("x").alias("min_x"), low("y").alias("min_y"), F.round(F.abs(G.signed_area(F.col("ring")))).alias("area"))


@query("s6_layer_extents", "SELECT raster_id, count(*) AS n, round(min(c+px*a),7) AS min_x, round(max(f+py*e),7) AS max_y FROM polygons JOIN rasters USING (raster_id) WHERE epsg=4326 GROUP BY 1 UNION ALL SELECT raster_id, count(*), NULL, NULL FROM polygons JOIN rasters USING (raster_id) WHERE epsg=32648 GROUP BY 1", "polygons rasters")
def _(t):
    layers = vector.extents(written(exports.polygon_features(t.polygons.join(t.rasters, "raster_id"))), [prop("raster_id", "int")])
    plain = lambda c: F.when(F.col("epsg") == 4326, F.round(c, 7)).alias(c)
    return layers.join(t.rasters, "raster_id").select("raster_id", "n", plain("min_x"), plain("max_y"))


@query("a10_layer_summary", "SELECT raster_id, count(*)+count(*) FILTER (polygon_id%5=4) AS n_features, CASE WHEN min(polygon_id)%5=4 THEN 'Point' ELSE 'Polygon' END AS kind, CASE WHEN bool_or(polygon_id%5=4) THEN 'id, mark, name, raster_id, valid' ELSE 'id, name, raster_id, valid' END AS fields, round(min(CASE WHEN epsg=4326 THEN c+px*a END),7) AS min_x, round(max(CASE WHEN epsg=4326 THEN f+py*e END),7) AS max_y FROM polygons JOIN rasters USING (raster_id) WHERE epsg IS NOT NULL GROUP BY 1", "polygons rasters")
def _(t):
    """Polygons, and before each fifth of them a point at its corner with a field of its own."""
    places = t.polygons.join(t.rasters, "raster_id").where("epsg IS NOT NULL")
    lon, lat = G.to_lonlat(*G.to_crs(F.col("px"), F.col("py"), G.transform_cols()), F.col("epsg"))
    marks = places.where("polygon_id % 5 = 4").select(exports.feature("Point", F.array(lon, lat), id=F.col("polygon_id") - 0.5, raster_id=F.col("raster_id"), mark=F.lit("corner")).alias("value"))
    layers = vector.layer_summary(written(exports.polygon_features(places).unionByName(marks)), [prop("raster_id", "int")], F.col("properties")["id"].cast("double"))
    df = layers.join(t.rasters, "raster_id")
    plain = lambda c: F.when(F.col("epsg") == 4326, F.round(c, 7)).alias(c)
    return df.select("raster_id", "n_features", "kind", F.array_join("fields", ", ").alias("fields"), plain("min_x"), plain("max_y"))


@query("k9_polygon_rows", "WITH h AS (SELECT *, sin(radians(f+py*e)) AS s1, sin(radians(f+(py+side)*e)) AS s2, 0.0066943799901413165::DOUBLE AS e2, 0.08181919084262149::DOUBLE AS e1 FROM polygons JOIN rasters USING (raster_id)) SELECT polygon_id, 'Polygon ' || polygon_id AS name, round(CASE WHEN epsg=4326 THEN 0.9996*0.9996*6378137.0::DOUBLE*6378137.0*radians(side*a)*(1-e2)/2*(s1/(1-e2*s1*s1)+atanh(e1*s1)/e1-s2/(1-e2*s2*s2)-atanh(e1*s2)/e1) ELSE side*side*a*a END/CASE WHEN polygon_id%2=1 THEN 2 ELSE 1 END,0) AS area, true AS is_clockwise, CAST(CASE WHEN polygon_id%2=1 THEN 4 ELSE 5 END AS INT) AS n_points FROM h", "polygons rasters")
def _(t):
    df = exports.polygon_rows(t.polygons.join(t.rasters, "raster_id"))
    return df.select("polygon_id", "name", F.round("area", 0).alias("area"), (G.signed_area(F.col("ring")) < 0).alias("is_clockwise"), F.size("ring").alias("n_points"))


@query("k11_training_tiles", "SELECT raster_id, x*576 AS x_off, y*576 AS y_off, printf('tile_%04d_%04d', y, x) AS tile_name, printf('mask_%04d_%04d', y, x) AS mask_name FROM rasters, (SELECT CAST(range AS INT) AS x FROM range(3)), (SELECT CAST(range AS INT) AS y FROM range(3))", "rasters")
def _(t):
    return exports.training_tiles(t.rasters)


@query("k11_training_pixels", """WITH s AS (SELECT raster_id, max(row)+1 AS h, max(col)+1 AS w FROM pixels GROUP BY 1), u AS (SELECT raster_id, band, row, col, CASE WHEN col<40 THEN value/10000.0::DOUBLE ELSE value END AS value FROM pixels),
    v AS (SELECT 'colour' AS kind, * FROM u UNION ALL SELECT 'gray', raster_id, 1, row, col, avg(value) FROM u WHERE band<=2 GROUP BY raster_id, row, col),
    g AS (SELECT raster_id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty FROM (SELECT *, unnest(range(greatest(1,(h-8)//32))) AS ty FROM s), range(3) x(tx) WHERE tx<greatest(1,(w-8)//32)),
    m AS (SELECT v.*, tx, ty FROM v JOIN g ON v.raster_id=g.raster_id AND col BETWEEN tx*32 AND tx*32+39 AND row BETWEEN ty*32 AND ty*32+39)
    SELECT kind, raster_id, printf('tile_%04d_%04d', ty, tx) AS tile_name, band, row-ty*32 AS row, col-tx*32 AS col, ((CAST(trunc(CASE WHEN top<=1 THEN value*255 ELSE value END) AS BIGINT)%256)+256)%256 AS value FROM (SELECT *, max(value) OVER (PARTITION BY kind, raster_id, tx, ty) AS top FROM m)""", "pixels")
def _(t):
    """The first 40 columns hold values within 1; gray tiles are those of two bands."""
    df = t.pixels.withColumn("value", F.when(F.col("col") < 40, F.col("value") / 10000.0).otherwise(F.col("value")))
    size = df.groupBy("raster_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")).withColumn("dtype", F.lit("float32"))
    colour = exports.training_pixels(df, size, 40, 8).withColumn("kind", F.lit("colour"))
    return colour.unionByName(exports.training_pixels(df.where("band <= 2"), size.withColumn("bands", F.lit(2)), 40, 8, gray=True).withColumn("kind", F.lit("gray")))


@query("k12_export_metadata", "SELECT raster_id, CAST(3 AS BIGINT) AS num_tiles_x, CAST(9 AS BIGINT) AS total_tiles, width AS image_width, bands AS image_channels FROM rasters", "rasters")
def _(t):
    return exports.export_metadata(t.rasters).select("raster_id", "num_tiles_x", "total_tiles", "image_width", "image_channels")


@query("p4_display_tiles", "WITH s AS (SELECT raster_id, band, floor(row/32) AS ty, floor(col/32) AS tx, quantile_cont(value,0.02) AS lo, quantile_cont(value,0.98) AS hi FROM pixels GROUP BY ALL) SELECT p.raster_id, p.band, row, col, CAST(CASE WHEN hi>lo THEN floor((greatest(lo,least(hi,value))-lo)/(hi-lo)*255) ELSE 0 END AS INT) AS value FROM pixels p JOIN s ON p.raster_id=s.raster_id AND p.band=s.band AND floor(row/32)=ty AND floor(col/32)=tx", "pixels")
def _(t):
    return pixels.display_tiles(t.pixels)


@query("p4_display_raw", "WITH s AS (SELECT raster_id, band, floor(row/32) AS ty, floor(col/32) AS tx, max(value) AS top FROM pixels GROUP BY ALL) SELECT p.raster_id, p.band, row, col, CAST(floor(greatest(0.0,least(255.0,value/CASE WHEN top<=255 THEN 255.0::DOUBLE WHEN top<=65535 THEN 65535.0::DOUBLE ELSE top END*255))) AS INT) AS value FROM pixels p JOIN s ON p.raster_id=s.raster_id AND p.band=s.band AND floor(row/32)=ty AND floor(col/32)=tx", "pixels")
def _(t):
    return pixels.display_tiles(t.pixels, normalise=False)


@query("p13_export_bytes", "SELECT raster_id, band, row, col, ((CAST(trunc(value) AS BIGINT)%256)+256)%256 AS value FROM pixels", "pixels")
def _(t):
    return pixels.export_bytes(t.pixels, F.lit("float32"))


@query("p14_needs_stretch", "SELECT raster_id, true AS needs_stretch FROM rasters", "rasters")
def _(t):
    return pixels.needs_stretch(t.pixels, t.rasters)


@query("p15_standardised", "WITH s AS (SELECT band, avg(value) AS m, stddev_pop(value) AS d FROM pixels GROUP BY 1) SELECT raster_id, band, row, col, round((value-m)/d,6) AS value FROM pixels JOIN s USING (band)", "pixels")
def _(t):
    stats = t.pixels.groupBy("band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return pixels.standardised(t.pixels, stats).withColumn("value", F.round("value", 6))


#: Rows first, then columns, weights of each axis listed; halves, three tenths and twice the size.
RESAMPLED = f"""WITH o AS (SELECT raster_id, band, k, h, w, greatest(1,floor(h*k))::INT AS oh, greatest(1,floor(w*k))::INT AS ow FROM (SELECT raster_id, band, max(row)+1 AS h, max(col)+1 AS w FROM pixels GROUP BY ALL), (SELECT unnest([0.5::DOUBLE,0.3::DOUBLE,2.0::DOUBLE]) AS k)),
    ay AS (SELECT *, 1-abs(r+0.5-(y+0.5)*h/oh)/greatest(1,h/oh) AS wy FROM (SELECT raster_id, band, k, h, oh, y, unnest(range(h)) AS r FROM (SELECT *, unnest(range(oh)) AS y FROM o))),
    ax AS (SELECT *, 1-abs(r+0.5-(x+0.5)*w/ow)/greatest(1,w/ow) AS wx FROM (SELECT raster_id, band, k, w, ow, x, unnest(range(w)) AS r FROM (SELECT *, unnest(range(ow)) AS x FROM o))),
    high AS (SELECT p.raster_id, p.band, k, y, col, sum(wy*value) FILTER (value<>-9999) AS n, sum(wy) FILTER (value<>-9999) AS d FROM pixels p JOIN ay ON p.raster_id=ay.raster_id AND p.band=ay.band AND p.row=ay.r WHERE wy>1e-12 GROUP BY ALL)
    SELECT g.raster_id, g.band, ax.k AS scale, CAST(y AS INT) AS row, CAST(x AS INT) AS col, round(coalesce(sum(wx*n)/sum(wx*d),-9999)+{TIE:.10f},6) AS value FROM high g JOIN ax ON g.raster_id=ax.raster_id AND g.band=ax.band AND g.k=ax.k AND g.col=ax.r WHERE wx>1e-12 GROUP BY g.raster_id, g.band, ax.k, y, x"""


@query("p18_bilinear", RESAMPLED, "pixels")
def _(t):
    each = [pixels.bilinear(t.pixels, k, -9999.0).withColumn("scale", F.lit(k)) for k in (0.5, 0.3, 2.0)]
    return each[0].unionByName(each[1]).unionByName(each[2]).withColumn("value", F.round(F.col("value") + TIE, 6))


@query("p20_read_sizes", "SELECT raster_id, CAST(floor(2048*sqrt(20.0/64)) AS BIGINT) AS side, 0.25::DOUBLE AS scale FROM rasters", "rasters")
def _(t):
    w, h = F.col("width"), F.col("height")
    return t.rasters.select("raster_id", pixels.optimal_dimension(w, h, F.col("bands"), F.col("dtype"), 20.0).alias("side"), pixels.optimal_scale(w, h, 512).alias("scale"))


@query("p22_channels", "SELECT raster_id, band, row, col, value FROM pixels UNION ALL SELECT raster_id, b, row, col, 0.0 FROM (SELECT DISTINCT raster_id, row, col FROM pixels), (SELECT unnest([5,6]) AS b)", "pixels")
def _(t):
    return pixels.channels(t.pixels, 6)


@query("p23_remapped", "SELECT raster_id, k AS channel, row, col, value FROM pixels JOIN (SELECT unnest([3,1,1]) AS band, unnest([0,1,2]) AS k) USING (band)", "pixels")
def _(t):
    return pixels.remapped(t.pixels, [2, 0, 7], 4)


@query("g17_calibration", "SELECT raster_id, CASE WHEN raster_id%4=3 THEN 'calibrated' ELSE 'georeferenced' END AS status, round(CASE WHEN raster_id%4=3 THEN 0.05 WHEN epsg=4326 THEN a*111320 ELSE a END,6) AS x FROM rasters", "rasters")
def _(t):
    gsd = F.when(F.col("raster_id") % 4 == 3, 5.0)
    df = t.rasters.withColumn("m", G.calibration(F.col("a"), F.col("e"), F.col("epsg") == 4326, gsd))
    return df.select("raster_id", "m.status", r6(F.col("m.x"), "x"))


@query("g18_units", "SELECT det_id, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))*0.1*3.28084,6) AS feet, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))*0.1*39.3701,6) AS inches, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))*0.1/111320,9) AS degrees FROM detections", "detections")
def _(t):
    m = G.in_units(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * 0.1)
    return t.detections.withColumn("m", m).select("det_id", r6(F.col("m.feet"), "feet"), r6(F.col("m.inches"), "inches"), F.round("m.degrees", 9).alias("degrees"))


@query("g20_extent_in_pixels", "SELECT raster_id, round(min(px)-(max(px+side)-min(px))*0.1,1) AS x, round((max(px+side)-min(px))*1.2,1) AS w, round((max(py+side)-min(py))*1.2,1) AS h FROM polygons JOIN rasters USING (raster_id) GROUP BY 1", "polygons rasters")
def _(t):
    at = t.polygons.join(t.rasters, "raster_id").select("raster_id", *"abcdef", F.explode("ring").alias("p"))
    x, y = G.to_crs(F.col("p.x"), F.col("p.y"), G.transform_cols())
    bounds = at.withColumns({"x": x, "y": y}).groupBy("raster_id", *"abcdef").agg(F.min("x").alias("ax"), F.min("y").alias("ay"), F.max("x").alias("bx"), F.max("y").alias("by"))
    r = G.extent_in_pixels(*(F.col(c) for c in ("ax", "ay", "bx", "by")), G.transform_cols())
    return bounds.withColumn("r", r).select("raster_id", *[F.round(f"r.{c}", 1).alias(c) for c in ("x", "w", "h")])


@query("g24_scale", "SELECT det_id, CAST(greatest(1,floor(a/(score+0.5)/0.0002645833::DOUBLE)) AS BIGINT) AS scale FROM detections JOIN rasters USING (raster_id)", "detections rasters")
def _(t):
    df = t.detections.join(t.rasters, "raster_id")
    return df.select("det_id", G.scale_denominator(F.col("a"), F.col("score") + 0.5).cast("long").alias("scale"))


@query("g28_point_lookup", "SELECT det_id, CASE WHEN epsg IS NOT NULL THEN round(x1,3) END AS x, CASE WHEN epsg IS NOT NULL THEN round(y1,3) END AS y FROM detections JOIN rasters USING (raster_id)", "detections rasters")
def _(t):
    df = t.detections.join(t.rasters, "raster_id")
    lon, lat = G.lookup(F.col("x1") + 0.25, F.col("y1") + 0.75, G.transform_cols(), F.col("epsg"))
    # A lambda binds the looked-up point once; expanded in place, the two series would multiply.
    back = vector.lonlat_to_pixel(F.array(G.point(lon, lat)), G.transform_cols(), F.col("epsg"))
    known = lambda k: F.when(F.col("epsg").isNotNull(), F.round(F.col("p")[0][k], 3)).alias(k)
    return df.withColumn("p", back).select("det_id", "epsg", "p").select("det_id", known("x"), known("y"))
