"""Queries by SQL names (the table function and the functions that a session registers), of checks and of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql
from tessera.functions import text as T
from tessera.operators import checks, corrections, saved
from tessera.plans.queries import INSIDE, PAIRS, query


@query("sql_tile_windows", "SELECT raster_id, CAST(iy*nx+ix+1 AS INT) AS tile_id, CAST(ix*576 AS INT) AS x_off, CAST(iy*576 AS INT) AS y_off, CAST(least(640,width-ix*576) AS INT) AS w, CAST(least(640,height-iy*576) AS INT) AS h FROM (SELECT *, greatest(1,ceil((width-64)/576.0)) AS nx, greatest(1,ceil((height-64)/576.0)) AS ny FROM scenes), range(8) a(ix), range(8) b(iy) WHERE ix<nx AND iy<ny", "scenes")
def _(t):
    sql.register(t.spark)
    return t.spark.sql("SELECT raster_id, g.* FROM {scenes} s, LATERAL tile_windows(s.width, s.height, 640, 64) g", scenes=t.scenes)


@query("sql_iou", f"WITH {PAIRS} SELECT a, b, round(i/(s-i),6) AS iou FROM pairs WHERE i/(s-i)>0.3", "detections")
def _(t):
    """Boxes meet by cells in SQL; the function does the rest."""
    sql.register(t.spark)
    cells = "explode(sequence(cast(floor({0}1 / 128) AS int), cast(floor({0}2 / 128) AS int)))"
    dealt = t.detections.selectExpr("*", f"{cells.format('x')} AS gx").selectExpr("*", f"{cells.format('y')} AS gy")
    box = "named_struct('x1', {0}.x1, 'y1', {0}.y1, 'x2', {0}.x2, 'y2', {0}.y2)"
    return t.spark.sql(f"""SELECT DISTINCT a, b, round(v, 6) AS iou FROM (SELECT a.det_id AS a, b.det_id AS b, iou({box.format('a')}, {box.format('b')}) AS v
        FROM {{d}} a JOIN {{d}} b ON a.raster_id = b.raster_id AND a.class_id = b.class_id AND a.gx = b.gx AND a.gy = b.gy AND a.det_id < b.det_id) WHERE v > 0.3""", d=dealt)  # fmt: skip


@query("sql_haversine", "SELECT c_custkey, round(2*6371000*asin(sqrt(pow(sin(radians(la2-la1)/2),2)+cos(radians(la1))*cos(radians(la2))*pow(sin(radians(lo2-lo1)/2),2))),3) AS metres FROM (SELECT c_custkey, (c_custkey*37)%360-180 AS lo1, (c_custkey*53)%170-85 AS la1, (c_custkey*91)%360-180 AS lo2, (c_custkey*29)%170-85 AS la2 FROM customer) t")
def _(t):
    sql.register(t.spark)
    k = "c_custkey"
    return t.spark.sql(f"SELECT {k}, round(haversine(({k}*37)%360-180, ({k}*53)%170-85, ({k}*91)%360-180, ({k}*29)%170-85), 3) AS metres FROM {{c}}", c=t.customer)


@query("sql_in_polygon", f"WITH {INSIDE} SELECT det_id, polygon_id FROM hit", "detections polygons poly_edges")
def _(t):
    sql.register(t.spark)
    return t.spark.sql("SELECT det_id, polygon_id FROM {d} d JOIN {p} p ON d.raster_id = p.raster_id AND in_polygon(p.ring, (d.x1 + d.x2) / 2, (d.y1 + d.y2) / 2)", d=t.detections, p=t.polygons)


@query("f5_final_boxes", "SELECT det_id, raster_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY det_id)-1 AS pos FROM detections) WHERE score>=0.4 AND det_id%11<>0 AND det_id%13<>0 AND det_id%17<>0", "detections")
def _(t):
    """Some boxes have a side that is no number, is infinite, or is turned around; places keep their gaps."""
    k, nan, inf = F.col("det_id"), float("nan"), float("inf")
    df = t.detections.withColumn("x2", F.when(k % 11 == 0, nan).when(k % 13 == 0, F.col("x1") - 1).when(k % 17 == 0, inf).otherwise(F.col("x2")))
    return checks.final_boxes(df, 0.4).select("det_id", "raster_id", "pos")


@query("f14_asserted_boxes", "SELECT det_id, x2 FROM detections", "detections")
def _(t):
    return checks.asserted(t.detections).select("det_id", "x2")


@query("u3_unknown_slots", "SELECT raster_id, CAST(slot AS INT) AS slot FROM scenes, range(12) s(slot) WHERE slot BETWEEN 1 AND bands+2 AND slot>least(bands,8)", "scenes")
def _(t):
    """Mappings name two slots more than the raster has bands; models expect one for each band, up to eight."""
    slots = lambda n: t.scenes.select("raster_id", F.explode(F.sequence(F.lit(1), n)).alias("slot"))
    return checks.unknown_slots(slots(F.col("bands") + 2), slots(F.least("bands", F.lit(8))))


@query("s16_kept_models", "SELECT model_name, coalesce(arg_max(description, created_at),'') AS description FROM models WHERE substr(model_name,1,1)>='m' GROUP BY 1", "models")
def _(t):
    """The registry after models up to a letter were deleted."""
    return saved.model_list(saved.without_models(corrections.upserted(t.models), t.models.where("substr(model_name, 1, 1) < 'm'").distinct()))


@query("s16_model_by_name", "SELECT model_name, arg_max(description, created_at) AS description, max(created_at) AS created_at FROM models WHERE model_name=(SELECT max(model_name) FROM models) GROUP BY 1", "models")
def _(t):
    name = t.models.agg(F.max("model_name")).first()[0]
    return saved.model_named(corrections.upserted(t.models), name).select("model_name", "description", "created_at")


@query("z_labels", r"SELECT raster_id, 'Area' || chr(10) || CASE WHEN m2>10000 THEN printf('%.2f',m2/10000) || ' ha (' || format('{:,}',round_even(m2,0)::BIGINT) || ' m²)' ELSE format('{:,.2f}',m2) || ' m²' END AS area, coalesce('EPSG:'||epsg, 'Local grid of scene ') AS crs, 'scene_'||raster_id||'.part' AS stem FROM (SELECT *, (width*height/80.0)::DOUBLE AS m2 FROM scenes)", "scenes")
def _(t):
    path = F.concat(F.lit("/data/dir.v1/scene_"), F.col("raster_id"), F.lit(".part.tif"))
    crs = T.crs_label(F.col("epsg"), F.concat(F.lit("Local grid of scene number "), F.col("raster_id")))
    return t.scenes.select("raster_id", T.area_label(F.col("width") * F.col("height") / 80.0).alias("area"), crs.alias("crs"), T.stem(path).alias("stem"))
