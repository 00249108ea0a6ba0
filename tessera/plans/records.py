"""Queries over centroid and polygon tables, vector parts, touched pixels, the legacy composition and streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo as G
from tessera.operators import dedup, pixels, records
from tessera.plans.exports import prop, written
from tessera.plans.queries import BATCHES, REPLAY, fold_sql, in_batches, query, r6, scan_sql
from tessera.sources import exports, vector
from tessera.streaming import streams


@query("j6_touched_means", "SELECT p.raster_id, polygon_id, band, round(avg(value) FILTER (value<>-9999),6) AS mean, count(*) AS n FROM pixels p JOIN local_polygons z ON col<px+side AND col+1>px AND row<py+side AND row+1>py AND (polygon_id%2=0 OR greatest(col-px,0)+greatest(row-py,0)<side) GROUP BY 1,2,3", "pixels local_polygons")
def _(t):
    return pixels.mean_touched(t.pixels, t.local_polygons).withColumn("mean", F.round("mean", 6))


@query("g21_circles", "SELECT raster_id, det_id AS id, (x1+x2)/2 AS x, round(c+(x1+x2)/2*a,6) AS geo_x, round(f+(y1+y2)/2*e,6) AS geo_y, least(x2-x1,y2-y1)/2 AS radius_px, round(least(x2-x1,y2-y1)*abs(a),6) AS diameter_m, 'detection' AS source FROM detections JOIN rasters USING (raster_id) WHERE raster_id<>0 OR class_id=0", "rasters detections")
def _(t):
    new = records.circles(t.detections.where("raster_id = 0 AND class_id = 0"), t.rasters)
    df = records.replaced(records.circles(t.detections, t.rasters), new)
    return df.select("raster_id", "id", "x", r6(F.col("geo_x"), "geo_x"), r6(F.col("geo_y"), "geo_y"), "radius_px", r6(F.col("diameter_m"), "diameter_m"), "source")


@query("g22_manual_centroids", "WITH c AS (SELECT raster_id, det_id AS id, (x1+x2)/2 AS x, (y1+y2)/2 AS y, 'detection' AS source, least(x2-x1,y2-y1)/2 AS radius_px FROM detections WHERE score>=0.5), m AS (SELECT raster_id, row_number() OVER (PARTITION BY raster_id ORDER BY polygon_id) + coalesce((SELECT max(id) FROM c WHERE c.raster_id=p.raster_id),0) AS id, px AS x, py AS y, 'manual' AS source, NULL AS radius_px FROM polygons p) SELECT raster_id, id, x, round(f+y*e,6) AS geo_y, source, radius_px FROM (SELECT * FROM c UNION ALL SELECT * FROM m) JOIN rasters USING (raster_id)", "rasters detections polygons")
def _(t):
    points = t.polygons.select("raster_id", F.col("polygon_id").alias("point_id"), F.col("px").alias("x"), F.col("py").alias("y"))
    df = records.with_manual(records.circles(t.detections.where("score >= 0.5"), t.rasters), points, t.rasters)
    return df.select("raster_id", "id", "x", r6(F.col("geo_y"), "geo_y"), "source", "radius_px")


@query("g27_polygon_records", "WITH r AS (SELECT p.*, row_number() OVER (PARTITION BY raster_id ORDER BY polygon_id) AS n, a, c, e, f, epsg FROM polygons p JOIN rasters USING (raster_id)), o AS (SELECT *, CASE WHEN polygon_id%3=0 THEN 2 ELSE 1 END AS k, polygon_id AS old FROM r UNION ALL SELECT * REPLACE (polygon_id+1000000000 AS polygon_id, row_number() OVER (PARTITION BY raster_id ORDER BY polygon_id)+(SELECT max(n) FROM r q WHERE q.raster_id=r.raster_id) AS n), 2, polygon_id FROM r WHERE polygon_id%4=0), h AS (SELECT *, sin(radians(f+k*py*e)) AS s1, sin(radians(f+k*(py+side)*e)) AS s2, 0.0066943799901413165::DOUBLE AS e2, 0.08181919084262149::DOUBLE AS e1 FROM o) SELECT raster_id, polygon_id, CAST(n AS INT) AS number, 'Polygon '||n AS name, round(c+k*px*a,6) AS geo_x, round(CASE WHEN epsg=4326 THEN 0.9996*0.9996*6378137.0::DOUBLE*6378137.0*radians(k*side*a)*(1-e2)/2*(s1/(1-e2*s1*s1)+atanh(e1*s1)/e1-s2/(1-e2*s2*s2)-atanh(e1*s2)/e1) ELSE k*k*side*side*a*a END/CASE WHEN old%2=1 THEN 2 ELSE 1 END,0) AS area FROM h", "rasters polygons")
def _(t):
    double = F.transform("ring", lambda p: G.point(p["x"] * 2, p["y"] * 2)).alias("ring")
    changed = t.polygons.where("polygon_id % 3 = 0").select("raster_id", "polygon_id", double)
    added = t.polygons.where("polygon_id % 4 = 0").select("raster_id", (F.col("polygon_id") + 1_000_000_000).alias("polygon_id"), double)
    df = records.refreshed(records.polygon_records(t.polygons, t.rasters), changed.unionByName(added), t.rasters)
    return df.select("raster_id", "polygon_id", "number", "name", r6(F.array_min(F.transform("ring_crs", lambda p: p["x"])), "geo_x"), F.round("area", 0).alias("area"))


@query("g19_vector_parts", "SELECT polygon_id AS id, part, ring_no, CAST(CASE WHEN polygon_id%2=1 THEN 4 ELSE 5 END AS INT) AS n_points, round(px+dx*side,2) AS min_x, round(py+dy*side,2) AS min_y FROM polygons JOIN rasters USING (raster_id), (VALUES (0,0,0,0),(0,1,0.125,0.125),(1,0,1,0)) v(part, ring_no, dx, dy) WHERE epsg IS NOT NULL", "rasters polygons")
def _(t):
    """Two parts a feature, the first one with a hole."""
    place = lambda p, k, dx, dy: G.to_lonlat(*G.to_crs(F.col("px") + (p["x"] - F.col("px")) * k + F.col("side") * dx, F.col("py") + (p["y"] - F.col("py")) * k + F.col("side") * dy, G.transform_cols()), F.col("epsg"))
    ring = lambda k, dx, dy: F.transform(G.closed(F.col("ring")), lambda p: F.array(*place(p, k, dx, dy)))
    df = t.polygons.join(t.rasters, "raster_id").where("epsg IS NOT NULL")
    parts = F.array(F.array(ring(1, 0, 0), ring(0.5, 0.125, 0.125)), F.array(ring(1, 1, 0)))
    text = df.select(exports.feature("MultiPolygon", parts, id=F.col("polygon_id"), raster_id=F.col("raster_id")).alias("value"))
    rings = vector.parts(written(text)).select(prop("id"), prop("raster_id", "int"), "part", F.posexplode("rings").alias("ring_no", "ring")).join(t.rasters, "raster_id")
    df = rings.withColumn("ring", vector.lonlat_to_pixel(F.col("ring"), G.transform_cols(), F.col("epsg")))
    low = lambda k: F.round(F.array_min(F.transform("ring", lambda p: p[k])), 2)
    return df.select("id", "part", "ring_no", F.size("ring").alias("n_points"), low("x").alias("min_x"), low("y").alias("min_y"))


@query("n8_legacy_composition", f"""RECURSIVE WITH {BATCHES}, {scan_sql("one", "batches", "raster_id,class_id,batch_no", "score DESC, det_id", 0.45)}, {fold_sql("one", 0.45)},
    {scan_sql("two", "fused", "raster_id,class_id", "score DESC, det_id", 0.45)}, {scan_sql("three", "two", "raster_id,class_id", "score DESC, det_id", 0.3)}
    SELECT det_id, raster_id, class_id, n, round(x1,6) AS x1, round(y1,6) AS y1, round(x2,6) AS x2, round(y2,6) AS y2, round(score,6) AS score FROM three WHERE score>=0.01""", "detections")
def _(t):
    df = dedup.legacy_composition(in_batches(t.detections))
    return df.select("det_id", "raster_id", "class_id", F.col("n").cast("long").alias("n"), *[r6(F.col(c), c) for c in ("x1", "y1", "x2", "y2", "score")])


@query("n10_changed_rasters", "SELECT DISTINCT raster_id FROM detections WHERE raster_id%2=0", "detections")
def _(t):
    """The last result had other scores in even rasters."""
    last = t.detections.withColumn("score", F.when(F.col("raster_id") % 2 == 0, F.col("score") / 2).otherwise(F.col("score")))
    return dedup.changed(t.detections, last)


@query("st5_session_state", f"RECURSIVE WITH {REPLAY} SELECT session_id, max(event_id) AS last_seq, count(done.seq) AS n_standing, coalesce(sum(event_id) FILTER (done.seq IS NOT NULL),0)::BIGINT AS total FROM corrections LEFT JOIN done USING (session_id, seq) GROUP BY 1", "corrections")
def _(t):
    action = "CASE event_id % 10 WHEN 8 THEN 'undo' WHEN 9 THEN 'redo' WHEN 7 THEN 'add' WHEN 6 THEN 'edit' WHEN 5 THEN 'edit' ELSE 'delete' END"
    events = streams.files_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema).selectExpr("user_id AS session_id", "event_id AS seq", f"{action} AS action")
    changes = streams.run_to_table(streams.standing_events(events), "sessions", "update", rocksdb=True)
    held = streams.standing(changes).groupBy("session_id").agg(F.count("*").alias("n_standing"), F.sum("seq").alias("total"))
    last = changes.groupBy("session_id").agg(F.max("last_seq").alias("last_seq"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return last.join(held, "session_id", "left").select("session_id", "last_seq", zero("n_standing"), zero("total"))


@query("st6_arrived_rasters", "SELECT label AS raster_id, count(*) AS tiles, round(sum(list_sum(embedding::DOUBLE[]))/sum(len(embedding)),6) AS mean, round(min(list_min(embedding))::DOUBLE,6) AS low, round(max(list_max(embedding))::DOUBLE,6) AS high FROM embeddings GROUP BY 1")
def _(t):
    tiles = streams.files_stream(t.spark, f"{t.sf_dir}/embeddings.parquet", t.embeddings.schema).selectExpr("label AS raster_id", "embedding AS payload")
    return streams.arrived_rasters(tiles).select("raster_id", "tiles", r6(F.col("mean"), "mean"), r6(F.col("low"), "low"), r6(F.col("high"), "high"))
