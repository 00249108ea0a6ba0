"""Queries over layers and what belongs to them: files, contents, removal, samples, active boxes and named results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.functions import geo as G
from tessera.operators import checks, decode, records, saved
from tessera.operators.storage import shared_dir
from tessera.plans.exports import NAME_SQL, names
from tessera.plans.queries import query, r6
from tessera.sources import files

#: Months of orders, which stand for rasters with files.
MONTHS = "SELECT CAST(year(o_orderdate)*12+month(o_orderdate) AS INT) AS raster_id FROM orders GROUP BY 1"


def _stored(t):
    """Months of orders as rasters: files of two kinds for some, of one kind or none for others."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("raster_id")
    path = f"{shared_dir(t.spark)}/tessera/{uuid.uuid4().hex}"
    df = t.orders.select(month, F.col("o_orderkey").cast("string").alias("value"))
    df.where("raster_id % 3 <> 0").repartition(4, "raster_id").write.partitionBy("raster_id").text(f"{path}/a")
    df.where("raster_id % 3 = 0 AND raster_id % 2 = 0").repartition(4, "raster_id").write.partitionBy("raster_id").json(f"{path}/b")
    found = files.inventory(t.spark, f"{path}/a").unionByName(files.inventory(t.spark, f"{path}/b"))
    return files.catalogue(df.select("raster_id").distinct(), found.withColumn("raster_id", F.col("raster_id").cast("int")), ["txt"])


@query("s1_file_catalogue", f"SELECT raster_id, CASE WHEN raster_id%3<>0 THEN 'ok' WHEN raster_id%2=0 THEN 'unsupported' ELSE 'missing' END AS state, raster_id%3<>0 OR raster_id%2=0 AS has_bytes FROM ({MONTHS}) d")
def _(t):
    return _stored(t).select("raster_id", "state", F.coalesce(F.col("length") > 0, F.lit(False)).alias("has_bytes"))


@query("s18_active_path", f"SELECT CAST(min(raster_id) AS STRING) AS layer_id, CAST(CASE WHEN min(raster_id)%3<>0 OR min(raster_id)%2=0 THEN min(raster_id) WHEN max(raster_id)%3<>0 OR max(raster_id)%2=0 THEN max(raster_id) END AS INT) AS shown FROM ({MONTHS}) d")
def _(t):
    """The first month is active, the last one was opened last."""
    opened = _stored(t)
    layers = opened.select(F.col("raster_id").cast("string").alias("layer_id"), "raster_id")
    ends = opened.agg(F.min("raster_id").alias("a"), F.max("raster_id").alias("b"))
    layers = layers.join(F.broadcast(ends), F.col("raster_id") == F.col("a"))  # one row
    df = files.path_of(layers, opened, F.col("layer_id"), F.col("b"))
    return df.select("layer_id", F.regexp_extract("path", r"raster_id=(\d+)", 1).cast("int").alias("shown"))


@query("k16_deletions", "SELECT model_name, hit FROM (SELECT p_name AS model_name, true AS hit FROM part WHERE p_partkey%7=0 UNION SELECT p_name||' ?', false FROM part WHERE p_partkey%7=0) t")
def _(t):
    old = t.part.where("p_partkey % 7 = 0").select(F.col("p_name").alias("model_name"))
    return saved.deletions(t.models, old.unionByName(old.select(F.concat("model_name", F.lit(" ?")).alias("model_name"))))


@query("k16_registry_after", "SELECT model_name, description FROM models WHERE model_name NOT IN (SELECT p_name FROM part WHERE p_partkey%7=0)", "models")
def _(t):
    return saved.without_models(t.models, t.part.where("p_partkey % 7 = 0").select(F.col("p_name").alias("model_name"))).select("model_name", "description")


@query("f15_active_boxes", "SELECT det_id, raster_id, class_id FROM detections WHERE (det_id%7=1 OR det_id%7>2) AND NOT (raster_id%2=0 AND class_id=1)", "detections")
def _(t):
    """Of each seven boxes two are eliminated; some have no status. Even rasters hide class 1."""
    k = F.col("det_id") % 7
    df = t.detections.withColumn("status", F.when(k.isin(0, 2), "eliminated").when(k != 3, "not_corrected"))
    return checks.active(df, t.rasters.where("raster_id % 2 = 0").select("raster_id", F.lit(1).alias("class_id"))).select("det_id", "raster_id", "class_id")


@query("g2_screen_pixels", "SELECT det_id, CASE WHEN epsg IS DISTINCT FROM 4326 THEN round((x1+x2)/2,4) END AS x, CASE WHEN epsg IS DISTINCT FROM 4326 THEN round((y1+y2)/2,4) END AS y FROM detections JOIN rasters USING (raster_id)", "detections rasters")
def _(t):
    """Determinants of the geographic rasters are below what the screen takes."""
    df = t.detections.join(t.rasters, "raster_id")
    x, y = G.to_pixel_or_null(*G.to_crs(*B.centre(B.cols()), G.transform_cols()), G.transform_cols())
    return df.select("det_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("u9_removed_layers", "SELECT 'detections' AS tab, det_id AS id FROM detections WHERE raster_id%2=0 UNION ALL SELECT 'polygons', polygon_id FROM polygons WHERE raster_id%2=0 UNION ALL SELECT 'rasters', raster_id FROM rasters WHERE raster_id%2=0", "detections polygons rasters")
def _(t):
    ids = {"detections": "det_id", "polygons": "polygon_id", "rasters": "raster_id"}
    left = records.without_layers({n: getattr(t, n) for n in ids}, t.polygons.select("raster_id").union(t.rasters.select("raster_id")).where("raster_id % 2 = 1"))
    rows = [df.select(F.lit(n).alias("tab"), F.col(ids[n]).cast("long").alias("id")) for n, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("j11_layer_contents", "SELECT r.raster_id, (SELECT count(*) FROM detections d WHERE d.raster_id=r.raster_id) AS detections, (SELECT count(*) FROM polygons p WHERE p.raster_id=r.raster_id) AS polygons, (SELECT count(*) FROM detections d WHERE d.raster_id=r.raster_id) AS centroids FROM rasters r", "detections polygons rasters")
def _(t):
    return records.layer_contents(t.rasters, {"detections": t.detections, "polygons": t.polygons, "centroids": records.circles(t.detections, t.rasters)})


@query("o4_first_samples", "SELECT raster_id, class_id, det_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY raster_id, class_id ORDER BY det_id) AS nth FROM detections) WHERE nth<=5", "detections")
def _(t):
    return records.samples(t.detections, ["raster_id", "class_id"], "det_id", 5).select("raster_id", "class_id", "det_id", "nth")


@query("mo8_named_results", f"SELECT CAST(det_id//8 AS BIGINT) AS batch, CAST(pos-1 AS INT) AS pos, x1, y2, round(score,6) AS score, {NAME_SQL} AS class_name FROM (SELECT *, row_number() OVER (PARTITION BY det_id//8 ORDER BY det_id) AS pos, count(*) OVER (PARTITION BY det_id//8) AS n FROM detections) WHERE (det_id//8)%5<>0 AND (pos<n OR (det_id//8)%3<>0)", "detections")
def _(t):
    """Arrays of eight boxes; of every third the scores lack the last, every fifth has no classes."""
    batch = F.floor(F.col("det_id") / 8).alias("batch")
    rows = t.detections.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("det_id", F.array(*B.cols()).alias("box"), "score", "class_id"))).alias("r"))
    scores = F.when(F.col("batch") % 3 == 0, F.slice("r.score", 1, F.size("r") - 1)).otherwise(F.col("r.score"))
    results = rows.select("batch", F.col("r.box").alias("boxes"), scores.alias("scores"), F.when(F.col("batch") % 5 != 0, F.col("r.class_id")).alias("classes"))
    return decode.named_rows(results, names(), ["batch"]).select("batch", "pos", "x1", "y2", r6(F.col("score"), "score"), "class_name")
