"""Queries over the derived raster tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.functions import geo as G
from tessera.functions import text as T
from tessera.operators import corrections, decode, dedup, grid, pixels, routing, saved, spatial
from tessera.operators.storage import materialize
from tessera.plans.fixtures import ctes, fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Fixtures and base tables by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from tessera.plans.fixtures import SQL

        return fixture(self.spark, self.sf_dir, name) if name in SQL else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, needs: str = ""):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            with_ = ctes(*needs.split()) if needs else ""
            recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
            body = sql.replace("RECURSIVE", "").strip()
            ORACLES[name] = (f"WITH {recursive}{with_}" + (", " + body[5:] if body.startswith("WITH ") else " " + body)) if with_ else sql.replace("RECURSIVE WITH", "WITH RECURSIVE").strip()
        return f

    return add


def r6(c, alias: str):
    return F.round(c, 6).alias(alias)


# --- boxes -------------------------------------------------------------------------------------------------------

@query("b_letterbox", "SELECT raster_id, tile_w, round(scale,6) AS scale, CAST(floor((640 - round_even(tile_w*scale,0))/2) AS BIGINT) AS pad_x, CAST(floor((640 - round_even(512*scale,0))/2) AS BIGINT) AS pad_y, round((100 - floor((640 - round_even(tile_w*scale,0))/2))/scale,6) AS back FROM (SELECT raster_id, 300 + raster_id*7 AS tile_w, least(640/512.0, 640.0/(300+raster_id*7))::DOUBLE AS scale FROM rasters)", "rasters")
def _(t):
    df = t.rasters.select("raster_id", (300 + F.col("raster_id") * 7).alias("tile_w"))
    s, px, py = B.letterbox(F.col("tile_w"), F.lit(512), F.lit(640), F.lit(640))
    return df.select("raster_id", "tile_w", r6(s, "scale"), px.alias("pad_x"), py.alias("pad_y"), r6(B.unletterbox(F.lit(100.0), px, s), "back"))


@query("b_algebra", "SELECT det_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, greatest(0,least(2000,x2)) AS clx2, greatest(0,least(1900,y2)) AS cly2, least(x1,y1,2048-x2,2048-y2) AS least_d, round(greatest(0,least(1,least(x1,y1,2048-x2,2048-y2)/1024)),6) AS share, least(x1,y1,2048-x2,2048-y2)<=32 AS edge, least(x2-x1,y2-y1)/2 AS radius_px, (x2-x1)*(y2-y1) AS area, CAST(trunc(x1*0.37) AS INT) AS px1, class_id % 5 AS colour, CASE class_id WHEN 0 THEN 'palm' WHEN 1 THEN 'tree' ELSE CAST(class_id AS VARCHAR) END AS name, greatest(1,x2-x1) AS draw_w FROM detections", "detections")
def _(t):
    b, w = B.cols(), F.lit(2048.0)
    cx, cy = B.centre(b)
    cl = B.clamped(B.ordered(b), F.lit(2000.0), F.lit(1900.0))
    least, share = B.border_distance(b, w, w)
    names = F.create_map(F.lit(0), F.lit("palm"), F.lit(1), F.lit("tree"))
    return t.detections.select("det_id", cx.alias("cx"), cy.alias("cy"), cl[2].alias("clx2"), cl[3].alias("cly2"), least.alias("least_d"), r6(share, "share"), B.on_edge(least, F.lit(64)).alias("edge"), B.circle(b, F.lit(1.0), F.lit(1.0))["radius_px"].alias("radius_px"), B.area(b).alias("area"), (F.col("x1") * 0.37).cast("int").alias("px1"), (F.col("class_id") % 5).alias("colour"), B.class_name(F.col("class_id"), names).alias("name"), F.greatest(F.lit(1.0), b[2] - b[0]).alias("draw_w"))


PAIRS = "pairs AS (SELECT a.raster_id, a.class_id, a.det_id AS a, b.det_id AS b, (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS i, (a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1) AS s, a.score AS sa, b.score AS sb FROM detections a JOIN detections b ON a.raster_id=b.raster_id AND a.class_id=b.class_id AND a.det_id<b.det_id AND a.x1<b.x2 AND b.x1<a.x2 AND a.y1<b.y2 AND b.y1<a.y2)"


@query("j5_overlapping_pairs", f"WITH {PAIRS} SELECT raster_id, class_id, a, b, round(i/(s-i),6) AS iou FROM pairs WHERE i/(s-i)>0.3", "detections")
def _(t):
    df = spatial.overlapping_pairs(t.detections, dedup.KEY, 0.3)
    return df.withColumn("iou", F.round("iou", 6))


@query("b12_variants", "WITH p AS (SELECT det_id, CASE WHEN det_id%11=0 THEN x2 ELSE x1 END AS x1, y1, CASE WHEN det_id%11=0 THEN x1 WHEN det_id%6=0 THEN x1 ELSE x2 END AS x2, y2 FROM detections), q AS (SELECT *, least(x2,x2+det_id%5*8-8)-greatest(x1,x1+det_id%5*8-8) AS w, least(y2,y2+det_id%3*40-4)-greatest(y1,y1+det_id%3*40-4) AS h, 2*(x2-x1)*(y2-y1) AS s FROM p) SELECT det_id, round(CASE WHEN w<0 OR h<0 OR s-w*h<=0 THEN 0 ELSE w*h/(s-w*h) END,6) AS raw, CASE WHEN s=greatest(0,w)*greatest(0,h) THEN greatest(0,w)*greatest(0,h)>0 ELSE greatest(0,w)*greatest(0,h)/(s-greatest(0,w)*greatest(0,h))>0.5 END AS is_duplicate FROM q", "detections")
def _(t):
    """Each box and its copy beside it; some boxes are empty, some are inside out."""
    k = F.col("det_id")
    turned = k % 11 == 0
    df = t.detections.select("det_id", "y1", "y2", F.when(turned, F.col("x2")).otherwise(F.col("x1")).alias("x1"), F.when(turned | (k % 6 == 0), F.col("x1")).otherwise(F.col("x2")).alias("x2"))
    dx, dy = k % 5 * 8 - 8, k % 3 * 40 - 4
    a = B.cols()
    b = (a[0] + dx, a[1] + dy, a[2] + dx, a[3] + dy)
    return df.select("det_id", r6(B.iou_raw(a, b), "raw"), B.duplicate(a, b, F.lit(0.5)).alias("is_duplicate"))


@query("b13_circles", "SELECT det_id, round(r*(abs(a)+abs(e))/2,6) AS radius_m, round(pi()*(r*(abs(a)+abs(e))/2)*(r*(abs(a)+abs(e))/2),6) AS area_m2, round(c+cx*a,6) AS geo_x, round(f+cy*e,6) AS geo_y FROM (SELECT d.*, rs.a, rs.c, rs.e, rs.f, least(x2-x1,y2-y1)/2 AS r, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM detections d JOIN rasters rs USING (raster_id))", "rasters detections")
def _(t):
    df = t.detections.join(t.rasters, "raster_id")
    m = B.circle(B.cols(), F.col("a"), F.col("e"))
    gx, gy = G.to_crs(*B.centre(B.cols()), G.transform_cols())
    return df.select("det_id", r6(m["radius_m"], "radius_m"), r6(m["area_m2"], "area_m2"), r6(gx, "geo_x"), r6(gy, "geo_y"))


# --- filters -----------------------------------------------------------------------------------------------------

@query("f_detection_filters", "SELECT det_id, class_id, round(score,6) AS score FROM detections WHERE score>=0.25 AND x2>x1 AND y2>y1 AND (x1+x2)/2 BETWEEN 16 AND 2032 AND (y1+y2)/2 BETWEEN 16 AND 2032 AND class_id IN (0,2)", "detections")
def _(t):
    cx, cy = B.centre(B.cols())
    df = t.detections.where((F.col("score") >= 0.25) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return df.where(cx.between(16, 2032) & cy.between(16, 2032) & F.col("class_id").isin(0, 2)).select("det_id", "class_id", r6(F.col("score"), "score"))


@query("f5_valid_with_positions", "SELECT det_id, raster_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY det_id)-1 AS pos FROM detections) WHERE score>=0.4", "detections")
def _(t):
    pos = F.row_number().over(Window.partitionBy("raster_id").orderBy("det_id")) - 1
    return t.detections.withColumn("pos", pos).where("score >= 0.4").select("det_id", "raster_id", "pos")


INSIDE = "hit AS (SELECT d.det_id, p.polygon_id, p.role FROM detections d JOIN poly_edges p ON d.raster_id=p.raster_id WHERE (ay>(y1+y2)/2)<>(by_>(y1+y2)/2) AND (x1+x2)/2 < (bx-ax)*((y1+y2)/2-ay)/(by_-ay)+ax GROUP BY ALL HAVING count(*)%2=1)"


def _centres(df: DataFrame) -> DataFrame:
    cx, cy = B.centre(B.cols())
    return df.withColumn("x", cx).withColumn("y", cy)


@query("j2_points_in_polygons", f"WITH {INSIDE} SELECT * FROM hit", "detections polygons poly_edges")
def _(t):
    return spatial.points_in_polygons(_centres(t.detections), t.polygons).select("det_id", "polygon_id", "role")


KEEP = "keep AS (SELECT d.* FROM detections d WHERE (EXISTS (SELECT 1 FROM hit h WHERE h.det_id=d.det_id AND h.role='aoi') OR NOT EXISTS (SELECT 1 FROM polygons p WHERE p.raster_id=d.raster_id AND p.role='aoi')) AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.det_id=d.det_id AND h.role='exclude'))"


@query("f8_aoi_filter", f"WITH {INSIDE}, {KEEP} SELECT det_id, raster_id FROM keep", "detections polygons poly_edges")
def _(t):
    return spatial.filter_by_polygons(_centres(t.detections), t.polygons, ["det_id"]).select("det_id", "raster_id")


@query("f9_bbox_filter", "SELECT DISTINCT d.det_id FROM detections d JOIN polygons p ON d.raster_id=p.raster_id AND p.role='aoi' WHERE (x1+x2)/2 BETWEEN px AND px+side AND (y1+y2)/2 BETWEEN py AND py+side", "detections polygons")
def _(t):
    return spatial.points_in_polygons(_centres(t.detections), t.polygons.where("role = 'aoi'"), mode="bbox").select("det_id").distinct()


@query("f9_strict_filter", "SELECT DISTINCT d.det_id, polygon_id FROM (SELECT *, floor((x1+x2)/20)*10 AS x, floor((y1+y2)/20)*10 AS y FROM detections) d JOIN polygons p ON d.raster_id=p.raster_id AND x>px AND y>py AND CASE WHEN polygon_id%2=1 THEN (x-px)+(y-py)<side ELSE x<px+side AND y<py+side END", "detections polygons")
def _(t):
    """Points on a grid of 10, so that some lie on borders, which do not count."""
    at = t.detections.select("det_id", "raster_id", *[(F.floor((F.col(f"{c}1") + F.col(f"{c}2")) / 20) * 10).cast("double").alias(c) for c in "xy"])
    return spatial.points_in_polygons(at, t.polygons, mode="strict").select("det_id", "polygon_id").distinct()


@query("j2_large_rings", """WITH v AS (SELECT raster_id, polygon_id, px+side*(0.5+(0.3+0.2*(k%3))*cos(2*pi()*k/240)) AS ax, py+side*(0.5+(0.3+0.2*(k%3))*sin(2*pi()*k/240)) AS ay, px+side*(0.5+(0.3+0.2*((k+1)%240%3))*cos(2*pi()*((k+1)%240)/240)) AS bx, py+side*(0.5+(0.3+0.2*((k+1)%240%3))*sin(2*pi()*((k+1)%240)/240)) AS by_ FROM polygons, range(240) r(k)),
    near AS (SELECT det_id, d.raster_id, polygon_id, (x1+x2)/2 AS x, (y1+y2)/2 AS y FROM detections d JOIN polygons p ON d.raster_id=p.raster_id AND abs((x1+x2)/2-px-side/2)<=0.75*side AND abs((y1+y2)/2-py-side/2)<=0.75*side)
    SELECT det_id, near.polygon_id FROM near JOIN v ON v.raster_id=near.raster_id AND v.polygon_id=near.polygon_id WHERE (ay>y)<>(by_>y) AND x<(bx-ax)*(y-ay)/(by_-ay)+ax GROUP BY ALL HAVING count(*)%2=1""", "detections polygons")
def _(t):
    """Stars of 240 points, cut by cells."""
    r, turn = 0.3 + 0.2 * (F.col("k") % 3), 2 * F.pi() * F.col("k") / 240
    at = t.polygons.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(239)))).withColumns({"x": F.col("px") + F.col("side") * (0.5 + r * F.cos(turn)), "y": F.col("py") + F.col("side") * (0.5 + r * F.sin(turn))})
    ring = F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    stars = at.groupBy("raster_id", "polygon_id").agg(ring.alias("ring"))
    return spatial.points_in_polygons(_centres(t.detections), stars).select("det_id", "polygon_id")


# --- tiles -------------------------------------------------------------------------------------------------------

def _tiles_sql(n: str, w: str = "least(640, 2048-x)", h: str = "least(640, 2048-y)") -> str:
    return f"SELECT raster_id, CAST(iy*n+ix+1 AS INT) AS tile_id, CAST(x AS INT) AS x_off, CAST(y AS INT) AS y_off, CAST({w} AS INT) AS w, CAST({h} AS INT) AS h FROM (SELECT raster_id, {n} AS n, ix, iy, ix*576 AS x, iy*576 AS y FROM rasters, range(8) a(ix), range(8) b(iy) WHERE ix < {n} AND iy < {n})"


T1 = _tiles_sql("CAST(greatest(1,ceil((2048-64)/576.0)) AS INT)")
for _name, _f, _sql in (
    ("t1_windows", grid.windows, T1),
    ("t2_legacy_windows", grid.legacy_windows, _tiles_sql("CAST(ceil(2048/576.0) AS INT)")),
    ("t3_training_windows", grid.training_windows, _tiles_sql("CAST(greatest(1,floor((2048-64)/576.0)) AS INT)", "640", "640")),
):
    query(_name, _sql, "rasters")(lambda t, f=_f: f(t.rasters))

CORES = f"tiles AS ({T1}), cores AS (SELECT *, x_off + CASE WHEN x_off=0 THEN 0 ELSE 32 END AS cx1, y_off + CASE WHEN y_off=0 THEN 0 ELSE 32 END AS cy1, x_off+w - CASE WHEN x_off+w>=2048 THEN 0 ELSE 32 END AS cx2, y_off+h - CASE WHEN y_off+h>=2048 THEN 0 ELSE 32 END AS cy2 FROM tiles)"


@query("t4_core_bounds", f"WITH {CORES} SELECT * FROM cores", "rasters")
def _(t):
    return grid.core_bounds(grid.windows(t.rasters), t.rasters)


def _vertices(p: DataFrame) -> DataFrame:
    return p.select("raster_id", F.explode("ring").alias("p")).select("raster_id", "p.x", "p.y")


CROP = "crop AS (SELECT raster_id, CAST(coalesce(least(floor(min(ax)),2047),0) AS INT) AS x0, CAST(coalesce(least(floor(min(ay)),2047),0) AS INT) AS y0, CAST(coalesce(least(ceil(max(ax)),2048),2048) AS INT) AS x1, CAST(coalesce(least(ceil(max(ay)),2048),2048) AS INT) AS y1 FROM rasters LEFT JOIN (SELECT * FROM poly_edges WHERE role='aoi') USING (raster_id) GROUP BY raster_id)"


@query("a11_crop_region", f"WITH {CROP} SELECT * FROM crop", "rasters polygons poly_edges")
def _(t):
    return grid.crop_regions(t.rasters, _vertices(t.polygons.where("role = 'aoi'")))


@query("t5_aoi_tiles", f"WITH {CROP}, g AS (SELECT raster_id, x0,y0,x1,y1, greatest(1,ceil((x1-x0-64)/576.0)) AS nx, greatest(1,ceil((y1-y0-64)/576.0)) AS ny FROM crop) SELECT raster_id, CAST(iy*nx+ix+1 AS INT) AS tile_id, CAST(x0+ix*576 AS INT) AS x_off, CAST(y0+iy*576 AS INT) AS y_off, CAST(least(640,x1-x0-ix*576) AS INT) AS w, CAST(least(640,y1-y0-iy*576) AS INT) AS h FROM g, range(8) a(ix), range(8) b(iy) WHERE ix<nx AND iy<ny AND EXISTS (SELECT 1 FROM polygons p WHERE p.raster_id=g.raster_id AND role='aoi' AND px<=x0+ix*576+least(640,x1-x0-ix*576) AND px+side>=x0+ix*576 AND py<=y0+iy*576+least(640,y1-y0-iy*576) AND py+side>=y0+iy*576)", "rasters polygons poly_edges")
def _(t):
    aoi = t.polygons.where("role = 'aoi'")
    return spatial.tiles_meeting_polygons(grid.windows(grid.crop_regions(t.rasters, _vertices(aoi))), aoi)


@query("t7_viewport_tiles", "SELECT det_id, tx, ty FROM detections d, range(4) a(tx), range(4) b(ty) WHERE tx BETWEEN floor(x1/512) AND ceil((x2+500)/512)-1 AND ty BETWEEN floor(y1/512) AND ceil((y2+300)/512)-1", "detections")
def _(t):
    v = t.detections.selectExpr("det_id", "x1", "y1", "x2 + 500 AS x2", "y2 + 300 AS y2", "2048 AS width", "2048 AS height")
    return grid.viewport_tiles(v).selectExpr("det_id", "CAST(tx AS BIGINT) AS tx", "CAST(ty AS BIGINT) AS ty")


@query("j4_tiles_exact", "SELECT raster_id, CAST(iy*19+ix+1 AS INT) AS tile_id, CAST(x AS INT) AS x_off, CAST(y AS INT) AS y_off, CAST(w AS INT) AS w, CAST(h AS INT) AS h FROM (SELECT raster_id, ix, iy, ix*112 AS x, iy*112 AS y, least(128,2048-ix*112) AS w, least(128,2048-iy*112) AS h FROM rasters, range(19) a(ix), range(19) b(iy)) t WHERE EXISTS (SELECT 1 FROM polygons p WHERE p.raster_id=t.raster_id AND px<=x+w AND px+side>=x AND py<=y+h AND py+side>=y AND (polygon_id%2=0 OR greatest(x-px,0)+greatest(y-py,0)<=side))", "rasters polygons")
def _(t):
    return spatial.tiles_meeting_polygons(grid.windows(t.rasters, 128, 16), t.polygons, exact=True)


# --- duplicates --------------------------------------------------------------------------------------------------

def _nms_sql(test: str, first: str = "sa>=sb", order: str = "score DESC, det_id", pairs: str = "pairs", ranked: str = "detections", before: str = "") -> str:
    """Scan by rank; boxes without a conflict are kept at once, so a step has to look at the others only."""
    return f"""RECURSIVE WITH {PAIRS.replace("pairs AS (", "pairs AS MATERIALIZED (")}, {before} clash AS MATERIALIZED (SELECT CASE WHEN {first} THEN b ELSE a END AS det_id, CASE WHEN {first} THEN a ELSE b END AS winner FROM {pairs} WHERE {test}),
    better AS MATERIALIZED (SELECT det_id, list(winner) AS over_ FROM clash GROUP BY 1),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY raster_id, class_id ORDER BY {order}) AS r FROM {ranked} WHERE det_id IN (SELECT det_id FROM clash UNION ALL SELECT winner FROM clash)),
    step AS (SELECT DISTINCT raster_id, class_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept FROM detections UNION ALL
      SELECT s.raster_id, s.class_id, s.r+1, CASE WHEN b.over_ IS NOT NULL AND list_has_any(s.kept, b.over_) THEN s.kept ELSE list_append(s.kept, d.det_id) END
      FROM step s JOIN ranked d ON d.raster_id=s.raster_id AND d.class_id=s.class_id AND d.r=s.r+1 LEFT JOIN better b ON b.det_id=d.det_id),
    kept AS MATERIALIZED (SELECT det_id FROM detections WHERE det_id NOT IN (SELECT det_id FROM ranked) UNION ALL SELECT unnest(kept) AS det_id FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY raster_id, class_id ORDER BY r DESC)=1))"""


@query("n2_nms", _nms_sql("i/(s-i)>0.3") + " SELECT det_id FROM kept", "detections")
def _(t):
    return dedup.nms(t.detections, 0.3).select("det_id")


@query("n3_nms_inclusive", _nms_sql("i/(s-i)>=0.5") + " SELECT det_id FROM kept", "detections")
def _(t):
    return dedup.nms(t.detections, 0.5, True).select("det_id")


SEEDS = "seeds AS (SELECT b AS det_id, min(a) AS seed FROM pairs WHERE i/(s-i)>=0.3 AND a IN (SELECT det_id FROM kept) AND b NOT IN (SELECT det_id FROM kept) GROUP BY 1)"
WEIGHTED = ", ".join(f"round(CASE WHEN sum(score)>0 THEN sum(score*{c})/sum(score) ELSE avg({c}) END,6) AS {c}" for c in ("x1", "y1", "x2", "y2"))


@query("n4_merge_clusters", _nms_sql("i/(s-i)>=0.3", "true", "det_id") + f", {SEEDS} SELECT coalesce(seed, det_id) AS det_id, count(*) AS n, {WEIGHTED}, round(max(score),6) AS score FROM detections d LEFT JOIN seeds USING (det_id) GROUP BY 1", "detections")
def _(t):
    return dedup.merge_clusters(t.detections, 0.3).select("det_id", "n", *[r6(F.col(c), c) for c in ("x1", "y1", "x2", "y2", "score")])


LEAST_SIDE = "least(x1,y1,2048-x2,2048-y2)"


def scan_sql(name: str, source: str, key: str, order: str, threshold: float) -> str:
    """CTEs ``name``: rows of ``source`` that greedy suppression (IoU >= threshold) by ``order`` in a ``key`` keeps, one by one."""
    same = " AND ".join(f"s.{k}=d.{k}" for k in key.split(","))
    return f"""{name}_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM {source}),
    {name}_s AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept FROM {name}_r UNION ALL
      SELECT {", ".join("s." + k for k in key.split(","))}, s.r+1, CASE WHEN len(list_filter(s.kept, lambda k: {IOU_LIST} >= {threshold})) > 0 THEN s.kept ELSE list_append(s.kept, struct_pack(id := d.det_id, x1 := d.x1, y1 := d.y1, x2 := d.x2, y2 := d.y2)) END
      FROM {name}_s s JOIN {name}_r d ON {same} AND d.r=s.r+1),
    {name} AS MATERIALIZED (SELECT * EXCLUDE (r) FROM {name}_r WHERE det_id IN (SELECT unnest(kept).id FROM (SELECT * FROM {name}_s QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY r DESC)=1)))"""


IOU_LIST = "(greatest(0,least(k.x2,d.x2)-greatest(k.x1,d.x1))*greatest(0,least(k.y2,d.y2)-greatest(k.y1,d.y1)))/((k.x2-k.x1)*(k.y2-k.y1)+(d.x2-d.x1)*(d.y2-d.y1)-greatest(0,least(k.x2,d.x2)-greatest(k.x1,d.x1))*greatest(0,least(k.y2,d.y2)-greatest(k.y1,d.y1)))"
FUSED = "STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, score DOUBLE, far DOUBLE, edge BOOLEAN, n BIGINT)"
MIX = "; ".join(f"{c} := (k.{c}*k.score*(1+0.5*k.far)+d.{c}*d.score*(1+0.5*d.far))/(k.score*(1+0.5*k.far)+d.score*(1+0.5*d.far)+1e-12)" for c in ("x1", "y1", "x2", "y2", "far")).replace(";", ",")


def fold_sql(source: str, threshold: float) -> str:
    """CTE ``fused``: the one-by-one fold of ``source`` (det_id, batch_no, box, score, far, edge) in each raster and class."""
    return f"""f_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY raster_id, class_id ORDER BY batch_no, det_id) AS r FROM {source}),
    f_s AS (SELECT DISTINCT raster_id, class_id, CAST(0 AS BIGINT) AS r, CAST([] AS {FUSED}[]) AS kept FROM f_r UNION ALL
      SELECT raster_id, class_id, r, CASE WHEN nth > 0 THEN list_concat(list_concat(kept[1:nth-1], list_transform(kept[nth:nth], lambda k: struct_pack(id := k.id, {MIX}, score := greatest(k.score, d.score), edge := k.edge AND d.edge, n := k.n+1))), kept[nth+1:])
        ELSE list_append(kept, struct_pack(id := d.det_id, x1 := d.x1, y1 := d.y1, x2 := d.x2, y2 := d.y2, score := d.score, far := d.far, edge := d.edge, n := 1)) END
      FROM (SELECT s.raster_id, s.class_id, s.r+1 AS r, s.kept, d, coalesce(list_position(list_transform(s.kept, lambda k: {IOU_LIST} >= {threshold}), true), 0) AS nth FROM f_s s JOIN f_r d ON s.raster_id=d.raster_id AND s.class_id=d.class_id AND d.r=s.r+1)),
    fused AS MATERIALIZED (SELECT raster_id, class_id, k.id AS det_id, k.x1, k.y1, k.x2, k.y2, k.score, k.far, k.edge, k.n FROM (SELECT raster_id, class_id, unnest(kept) AS k FROM (SELECT * FROM f_s QUALIFY row_number() OVER (PARTITION BY raster_id, class_id ORDER BY r DESC)=1)))"""


BATCHES = f"batches AS MATERIALIZED (SELECT *, det_id%7 AS batch_no, greatest(0,least(1,{LEAST_SIDE}/1024)) AS far, {LEAST_SIDE}<=32 AS edge FROM detections)"


def in_batches(detections: DataFrame) -> DataFrame:
    """Detections in seven batches, with the distance from the raster's border for that from a tile's."""
    least, share = B.border_distance(B.cols(), F.lit(2048.0), F.lit(2048.0))
    return detections.withColumns({"batch_no": F.col("det_id") % 7, "edge": B.on_edge(least, F.lit(64)), "border_dist": share})


@query("n6_fuse_batches", f"RECURSIVE WITH {BATCHES}, {fold_sql('batches', 0.3)} SELECT det_id, n, round(x1,6) AS x1, round(y1,6) AS y1, round(x2,6) AS x2, round(y2,6) AS y2, round(score,6) AS score, round(far,6) AS far, edge FROM fused", "detections")
def _(t):
    df = dedup.fuse_batches(in_batches(t.detections), 0.3)
    return df.select("det_id", F.col("n").cast("long").alias("n"), *[r6(F.col(c), c) for c in ("x1", "y1", "x2", "y2", "score")], r6(F.col("border_dist"), "far"), "edge")


@query("n7_merge_preferring_inner", f"""RECURSIVE WITH {PAIRS.replace("pairs AS (", "pairs AS MATERIALIZED (")}, q AS (SELECT det_id, {LEAST_SIDE}<=32 AS edge, greatest(0,least(1,{LEAST_SIDE}/1024)) AS far FROM detections),
    clash AS (SELECT CASE WHEN sa>=sb THEN a ELSE b END AS one, CASE WHEN sa>=sb THEN b ELSE a END AS two, least(sa,sb) AS s2 FROM pairs WHERE i/(s-i)>0.3),
    later AS MATERIALIZED (SELECT one AS det_id, list(struct_pack(id := two, wins := (f.edge AND NOT g.edge) OR (f.edge = g.edge AND g.far > f.far)) ORDER BY s2 DESC, two) AS c FROM clash JOIN q f ON f.det_id=one JOIN q g ON g.det_id=two GROUP BY 1),
    ranked AS MATERIALIZED (SELECT det_id, raster_id, class_id, c, row_number() OVER (PARTITION BY raster_id, class_id ORDER BY score DESC, det_id) AS r FROM detections JOIN later USING (det_id)),
    step AS (SELECT DISTINCT raster_id, class_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS gone FROM ranked UNION ALL
      SELECT raster_id, class_id, r, CASE WHEN list_contains(gone, det_id) THEN gone WHEN nth > 0 THEN list_append(list_concat(gone, list_transform(alive[1:nth-1], lambda x: x.id)), det_id) ELSE list_concat(gone, list_transform(alive, lambda x: x.id)) END
      FROM (SELECT *, coalesce(list_position(list_transform(alive, lambda x: x.wins), true), 0) AS nth FROM (SELECT s.raster_id, s.class_id, s.r+1 AS r, gone, det_id, list_filter(c, lambda x: NOT list_contains(s.gone, x.id)) AS alive FROM step s JOIN ranked d ON d.raster_id=s.raster_id AND d.class_id=s.class_id AND d.r=s.r+1))),
    lost AS (SELECT unnest(gone) AS det_id FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY raster_id, class_id ORDER BY r DESC)=1))
    SELECT det_id FROM detections WHERE det_id NOT IN (SELECT det_id FROM lost)""", "detections")
def _(t):
    return dedup.merge_preferring_inner(in_batches(t.detections), 0.3).select("det_id")


def _tiled(t: Tables, tile: int = 640, overlap: int = 64) -> DataFrame:
    """Each detection once for every tile that holds its centre, as overlapping tiles report it.

    A centre lies in the tile of its stride, and in the one before if it is in their overlap: the tile's number follows
    by arithmetic from the raster's size, without a join to the tiles.
    """
    stride = tile - overlap
    df = _centres(t.detections).join(t.rasters.select("raster_id", "width", "height"), "raster_id")
    n = lambda c: F.greatest(F.lit(1), F.ceil((F.col(c) - overlap) / stride)).cast("int")
    last = lambda v, c: F.least(F.floor(v / stride).cast("int"), n(c) - 1)
    first = lambda v, c: F.least(F.greatest(F.lit(0), F.floor((v - tile) / stride).cast("int") + 1), last(v, c))
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))
    df = df.where(inside).withColumn("tx", F.explode(F.sequence(first(F.col("x"), "width"), last(F.col("x"), "width"))))
    df = df.withColumn("ty", F.explode(F.sequence(first(F.col("y"), "height"), last(F.col("y"), "height"))))
    return df.withColumn("tile_id", (F.col("ty") * n("width") + F.col("tx") + 1).cast("int")).drop("tx", "ty", "width", "height")


OWNED = f"{CORES}, owned AS (SELECT d.*, c.tile_id FROM detections d JOIN cores c ON d.raster_id=c.raster_id AND (x1+x2)/2>=cx1 AND (x1+x2)/2<cx2 AND (y1+y2)/2>=cy1 AND (y1+y2)/2<cy2)"


@query("n1_tile_ownership", f"WITH {OWNED} SELECT det_id, tile_id FROM owned", "rasters detections")
def _(t):
    return dedup.owned(_tiled(t), grid.core_bounds(grid.windows(t.rasters), t.rasters)).select("det_id", "tile_id")


@query("n9_flagship", _nms_sql("i/(s-i)>0.3") + f", {INSIDE}, {KEEP} SELECT raster_id, class_id, count(*) AS n FROM keep JOIN kept USING (det_id) GROUP BY ALL", "rasters detections polygons poly_edges")
def flagship(t):
    mine = materialize(dedup.owned(_tiled(t), grid.core_bounds(grid.windows(t.rasters), t.rasters)).drop("tile_id"), "owned")
    kept = spatial.filter_by_polygons(dedup.nms(mine, 0.3), t.polygons, ["det_id"])
    return kept.groupBy("raster_id", "class_id").agg(F.count("*").alias("n"))


@query("n10_signature", "SELECT raster_id, count(*) AS n, true AS same_in_any_order, bool_or(score>=0.5) AS tells_scores FROM detections GROUP BY 1", "detections")
def _(t):
    """The signature itself, Spark's hash, stays; what it must tell: no order of rows, but other scores."""
    one, two = dedup.signature(t.detections), dedup.signature(t.detections.repartition(7, "score")).withColumnRenamed("sig", "again")
    other = t.detections.withColumn("score", F.when(F.col("score") >= 0.5, F.col("score") / 2).otherwise(F.col("score")))
    other = dedup.signature(other).withColumnRenamed("sig", "changed")
    df = one.join(two, ["raster_id", "n"]).join(other, ["raster_id", "n"])
    return df.select("raster_id", "n", (F.col("sig") == F.col("again")).alias("same_in_any_order"), (F.col("sig") != F.col("changed")).alias("tells_scores"))


# --- aggregates, windows, order ----------------------------------------------------------------------------------

@query("a1_class_counts", "SELECT raster_id, class_id, count(*) AS n FROM detections GROUP BY ROLLUP (raster_id, class_id)", "detections")
def _(t):
    return t.detections.rollup("raster_id", "class_id").agg(F.count("*").alias("n"))


@query("a9_layer_summary", "SELECT raster_id, n, n_high, has_any, avg_r, np FROM (SELECT raster_id, count(*) AS n, count(*) FILTER (score>=0.5) AS n_high, bool_or(score>0.9) AS has_any, round(avg(least(x2-x1,y2-y1)/2),6) AS avg_r FROM detections GROUP BY 1) LEFT JOIN (SELECT raster_id, count(*) AS np FROM polygons GROUP BY 1) USING (raster_id)", "detections polygons")
def _(t):
    r = B.circle(B.cols(), F.lit(1.0), F.lit(1.0))["radius_px"]
    df = t.detections.groupBy("raster_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("n_high"), F.bool_or(F.col("score") > 0.9).alias("has_any"), r6(F.avg(r), "avg_r"))
    return df.join(t.polygons.groupBy("raster_id").agg(F.count("*").alias("np")), "raster_id", "left")


@query("w_ranks", "SELECT det_id, row_number() OVER (PARTITION BY raster_id, class_id ORDER BY score DESC, det_id) AS rank, row_number() OVER (PARTITION BY raster_id ORDER BY det_id) AS id, dense_rank() OVER (PARTITION BY raster_id ORDER BY f) AS seen FROM (SELECT *, min(det_id) OVER (PARTITION BY raster_id, class_id) AS f FROM detections)", "detections")
def _(t):
    df = t.detections.withColumn("f", F.min("det_id").over(Window.partitionBy("raster_id", "class_id")))
    by = Window.partitionBy("raster_id")
    return df.select("det_id", F.row_number().over(Window.partitionBy("raster_id", "class_id").orderBy(F.desc("score"), "det_id")).cast("long").alias("rank"), F.row_number().over(by.orderBy("det_id")).cast("long").alias("id"), F.dense_rank().over(by.orderBy("f")).cast("long").alias("seen"))


@query("w5_progress", "SELECT day, sum(n_tiles) OVER (PARTITION BY year(day) ORDER BY day) AS done, round(sum(n_tiles) OVER (PARTITION BY year(day) ORDER BY day)*100.0/sum(n_tiles) OVER (PARTITION BY year(day)),6) AS pct FROM runs", "runs")
def _(t):
    w = Window.partitionBy(F.year("day"))
    done = F.sum("n_tiles").over(w.orderBy("day"))
    return t.runs.select("day", done.alias("done"), r6(done * 100.0 / F.sum("n_tiles").over(w), "pct"))


@query("o2_nearest_tiles", "SELECT det_id, tx, ty FROM (SELECT det_id, tx, ty, row_number() OVER (PARTITION BY det_id ORDER BY abs(tx-x1/512)+abs(ty-y1/512), ty, tx) AS r FROM detections, range(4) a(tx), range(4) b(ty)) WHERE r<=3", "detections")
def _(t):
    v = t.detections.selectExpr("det_id", "x1", "y1", "x1/512 AS cx", "y1/512 AS cy", "2048D AS x2", "2048D AS y2", "2048 AS width", "2048 AS height")
    df = grid.viewport_tiles(v.withColumns({"x1": F.lit(0.0), "y1": F.lit(0.0)}))
    near = Window.partitionBy("det_id").orderBy(F.abs(F.col("tx") - F.col("cx")) + F.abs(F.col("ty") - F.col("cy")), "ty", "tx")
    return df.withColumn("r", F.row_number().over(near)).where("r <= 3").selectExpr("det_id", "CAST(tx AS BIGINT) AS tx", "CAST(ty AS BIGINT) AS ty")


@query("u_set_operations", "SELECT raster_id FROM rasters WHERE raster_id NOT IN (SELECT raster_id FROM polygons WHERE side>300)", "rasters polygons")
def _(t):
    return t.rasters.select("raster_id").exceptAll(t.polygons.where("side > 300").select("raster_id").distinct())


# --- pixels ------------------------------------------------------------------------------------------------------

@query("a2_band_stats", "SELECT raster_id, band, round(coalesce(quantile_cont(value,0.02) FILTER (value<>-9999), quantile_cont(value,0.02)),6) AS p2, round(coalesce(quantile_cont(value,0.98) FILTER (value<>-9999), quantile_cont(value,0.98)),6) AS p98, round(min(value) FILTER (value<>-9999),6) AS vmin, round(max(value) FILTER (value<>-9999),6) AS vmax FROM pixels GROUP BY 1,2", "pixels")
def _(t):
    s = pixels.band_stats(t.pixels)
    return s.select("raster_id", "band", *[r6(F.col(c), c) for c in ("p2", "p98", "vmin", "vmax")])


@query("a3_input_means", "SELECT raster_id, band, round(coalesce(avg(value) FILTER (value>0),0),6) AS mean FROM pixels WHERE row%10=0 AND col%10=0 GROUP BY 1,2", "pixels")
def _(t):
    return pixels.input_means(t.pixels, 10).withColumn("mean", F.round("mean", 6))


@query("a4_adaptive_percentiles", "SELECT raster_id, band, round(quantile_cont(value,0.01) FILTER (value>0),6) AS lo, round(quantile_cont(value,0.99) FILTER (value>0),6) AS hi FROM pixels GROUP BY 1,2", "pixels")
def _(t):
    return pixels.adaptive_percentiles(t.pixels).select("raster_id", "band", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"))


TP = "tp AS (SELECT raster_id, CAST(floor(row/32) AS INT) AS ty, CAST(floor(col/32) AS INT) AS tx, band, quantile_cont(value,0.01) FILTER (value>0) AS lo, quantile_cont(value,0.99) FILTER (value>0) AS hi, count(*) FILTER (value>0)/count(*) AS share FROM pixels GROUP BY 1,2,3,4)"


@query("a5_tile_percentiles", f"WITH {TP} SELECT raster_id, ty, tx, band, round(CASE WHEN share>0.05 THEN lo END,6) AS lo, round(CASE WHEN share>0.05 THEN hi END,6) AS hi, round(share,6) AS share FROM tp", "pixels")
def _(t):
    return pixels.tile_percentiles(t.pixels).select("raster_id", "ty", "tx", "band", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"), r6(F.col("share"), "share"))


@query("p2_prepared_slots", f"WITH {TP} SELECT p.raster_id, p.band-1 AS slot, row, col, CAST(floor((greatest(lo,least(hi,value))-lo)/(hi-lo)*255) AS INT) AS value FROM pixels p JOIN tp ON tp.band=p.band AND ty=floor(row/32) AND tx=floor(col/32) WHERE p.band<=3 AND hi>lo AND share>0.05", "pixels")
def _(t):
    m = t.spark.createDataFrame([(0, 1, None, None), (1, 2, None, None), (2, 3, None, None)], "slot int, input_band int, p_low double, p_high double")
    return pixels.prepared(t.pixels, m)


@query("p5_display", "WITH s AS (SELECT band, quantile_cont(value,0.02) FILTER (value<>0) AS lo, quantile_cont(value,0.98) FILTER (value<>0) AS hi FROM pixels GROUP BY 1) SELECT raster_id, band, row, col, CAST(floor((greatest(lo,least(hi,value))-lo)/(hi-lo)*255) AS INT) AS value FROM pixels JOIN s USING (band)", "pixels")
def _(t):
    return pixels.display(t.pixels)


@query("p8_composite", "SELECT row, col, round(max(value) FILTER (band=1),6) AS r, round(max(value) FILTER (band=2),6) AS g, round(max(value) FILTER (band=3),6) AS b, floor(0.299*max(value) FILTER (band=1)+0.587*max(value) FILTER (band=2)+0.114*max(value) FILTER (band=3))::BIGINT AS luma FROM pixels GROUP BY 1,2", "pixels")
def _(t):
    c = pixels.composite(t.pixels)
    r, g, b = F.col("1"), F.col("2"), F.col("3")
    return c.select("row", "col", r6(r, "r"), r6(g, "g"), r6(b, "b"), pixels.luma(r, g, b).alias("luma"))


@query("p16_pyramid", "SELECT raster_id, level, band, CAST(floor(row/level) AS INT) AS row, CAST(floor(col/level) AS INT) AS col, round(avg(value)+0.0000000123,6) AS value FROM pixels, (SELECT unnest([2,4,8,16,32,64,128]) AS level) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1,2,3,CAST(floor(row/level) AS INT),CAST(floor(col/level) AS INT)"), "pixels")
def _(t):
    return pixels.pyramid(t.pixels).withColumn("value", F.round(F.col("value") + 0.0000000123, 6))  # no ties to round


@query("p17_area_resample", "SELECT raster_id, band, CAST(o AS INT) AS row, CAST(q AS INT) AS col, round(sum(value*wr*wc)/sum(wr*wc),6) AS value FROM (SELECT *, least((row+1)*0.4,o+1)-greatest(row*0.4,o) AS wr, least((col+1)*0.4,q+1)-greatest(col*0.4,q) AS wc FROM (SELECT *, unnest(range(CAST(floor(col*0.4) AS BIGINT), CAST(ceil((col+1)*0.4) AS BIGINT))) AS q FROM (SELECT *, unnest(range(CAST(floor(row*0.4) AS BIGINT), CAST(ceil((row+1)*0.4) AS BIGINT))) AS o FROM pixels))) GROUP BY 1,2,3,4", "pixels")
def _(t):
    return pixels.area_resampled(t.pixels, 0.4).withColumn("value", F.round("value", 6))


@query("a6_zonal_means", "SELECT p.raster_id, det_id AS zone_id, band, round(avg(value) FILTER (value<>-9999),6) AS mean FROM (SELECT det_id, x1%100 AS zx, floor(y1/4) AS zy FROM detections WHERE raster_id=0) z JOIN pixels p ON col<zx+6 AND col+1>zx AND row<zy+6 AND row+1>zy GROUP BY 1,2,3", "detections pixels")
def _(t):
    z = t.detections.join(t.pixels.select("raster_id").distinct(), "raster_id", "left_semi").selectExpr("raster_id", "det_id AS zone_id", "x1 % 100 AS x1", "CAST(floor(y1/4) AS DOUBLE) AS y1").selectExpr("*", "x1 + 6 AS x2", "y1 + 6 AS y2")
    return pixels.zonal_means(z, t.pixels).withColumn("mean", F.round("mean", 6))


LOCAL_HIT = "x>px AND x<px+side AND y>py AND y<py+side AND (polygon_id%2=0 OR x-px+y-py<side)"


@query("p11_polygon_mask", f"WITH c AS (SELECT DISTINCT row, col, row+0.5 AS y, col+0.5 AS x FROM pixels), keep AS (SELECT row, col, EXISTS (SELECT 1 FROM local_polygons WHERE role='aoi' AND {LOCAL_HIT}) AND NOT EXISTS (SELECT 1 FROM local_polygons WHERE role='exclude' AND {LOCAL_HIT}) AS k FROM c) SELECT raster_id, band, row, round(sum(CASE WHEN k THEN value ELSE 0 END),6) AS total FROM pixels JOIN keep USING (row, col) GROUP BY 1,2,3", "pixels local_polygons")
def _(t):
    return pixels.masked(t.pixels, t.local_polygons).groupBy("raster_id", "band", "row").agg(r6(F.sum("value"), "total"))


# --- routing, decoding -------------------------------------------------------------------------------------------

@query("r4_greedy_routing", """RECURSIVE WITH means AS (SELECT band, coalesce(avg(value) FILTER (value>0),0) AS mean FROM pixels WHERE row%10=0 AND col%10=0 GROUP BY 1), refs AS (SELECT band AS slot, avg(value)*1.1 AS ref FROM pixels GROUP BY 1),
    ranked AS (SELECT slot, band, abs(ref-mean) AS diff, row_number() OVER (ORDER BY abs(ref-mean), slot, band) AS r FROM refs, means),
    step AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS INT[]) AS slots, CAST([] AS INT[]) AS bands, CAST(0 AS DOUBLE) AS top UNION ALL
      SELECT s.r+1, CASE WHEN list_contains(slots, slot) OR list_contains(bands, band) THEN slots ELSE list_append(slots, slot) END, CASE WHEN list_contains(slots, slot) OR list_contains(bands, band) THEN bands ELSE list_append(bands, band) END, CASE WHEN list_contains(slots, slot) OR list_contains(bands, band) THEN top ELSE diff END FROM step s JOIN ranked k ON k.r=s.r+1)
    SELECT CAST(0 AS INT) AS raster_id, round(top,6) AS max_diff, len(slots) AS n_slots, top>0.05 AS attention FROM step ORDER BY r DESC LIMIT 1""", "pixels")
def _(t):
    refs = t.pixels.groupBy(F.col("band").alias("slot")).agg((F.avg("value") * 1.1).alias("mean")).selectExpr("slot", "'ref' AS source", "mean")
    return routing.mismatch(routing.greedy_assignment(refs, pixels.input_means(t.pixels, 10))).withColumn("max_diff", F.round("max_diff", 6))


@query("r8_band_mismatch", "SELECT raster_id, bands AS n_bands, CAST(4 AS INT) AS expected, raster_id%3=0 AS multiref, CASE WHEN raster_id%3=0 THEN CASE WHEN raster_id%5=0 THEN 0 ELSE greatest((raster_id*37)%100,(raster_id*74)%100)/1000.0 END ELSE abs(bands-4) END::DOUBLE AS max_diff, CASE WHEN raster_id%3=0 THEN raster_id%5<>0 AND greatest((raster_id*37)%100,(raster_id*74)%100)>50 ELSE bands<>4 END AS attention FROM scenes", "scenes")
def _(t):
    """Scenes of 1 to 9 bands for four slots; every third has several references, of those every fifth without an assignment."""
    slots = t.scenes.where("raster_id % 5 <> 0").select("raster_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("slot"))
    return routing.band_mismatch(t.scenes, slots.withColumn("diff", F.col("raster_id") * 37 * F.col("slot") % 100 / 1000), 4, F.col("raster_id") % 3 == 0)


#: Names that some band of each kind carries; they are put behind the part's own.
BAND_WORDS = ["Red Edge 1", "edge", "NIR 2", "near", "IR", "SWIR", "Coastal", "Yellow", "Blue", "Red", "Green", "Pan"]
R1_SLOT = "CASE WHEN d LIKE '%coastal%' THEN 0 WHEN d LIKE '%blue%' THEN 1 WHEN d LIKE '%green%' THEN 2 WHEN d LIKE '%yellow%' THEN 3 WHEN d LIKE '%red%' THEN 4 WHEN d LIKE '%edge%' THEN 5 WHEN d LIKE '%nir%' OR d LIKE '%near%' THEN 6 WHEN d LIKE '%ir%' THEN 7 END"


@query("r1_keyword_router", f"SELECT p_partkey, {R1_SLOT} AS slot FROM (SELECT p_partkey, lower(p_name || ' ' || ({BAND_WORDS})[CAST(p_partkey%12 AS INT)+1]) AS d FROM part)")
def _(t):
    word = F.get(F.array(*map(F.lit, BAND_WORDS)), (F.col("p_partkey") % 12).cast("int"))
    return t.part.select("p_partkey", routing.keyword_slot(F.concat("p_name", F.lit(" "), word)).alias("slot"))


@query("r7_strategy", "SELECT p_partkey, CASE WHEN p_size%7=0 THEN 'manual' WHEN p_size%4=0 AND p_size%3<>0 THEN 'identity' WHEN p_size%3=0 THEN 'multiref' WHEN p_size%2=0 THEN 'adaptive' ELSE 'error' END AS strategy FROM part")
def _(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", routing.strategy(s % 4, F.lit(0), s % 7 == 0, s % 3 == 0, s % 2 == 0).alias("strategy"))


@query("mo4_decode_rows", "SELECT vec_id AS tile_id, CAST(list_position(embedding[6:8], list_max(embedding[6:8]))-1 AS INT) AS class_id, round(embedding[5]::DOUBLE*list_max(embedding[6:8])::DOUBLE,6) AS score, round(least(embedding[1]::DOUBLE,embedding[3]::DOUBLE)*f,4) AS x1, round(greatest(embedding[2]::DOUBLE,embedding[4]::DOUBLE)*f,4) AS y2 FROM (SELECT *, CASE WHEN greatest(abs(embedding[1]),abs(embedding[2]),abs(embedding[3]),abs(embedding[4]))<=1.01 THEN 640 ELSE 1 END AS f FROM embeddings) WHERE embedding[5]::DOUBLE*list_max(embedding[6:8])::DOUBLE>=0.01 AND embedding[1]<>embedding[3] AND embedding[2]<>embedding[4] AND (embedding[1]::DOUBLE+embedding[3]::DOUBLE)/2*f BETWEEN 0 AND 640 AND (embedding[2]::DOUBLE+embedding[4]::DOUBLE)/2*f BETWEEN 0 AND 640")
def _(t):
    raw = t.embeddings.select(F.lit(0).alias("raster_id"), F.col("vec_id").alias("tile_id"), F.slice("embedding", 1, 8).alias("vec"))
    return decode.decode_rows(raw, 640.0, 0.01).select("tile_id", F.col("class_id").cast("int").alias("class_id"), r6(F.col("score"), "score"), F.round("x1", 4).alias("x1"), F.round("y2", 4).alias("y2"))


@query("mo3_transpose", "SELECT vec_id % 50 AS tile_id, CAST(i-1 AS INT) AS det_idx, round(max(embedding[i]) ,6) AS top FROM embeddings, range(1,65) r(i) GROUP BY 1,2")
def _(t):
    raw = t.embeddings.select(F.lit(0).alias("raster_id"), (F.col("vec_id") % 50).alias("tile_id"), F.col("vec_id").alias("feature"), F.col("embedding").alias("values"))
    return decode.transposed(raw).select("tile_id", "det_idx", r6(F.array_max("vec"), "top"))


def blob_model(x):
    """A stand-in model: one box around a tile's brightest pixel."""
    import numpy as np

    out = []
    for tile in x:
        i, j = np.unravel_index(tile.argmax(), tile.shape)
        out.append(np.array([[j - 1, i - 1, j + 1, i + 1, tile.max() * 255]]))
    return out


@query("mo1_score_tiles", "SELECT vec_id AS tile_id, CAST((p-1)%8 AS DOUBLE) AS x, round(m,4) AS score FROM (SELECT vec_id, list_max(embedding) AS m, list_position(embedding, list_max(embedding)) AS p FROM embeddings)")
def _(t):
    tiles = t.embeddings.select(F.lit(0).alias("raster_id"), F.col("vec_id").alias("tile_id"), F.col("embedding").alias("payload"))
    v = lambda i: F.get("vec", F.lit(i))
    return decode.score_tiles(tiles, blob_model, (8, 8)).select("tile_id", (v(0).cast("double") + 1).alias("x"), F.round(v(4), 4).alias("score"))


# --- geography, text ---------------------------------------------------------------------------------------------

@query("g_polygon_metrics", "SELECT polygon_id, CASE WHEN polygon_id%2=1 THEN side*side/2 ELSE side*side END AS area, round(CASE WHEN polygon_id%2=1 THEN side*(2+sqrt(2)) ELSE side*4 END,6) AS perimeter, round(side*sqrt(2),6) AS diameter, round(px + side/CASE WHEN polygon_id%2=1 THEN 3 ELSE 2 END,6) AS cx, true AS simple, 1 + CASE WHEN polygon_id%2=1 THEN 3 ELSE 4 END AS n_closed FROM polygons", "polygons")
def _(t):
    r = F.col("ring")
    return t.polygons.select("polygon_id", F.abs(G.signed_area(r)).alias("area"), r6(G.perimeter(r), "perimeter"), r6(G.diameter(r), "diameter"), r6(G.centroid(r)[0], "cx"), G.simple(r).alias("simple"), F.size(G.closed(r)).alias("n_closed"))


@query("g2_affine_round_trip", "SELECT det_id, round(x1,3) AS x, round(y1,3) AS y FROM detections", "detections rasters")
def _(t):
    df = t.detections.join(t.rasters, "raster_id")
    x, y = G.to_pixel(*G.to_crs(F.col("x1"), F.col("y1"), G.transform_cols()), G.transform_cols())
    return df.select("det_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("g4_lonlat_round_trip", "SELECT det_id, round(c+x1*a,4) AS x, round(f+y1*e,4) AS y FROM detections JOIN rasters USING (raster_id) WHERE epsg IS NOT NULL", "detections rasters")
def _(t):
    df = t.detections.join(t.rasters, "raster_id").where("epsg IS NOT NULL")
    lon, lat = G.to_lonlat(*G.to_crs(F.col("x1"), F.col("y1"), G.transform_cols()), F.col("epsg"))
    df = df.withColumn("lon", lon).withColumn("lat", lat)
    x, y = G.from_lonlat(F.col("lon"), F.col("lat"), F.col("epsg"))
    return df.select("det_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("g6_haversine", "SELECT s_suppkey, round(2*6371000*asin(sqrt(pow(sin(radians(s_nationkey/10.0)/2),2)+cos(radians(10.0))*cos(radians(10+s_nationkey/10.0))*pow(sin(radians(s_suppkey%30)/2),2))),3) AS m FROM supplier")
def _(t):
    m = G.haversine(F.lit(0.0), F.lit(10.0), (F.col("s_suppkey") % 30).cast("double"), 10 + F.col("s_nationkey") / 10.0)
    return t.supplier.select("s_suppkey", F.round(m, 3).alias("m"))


@query("k1_raw_export", "SELECT row_number() OVER (PARTITION BY raster_id ORDER BY det_id) AS id, raster_id, CASE class_id WHEN 0 THEN 'a class of a name of m' ELSE CAST(class_id AS VARCHAR) END[1:20] AS kelas, round_even(score,4) AS confidence, 'model ' || raster_id || ' of some length, cut'[1:CAST(24-len(CAST(raster_id AS VARCHAR)) AS BIGINT)] AS model, round_even(x1,1) AS x1_px, round_even(y1,1) AS y1_px, round_even(x2,1) AS x2_px, round_even(y2,1) AS y2_px, 'not_corrected' AS status, round(CASE WHEN epsg IS NULL THEN x1+0.5 ELSE c+(x1+0.5)*a END,6) AS geo_x1, round(CASE WHEN epsg IS NULL THEN -y1-0.5 ELSE f+(y1+0.5)*e END,6) AS geo_y1, round(CASE WHEN epsg IS NULL THEN x2+0.5 ELSE c+(x2+0.5)*a END,6) AS geo_x2, round(CASE WHEN epsg IS NULL THEN -y2-0.5 ELSE f+(y2+0.5)*e END,6) AS geo_y2, 5 AS n_ring, true AS is_closed FROM detections JOIN rasters USING (raster_id)", "detections rasters")
def _(t):
    model = F.concat(F.lit("model "), F.col("raster_id").cast("string"), F.lit(" of some length, cut"))
    df = saved.raw_detections(t.detections, t.rasters, model, F.create_map(F.lit(0), F.lit("a class of a name of m")))
    at = lambda i, k, alias: r6(F.get("ring", F.lit(i))[k], alias)
    corners = [at(0, "x", "geo_x1"), at(0, "y", "geo_y1"), at(2, "x", "geo_x2"), at(2, "y", "geo_y2")]
    return df.select(*df.columns[:-1], *corners, F.size("ring").alias("n_ring"), (F.get("ring", F.lit(0)) == F.get("ring", F.lit(4))).alias("is_closed"))


@query("s15_box_from_ring", "SELECT det_id, round(x1,3) AS x1, round(y1,3) AS y1, round(x2,3) AS x2, round(y2,3) AS y2 FROM detections", "detections rasters")
def _(t):
    df = t.detections.join(t.rasters, "raster_id")
    df = df.withColumn("ring", G.ring_to_crs(B.ring(B.cols()), G.transform_cols()))
    df = df.withColumn("p", G.ring_to_pixel(F.col("ring"), G.transform_cols()))
    side = lambda f, k: f(F.transform("p", lambda q: q[k]))
    return df.select("det_id", F.round(side(F.array_min, "x"), 3).alias("x1"), F.round(side(F.array_min, "y"), 3).alias("y1"), F.round(side(F.array_max, "x"), 3).alias("x2"), F.round(side(F.array_max, "y"), 3).alias("y2"))


SECRET = "coalesce(text,'') || ' Password=p' || doc_id || '&x token=t' || doc_id || ' auth=a ' || 'bearer ab.c' || doc_id || '== C:\\Users\\u' || doc_id || '\\f /home/u' || doc_id || '/x session_' || doc_id || ' TMP_z' || doc_id"
Z3_SQL = SECRET
for _pattern, _put in ((r"(password|passwd|pwd)=[^\s&]+", r"\1=***REDACTED***"), (r"(token|api_key|apikey)=[^\s&]+", r"\1=***REDACTED***"), (r"(secret|auth|authorization)=[^\s&]+", r"\1=***REDACTED***"), (r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer ***REDACTED***"), (r"\b([a-zA-Z])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b", r"\1***@\2"), (r"([C-Z]:\\Users\\)([^\\]+)(\\)", r"\1***\3"), (r"(/home/)([^/]+)", r"\1***"), (r"(session|temp|tmp)_[a-zA-Z0-9]+", r"\1_***")):
    Z3_SQL = f"regexp_replace({Z3_SQL}, '{_pattern}', '{_put}', 'gi')"


@query("z_text_helpers", f"SELECT doc_id, {Z3_SQL} AS text, CASE WHEN length(source)>18 THEN substr(source,1,15)||'...' ELSE source END AS short, CASE WHEN source LIKE '%.json' THEN 'vector' ELSE 'raster' END AS kind FROM documents")
def _(t):
    text = F.expr(SECRET.replace("\\", "\\\\"))
    return t.documents.select("doc_id", T.redacted(text).alias("text"), T.short_name(F.col("source")).alias("short"), T.layer_kind(F.col("source")).alias("kind"))


# --- corrections, registry ---------------------------------------------------------------------------------------

REPLAY = """step AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS hist, CAST(0 AS BIGINT) AS cur FROM corrections UNION ALL
    SELECT s.session_id, s.seq+1, CASE WHEN action IN ('undo','redo') THEN hist ELSE list_append(hist[1:cur], c.seq) END, CASE action WHEN 'undo' THEN greatest(0,cur-1) WHEN 'redo' THEN least(len(hist),cur+1) ELSE cur+1 END FROM step s JOIN corrections c ON c.session_id=s.session_id AND c.seq=s.seq+1),
    done AS (SELECT session_id, unnest(hist[1:cur]) AS seq FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC)=1))"""


@query("x4_effective_events", f"RECURSIVE WITH {REPLAY} SELECT session_id, seq, action, det_id FROM done JOIN corrections USING (session_id, seq)", "corrections")
def _(t):
    return corrections.effective(t.corrections).select("session_id", "seq", "action", "det_id")


@query("x5_effective_state", f"""RECURSIVE WITH {REPLAY}, folded AS (SELECT det_id, arg_max(CASE action WHEN 'delete' THEN 'eliminated' WHEN 'edit' THEN 'edited' ELSE 'added' END, event_id) AS status, max(event_id) FILTER (action <> 'delete') AS drawn, bool_or(action = 'add') AS added FROM done JOIN corrections USING (session_id, seq) GROUP BY 1)
    SELECT det_id, coalesce(status,'not_corrected') AS status, coalesce(drawn%1900,x1)::DOUBLE AS x1, coalesce(drawn%1900+30,x2)::DOUBLE AS x2, CASE WHEN added THEN 1.0 ELSE round(score,6) END AS score, CASE WHEN added THEN 'manual' ELSE 'c'||class_id END AS class_name FROM detections FULL JOIN folded USING (det_id)""", "detections corrections")
def _(t):
    at = (F.col("event_id") % 1900).cast("double")
    events = t.corrections.withColumns({"x1": at, "y1": at, "x2": at + 30, "y2": at + 30})
    return corrections.current_state(t.detections, events).select("det_id", "status", "x1", "x2", r6("score", "score"), "class_name")


@query("k15_registry_upsert", "SELECT model_name, arg_max(description, created_at) AS description, max(created_at) AS created_at FROM models GROUP BY 1", "models")
def _(t):
    return corrections.upserted(t.models).select("model_name", "description", "created_at")


@query("st3_live_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1,2")
def _(t):
    from tessera.streaming import streams

    e = t.events
    live = streams.live_counts(streams.events_stream(t.spark, f"{t.sf_dir}/events.parquet", e.schema), late="3650 days")
    done = streams.run_to_table(live, "live_counts", "complete")
    return done.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
