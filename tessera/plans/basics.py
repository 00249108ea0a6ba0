"""Queries over small column operators, model outputs, manual and adaptive mappings, and what falls back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import box as B
from tessera.functions import geo as G
from tessera.functions import text as T
from tessera.operators import corrections, decode, pixels, routing
from tessera.operators.storage import spread
from tessera.plans.queries import LOCAL_HIT, query, r6
from tessera.sources import stats, vector

# --- boxes, scalars, geography -----------------------------------------------------------------------------------


@query("b_record_shapes", "SELECT det_id, x1+512*class_id AS gx1, y2+1024 AS gy2, x1, y2, CAST(trunc(x2*1000/2048) AS INT) AS px2, CAST(trunc(y1*1000/2048) AS INT) AS py1, (['0,255,0','0,165,255','255,0,0','255,255,0','255,0,255'])[(class_id*7+det_id%4)%5+1] AS colour, greatest(1.0,CAST(det_id%9 AS DOUBLE)) AS w, greatest(1.0,CAST(det_id%4 AS DOUBLE)) AS h, det_id%9>=5 AND det_id%7>=5 AS drawn, det_id%9>=2 AND det_id%7>=2 AS resized FROM detections", "detections")
def _(t):
    df = t.detections.withColumns(dict(zip(("cx", "cy"), B.centre(B.cols())))).withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    centred = F.col("det_id") % 2 == 1  # every other record knows its centre and size only
    df = df.withColumns({c: F.when(~centred, F.col(c)) for c in ("x1", "y1", "x2", "y2")})
    df = df.withColumns(dict(zip(("x1", "y1", "x2", "y2"), B.corners(B.cols(), *map(F.col, ("cx", "cy", "w", "h"))))))
    moved, small = B.shifted(B.cols(), 512 * F.col("class_id"), F.lit(1024)), B.on_preview(B.cols(), F.lit(1000 / 2048))
    to = lambda n, m: (F.lit(0.0), F.lit(0.0), (F.col("det_id") % n).cast("double"), (F.col("det_id") % m).cast("double"))
    w, h = B.drawn_size(to(9, 4))
    colour = F.array_join(B.colour(F.col("class_id") * 7 + F.col("det_id") % 4).cast("array<string>"), ",")
    return df.select(
        "det_id", moved[0].alias("gx1"), moved[3].alias("gy2"), "x1", "y2", small[2].alias("px2"), small[1].alias("py1"), colour.alias("colour"), w.alias("w"), h.alias("h"),
        B.large_enough(to(9, 7)).alias("drawn"), B.large_enough(to(9, 7), B.LEAST_RESIZED).alias("resized"),
    )


@query("m_safe_scalars", "SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_quantity AS DOUBLE)=25 THEN -1 ELSE round(CAST(l_extendedprice AS DOUBLE)/(CAST(l_quantity AS DOUBLE)-25),6) END AS share, greatest(10.0,least(40.0,CAST(l_quantity AS DOUBLE))) AS clamped FROM lineitem")
def _(t):
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(T.safe_divide(p, q - 25, -1.0), "share"), T.clamp(q, F.lit(10.0), F.lit(40.0)).alias("clamped"))


#: A geodesic by its definition: the azimuth by bisection, the integrals of longitude and length by Simpson's rule.
GEODESICS = """RECURSIVE WITH p AS (SELECT c_custkey, (c_custkey*37)%360-180 AS lon1, (c_custkey*53)%170-85 AS lat1, c_custkey%10=0 AS far FROM customer),
    q AS (SELECT c_custkey, CASE WHEN far THEN 180-(c_custkey//10)%7*0.1::DOUBLE ELSE abs(((c_custkey*91)%360-180-lon1+540)%360-180) END AS dl, lat1::DOUBLE AS lat1, CASE WHEN far THEN -lat1+(c_custkey//70)%5*0.1::DOUBLE ELSE (c_custkey*29)%170-85 END::DOUBLE AS lat2 FROM p),
    b AS (SELECT *, radians(dl) AS lam, atan((1-1/298.257223563)*tan(radians(lat1))) AS b1, atan((1-1/298.257223563)*tan(radians(lat2))) AS b2 FROM q),
    c AS (SELECT c_custkey, lam, lat1, lat2, least(-greatest(abs(b1),abs(b2)),-1e-100) AS u, CASE WHEN abs(b1)>=abs(b2) THEN b2*CASE WHEN b1>0 THEN -1 ELSE 1 END ELSE b1*CASE WHEN b2>0 THEN -1 ELSE 1 END END AS v, (SELECT list(i ORDER BY i) FROM range(201) t(i)) AS few FROM b),
    bis AS (SELECT *, 0::DOUBLE AS lo, pi() AS hi, 0 AS n FROM c UNION ALL
      SELECT c_custkey, lam, lat1, lat2, u, v, few, CASE WHEN o THEN lo ELSE mid END, CASE WHEN o THEN mid ELSE hi END, n+1 FROM (SELECT *, w2-w1-1/298.257223563*s0*(t2-t1)/600*list_sum([CASE WHEN i=0 OR i=200 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END*(2-1/298.257223563)/(1+(1-1/298.257223563)*sqrt(1+k2*pow(sin(t1+(t2-t1)*i/200),2))) for i in few])>lam AS o
        FROM (SELECT *, atan2(sin(u),cos(mid)*cos(u)) AS t1, atan2(sin(v),y) AS t2, atan2(s0*sin(u),cos(mid)*cos(u)) AS w1, atan2(s0*sin(v),y) AS w2, 0.006739496742276434*(1-s0*s0) AS k2
          FROM (SELECT *, sin(mid)*cos(u) AS s0, sqrt(greatest(0,pow(cos(mid)*cos(u),2)+pow(sin(u),2)-pow(sin(v),2))) AS y FROM (SELECT *, (lo+hi)/2 AS mid FROM bis WHERE n<52) x) x) x) x),
    e AS (SELECT *, atan2(sin(u),cos(mid)*cos(u)) AS t1, atan2(sin(v),sqrt(greatest(0,pow(cos(mid)*cos(u),2)+pow(sin(u),2)-pow(sin(v),2)))) AS t2, 0.006739496742276434*(1-pow(sin(mid)*cos(u),2)) AS k2 FROM (SELECT *, (lo+hi)/2 AS mid FROM bis WHERE n=52) x),
    m AS (SELECT c_custkey, sum(CASE WHEN i=0 OR i=4000 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END*sqrt(1+k2*pow(sin(t1+(t2-t1)*i/4000),2)))*6356752.314245179*(any_value(t2)-any_value(t1))/12000 AS m FROM e, range(4001) r(i) GROUP BY 1)
    SELECT c_custkey, round(CASE WHEN lat1=0 AND lat2=0 AND lam<=(1-1/298.257223563)*pi() THEN 6378137*lam ELSE m END,2) AS metres FROM c JOIN m USING (c_custkey)"""


@query("g7_ellipsoid_distances", GEODESICS)
def _(t):
    k = F.col("c_custkey")
    lon1, lat1 = (k * 37) % 360 - 180, (k * 53) % 170 - 85
    far = k % 10 == 0  # every tenth pair lies on opposite sides of the globe, or nearly so
    lon2 = F.when(far, lon1 + 180 - F.floor(k / 10) % 7 * F.lit(0.1)).otherwise((k * 91) % 360 - 180)
    lat2 = F.when(far, -lat1 + F.floor(k / 70) % 5 * F.lit(0.1)).otherwise((k * 29) % 170 - 85)
    return spread(t.customer).select("c_custkey", F.round(G.geodesic(lon1, lat1, lon2, lat2), 2).alias("metres"))


@query("g16_pixel_sizes", "SELECT raster_id, round(CASE WHEN epsg IS NULL OR epsg=4326 THEN abs(a)*111320*cos(radians(f)) ELSE abs(a) END,6) AS w, round(CASE WHEN epsg IS NULL OR epsg=4326 THEN abs(e)*111320 ELSE abs(e) END,6) AS h FROM scenes", "scenes")
def _(t):
    w, h = G.pixel_size_m(F.col("a"), F.col("e"), F.col("f"), F.coalesce(F.col("epsg") == 4326, F.lit(True)))
    return t.scenes.select("raster_id", r6(w, "w"), r6(h, "h"))


@query("g25_square_buffers", "SELECT det_id, CAST(i-1 AS INT) AS i, (x1+x2)/2+([-1,1,1,-1,-1])[i]*r AS x, (y1+y2)/2+([1,1,-1,-1,1])[i]*r AS y FROM (SELECT *, least(x2-x1,y2-y1)/2 AS r FROM detections), range(1,6) g(i)", "detections")
def _(t):
    ring = G.square(*B.centre(B.cols()), B.circle(B.cols(), F.lit(1.0), F.lit(1.0))["radius_px"])
    return t.detections.select("det_id", F.posexplode(ring).alias("i", "p")).select("det_id", "i", "p.x", "p.y")


@query("g26_thinned_rings", """RECURSIVE WITH v AS (SELECT polygon_id, i, CAST((polygon_id*31+i*i*7)%23 AS DOUBLE) AS x, CAST((polygon_id*17+i*5)%19 AS DOUBLE) AS y FROM polygons, range(30) r(i)),
    walk AS (SELECT polygon_id, i, x AS lx, y AS ly, 1 AS n, x AS sx, y AS sy FROM v WHERE i=0 UNION ALL
      SELECT w.polygon_id, v.i, CASE WHEN k THEN v.x ELSE lx END, CASE WHEN k THEN v.y ELSE ly END, n+CAST(k AS INT), sx+CASE WHEN k THEN v.x*n ELSE 0 END, sy+CASE WHEN k THEN v.y*n ELSE 0 END
      FROM walk w JOIN (SELECT * FROM v) v ON v.polygon_id=w.polygon_id AND v.i=w.i+1, LATERAL (SELECT (v.x-lx)*(v.x-lx)+(v.y-ly)*(v.y-ly)>=16 AS k) z)
    SELECT polygon_id, n, sx, sy FROM walk WHERE i=29""", "polygons")
def _(t):
    k = F.col("polygon_id")
    ring = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: G.point(((k * 31 + i * i * 7) % 23).cast("double"), ((k * 17 + i * 5) % 19).cast("double")))
    df = t.polygons.select("polygon_id", G.thinned(ring).alias("r"))
    # The first vertex counts once, each later one as often as there are vertices before it.
    at = lambda c: F.aggregate(F.transform("r", lambda p, i: p[c] * F.greatest(i, F.lit(1))), F.lit(0.0), lambda s, x: s + x)
    return df.select("polygon_id", F.size("r").alias("n"), at("x").alias("sx"), at("y").alias("sy"))


@query("s9_either_coordinates", "SELECT raster_id, CAST(i-1 AS INT) AS i, CAST(([10,210,110])[i] AS DOUBLE) AS x, CAST(([20,20,220])[i] AS DOUBLE) AS y FROM scenes, range(1,4) g(i)", "scenes")
def _(t):
    pixel = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((10.0, 20.0), (210.0, 20.0), (110.0, 220.0))])
    tr, epsg = G.transform_cols(), F.col("epsg")
    crs = G.ring_to_crs(pixel, tr)
    lonlat = F.transform(crs, lambda p: G.lonlat_point(p["x"], p["y"], epsg))
    given = F.when(epsg.isNotNull() & (F.col("raster_id") % 2 == 0), lonlat).otherwise(crs)  # both kinds come in
    df = spread(t.scenes).select("raster_id", F.posexplode(vector.either_to_pixel(given, tr, epsg)).alias("i", "p"))
    return df.select("raster_id", "i", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


# --- mappings, statistics, corrections ---------------------------------------------------------------------------


@query("r6_manual_mapping", """WITH m AS (SELECT raster_id, bands, s, CASE WHEN (raster_id+s)%4<>0 THEN CAST((raster_id*3+s*s)%11 AS INT) END AS b FROM scenes, range(8) r(s))
    SELECT raster_id, CAST(s AS INT) AS slot, b AS input_band, CASE WHEN b IS NULL THEN 'blank' WHEN b NOT BETWEEN 1 AND bands THEN 'out_of_range' WHEN count(*) OVER (PARTITION BY raster_id, b)>1 THEN 'duplicate' ELSE 'ok' END AS status FROM m""", "scenes")
def _(t):
    given = t.scenes.select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("slot"))  # slots 8 and 9 are unknown
    s = F.col("slot")
    band = F.when((F.col("raster_id") + s) % 4 != 0, (F.col("raster_id") * 3 + s * s) % 11).cast("int")
    return routing.checked_mapping(given.withColumn("input_band", band), t.scenes, list(range(8)))


@query("r5_adaptive_mapping", "SELECT raster_id, CASE band WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 5 END AS slot, CAST(band AS INT) AS input_band, round(coalesce(quantile_cont(value,0.01) FILTER (value>0),0),6) AS p_low, round(coalesce(quantile_cont(value,0.99) FILTER (value>0),255),6) AS p_high FROM pixels WHERE row%2=0 AND col%2=0 AND band<=3 GROUP BY raster_id, band", "pixels")
def _(t):
    df = pixels.adaptive_mapping(t.pixels, [5, 0, 2], step=2)
    return df.select("raster_id", "slot", F.col("input_band").cast("int").alias("input_band"), r6(F.col("p_low"), "p_low"), r6(F.col("p_high"), "p_high"))


@query("s12_band_statistics", """SELECT p_partkey AS raster_id, 0 AS slot, NULL AS source, CAST(p_size+0.5 AS DOUBLE) AS mean, CAST(p_size AS DOUBLE) AS p_low, CAST(p_size*2 AS DOUBLE) AS p_high FROM part WHERE p_partkey%7<>0
    UNION ALL SELECT p_partkey, CAST(p_partkey%6+1 AS INT), s, CAST(p_size*k AS DOUBLE), NULL, CAST(p_size+k AS DOUBLE) FROM part, (VALUES ('near', 2), ('far', 3)) v(s, k) WHERE p_partkey%7<>0""")
def _(t):
    text = F.format_string('{"0": {"mean": %d.5, "p_low": %d, "p_high": %d}, "%d": {"sources": {"near": {"mean": %d, "p_high": %d}, "far": {"mean": %d, "p_high": %d}}}}', *map(F.expr, ("p_size", "p_size", "p_size*2", "p_partkey%6+1", "p_size*2", "p_size+2", "p_size*3", "p_size+3")))
    files = t.part.select(F.col("p_partkey").alias("raster_id"), F.when(F.col("p_partkey") % 7 == 0, "no statistics").otherwise(text).alias("text"))
    return stats.band_statistics(files)


@query("x1_added_boxes", """WITH e AS (SELECT CAST(floor(det_id/3750) AS INT) AS raster_id, event_id FROM corrections WHERE action='add'), m AS (SELECT raster_id, max(det_id) AS top FROM detections GROUP BY 1)
    SELECT raster_id, event_id, CAST(coalesce(top,-1)+row_number() OVER (PARTITION BY raster_id ORDER BY event_id) AS BIGINT) AS det_id, CAST(event_id%1900 AS DOUBLE) AS x1, CAST(event_id%1900+40 AS DOUBLE) AS x2, CAST(1 AS DOUBLE) AS score, 'manual' AS class_name, 'added' AS status FROM e LEFT JOIN m USING (raster_id)""", "corrections detections")
def _(t):
    x = (F.col("event_id") % 1900).cast("double")
    events = t.corrections.withColumns({"raster_id": F.floor(F.col("det_id") / 3750).cast("int"), "x1": x, "y1": x, "x2": x + 40, "y2": x + 40})
    return corrections.added_boxes(events, t.detections).drop("y1", "y2")


# --- pixels ------------------------------------------------------------------------------------------------------


@query("p3_unit_range", "WITH s AS (SELECT raster_id, band, quantile_cont(value,0.02) FILTER (value>0) AS lo, quantile_cont(value,0.98) FILTER (value>0) AS hi, count(*) FILTER (value>0) AS n FROM pixels GROUP BY 1,2) SELECT raster_id, band, row, col, round(CASE WHEN n>100 AND hi>lo THEN (greatest(lo,least(hi,value))-lo)/(hi-lo) ELSE 0 END,6) AS value FROM pixels JOIN s USING (raster_id, band)", "pixels")
def _(t):
    return pixels.unit_range(t.pixels).select("raster_id", "band", "row", "col", r6(F.col("value"), "value"))


@query("a7_box_means", f"""WITH c AS (SELECT DISTINCT row, col, row+0.5 AS y, col+0.5 AS x FROM pixels), keep AS (SELECT row, col, EXISTS (SELECT 1 FROM local_polygons WHERE role='aoi' AND {LOCAL_HIT}) AND NOT EXISTS (SELECT 1 FROM local_polygons WHERE role='exclude' AND {LOCAL_HIT}) AS k FROM c),
    b AS (SELECT raster_id, det_id, x1%90+0.25 AS x1, y1%30+0.25 AS y1, x1%90+det_id%3+1.5 AS x2, y1%30+det_id%4+1.25 AS y2 FROM detections)
    SELECT raster_id, det_id, band, round(avg(value) FILTER (k),6) AS mean FROM pixels JOIN keep USING (row, col) JOIN b USING (raster_id) WHERE col>=floor(x1) AND col<ceil(x2) AND row>=floor(y1) AND row<ceil(y2) GROUP BY 1,2,3""", "pixels local_polygons detections")
def _(t):
    x, y = F.col("x1") % 90, F.col("y1") % 30
    boxes = t.detections.select("raster_id", "det_id", (x + 0.25).alias("x1"), (y + 0.25).alias("y1"), (x + F.col("det_id") % 3 + 1.5).alias("x2"), (y + F.col("det_id") % 4 + 1.25).alias("y2"))
    return pixels.box_means(t.pixels, boxes, t.local_polygons).select("raster_id", "det_id", "band", r6(F.col("mean"), "mean"))


@query("j12_display_by_statistics", """WITH g AS (SELECT raster_id, band, quantile_cont(value,0.02) AS p2, quantile_cont(value,0.98) AS p98 FROM pixels WHERE value<>-9999 AND band<=2 GROUP BY 1,2),
    s AS (SELECT raster_id, row//32 AS ty, col//32 AS tx, band, quantile_cont(value,0.02) AS q2, quantile_cont(value,0.98) AS q98, min(value) AS low, max(value) AS top FROM pixels GROUP BY 1,2,3,4),
    u AS (SELECT s.*, coalesce(p2,q2) AS lo, coalesce(p98,q98) AS hi FROM s LEFT JOIN g USING (raster_id, band))
    SELECT raster_id, band, row, col, CAST(CASE WHEN hi>lo THEN floor((greatest(lo,least(hi,value))-lo)/(hi-lo)*255) WHEN top<=1 AND low>=0 THEN 128 ELSE 0 END AS INT) AS value FROM (SELECT *, row//32 AS ty, col//32 AS tx FROM pixels) p JOIN u USING (raster_id, band, ty, tx)""", "pixels")
def _(t):
    known = pixels.band_stats(t.pixels.where("band <= 2"))  # the other bands fall back to their tiles
    return pixels.display_tiles(t.pixels, stats=known)


# --- model outputs -----------------------------------------------------------------------------------------------

_TILE = "0.5+vec_id%3*0.25 AS scale, vec_id%5 AS left_, vec_id%7 AS top_, 512*(vec_id%10) AS tile_x, 512*(vec_id%6) AS tile_y, 600.0 AS tile_w, 500.0 AS tile_h"
_PLACED = """p AS (SELECT *, greatest(0,least(tile_w,least(bx1,bx2))) AS u1, greatest(0,least(tile_h,least(by1,by2))) AS v1, greatest(0,least(tile_w,greatest(bx1,bx2))) AS u2, greatest(0,least(tile_h,greatest(by1,by2))) AS v2 FROM
      (SELECT *, (x1-left_)/scale AS bx1, (y1-top_)/scale AS by1, (x2-left_)/scale AS bx2, (y2-top_)/scale AS by2 FROM boxed) b),
    d AS (SELECT *, least(u1,v1,tile_w-u2,tile_h-v2) AS gap FROM p WHERE u2>u1 AND v2>v1 AND score>=0.05)
    SELECT vec_id AS tile_id, CAST(i AS INT) AS det_idx, CAST(i%3 AS INT) AS class_id, round(score,6) AS score, round(u1+tile_x,4) AS x1, round(v1+tile_y,4) AS y1, round(u2+tile_x,4) AS x2, round(v2+tile_y,4) AS y2, gap<=32 AS edge, round(greatest(0,least(1,gap/250)),6) AS border_dist FROM d"""


def _outputs(t, boxes: str):
    v = F.col("vec_id")
    at = {"scale": 0.5 + v % 3 * 0.25, "left": v % 5, "top": v % 7, "tile_x": 512 * (v % 10), "tile_y": 512 * (v % 6), "tile_w": F.lit(600), "tile_h": F.lit(500)}
    few = F.when(v % 4 == 0, 3).otherwise(5)
    lists = {"boxes": F.expr(boxes), "labels": F.transform(F.sequence(F.lit(0), few - 1), lambda i: i % 3)}
    return t.embeddings.select(F.lit(0).alias("raster_id"), v.alias("tile_id"), *[c.alias(n) for n, c in (at | lists).items()], "embedding", "vec_id")


def _found(df):
    return df.select("tile_id", "det_idx", "class_id", r6(F.col("score"), "score"), *[F.round(c, 4).alias(c) for c in decode.SIDES], "edge", r6(F.col("border_dist"), "border_dist"))


@query("mo5_three_outputs", f"""WITH r AS (SELECT vec_id, i, {_TILE}, CASE vec_id%3 WHEN 0 THEN 1 WHEN 1 THEN 300 ELSE 12 END AS k, [abs(embedding[i*8+1]::DOUBLE),abs(embedding[i*8+2]::DOUBLE),abs(embedding[i*8+3]::DOUBLE),abs(embedding[i*8+4]::DOUBLE)] AS b, abs(embedding[41+i]::DOUBLE) AS score FROM embeddings, range(5) g(i)),
    f AS (SELECT *, CASE WHEN max(list_max(b)*k) OVER (PARTITION BY vec_id)<=1.01 THEN 640 ELSE 1 END AS f FROM r),
    f2 AS (SELECT *, CASE WHEN list_max(b)*k*f<=1.01 THEN 640 ELSE 1 END AS g FROM f),
    boxed AS (SELECT *, b[1]*k*f*g AS x1, b[2]*k*f*g AS y1, b[3]*k*f*g AS x2, b[4]*k*f*g AS y2 FROM f2 WHERE i<3 OR vec_id%4<>0), {_PLACED}""")
def _(t):
    boxes = "transform(sequence(0, 4), i -> transform(slice(embedding, i*8+1, 4), x -> abs(CAST(x AS DOUBLE)) * CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 300 ELSE 12 END))"
    df = _outputs(t, boxes).withColumn("scores", F.transform(F.slice("embedding", 41, 6), lambda x: F.abs(x.cast("double"))))
    return _found(decode.decode_three(df, 640.0, 0.05))


@query("mo6_two_stage", f"""WITH boxed AS (SELECT vec_id, i, {_TILE}, embedding[i*8+1]::DOUBLE*2000 AS x1, embedding[i*8+2]::DOUBLE*2000 AS y1, embedding[i*8+3]::DOUBLE*2000 AS x2, embedding[i*8+4]::DOUBLE*2000 AS y2, abs(embedding[41+i]::DOUBLE) AS score FROM embeddings, range(5) g(i) WHERE vec_id%4<>0), {_PLACED}""")
def _(t):
    boxes = "transform(sequence(0, 4), i -> transform(slice(embedding, i*8+1, 4), x -> CAST(x AS DOUBLE) * 2000))"
    df = _outputs(t, boxes).withColumn("scores", F.transform(F.slice("embedding", 41, 5), lambda x: F.abs(x.cast("double"))))
    return _found(decode.decode_lists(df, 0.05))


@query("mo3_corner_rows", """WITH v AS (SELECT vec_id%50 AS tile_id, i-1 AS i, row_number() OVER (PARTITION BY vec_id%50, i ORDER BY vec_id) AS f, embedding[i]::DOUBLE AS e FROM embeddings, range(1,65) r(i)),
    w AS (SELECT tile_id, i, max(e) FILTER (f=1) AS cx, max(e) FILTER (f=2) AS cy, max(e) FILTER (f=3) AS w, max(e) FILTER (f=4) AS h, max(e) FILTER (f>4) AS top FROM v GROUP BY 1,2)
    SELECT tile_id, CAST(i AS INT) AS det_idx, round(cx-w/2,6) AS x1, round(cy-h/2,6) AS y1, round(cx+w/2,6) AS x2, round(cy+h/2,6) AS y2, round(top,6) AS top FROM w""")
def _(t):
    raw = t.embeddings.select(F.lit(0).alias("raster_id"), (F.col("vec_id") % 50).alias("tile_id"), F.col("vec_id").alias("feature"), F.col("embedding").alias("values"))
    df = decode.from_centres(decode.transposed(raw))
    return df.select("tile_id", "det_idx", *[r6(F.get("vec", F.lit(i)), c) for i, c in enumerate(decode.SIDES)], r6(F.array_max(F.slice("vec", F.lit(5), F.size("vec"))), "top"))


@query("mo7_layouts", """SELECT p_partkey, CASE WHEN k=2 THEN 'lists' ELSE 'rows' END AS kind, k IN (0,1,2,5,6) OR (k=3 AND p_size%4=3) AS valid, k=1 AS transposed, CAST(CASE k WHEN 0 THEN 1000+p_size WHEN 1 THEN 1001+p_size WHEN 3 THEN 500 WHEN 5 THEN 8400 WHEN 6 THEN 8400 END AS INT) AS detections, CAST(CASE k WHEN 0 THEN 5+p_size WHEN 1 THEN 5+p_size WHEN 3 THEN 2+p_size%4 WHEN 5 THEN 85 WHEN 6 THEN 5+p_size END AS INT) AS features FROM (SELECT *, p_partkey%8 AS k FROM part)""")
def _(t):
    shapes = {0: "array(array(1, 1000+n, 5+n))", 1: "array(array(1, 5+n, 1001+n))", 2: "array(array(n, 4), array(n), array(n))", 3: "array(array(1, 500, 2+n%4))", 4: "array(array(1000, 85))", 5: "array(array(1, null, null))", 6: "array(array(1, null, 5+n))"}
    cases = " ".join(f"WHEN {k} THEN CAST({s} AS array<array<int>>)" for k, s in shapes.items())
    df = t.part.selectExpr("p_partkey", "p_size AS n").selectExpr("p_partkey", f"CASE p_partkey % 8 {cases} ELSE CAST(array() AS array<array<int>>) END AS s")
    return df.select("p_partkey", decode.layout(F.col("s")).alias("l")).select("p_partkey", "l.*")


@query("mo9_tile_shapes", "SELECT p_partkey, CAST(CASE p_partkey%7 WHEN 4 THEN 9 WHEN 5 THEN 0 WHEN 6 THEN 4 ELSE 100+p_size END AS INT) AS h, CAST(CASE p_partkey%7 WHEN 4 THEN 100+p_size WHEN 5 THEN 0 WHEN 6 THEN 3 ELSE 200+p_size END AS INT) AS w FROM part")
def _(t):
    shapes = ["array(100+n, 200+n)", "array(3, 100+n, 200+n)", "array(100+n, 200+n, 3)", "array(1, 3, 100+n, 200+n)", "array(9, 100+n, 50)", "array(7)", "array(2, 4, 3)"]
    cases = " ".join(f"WHEN {k} THEN CAST({s} AS array<int>)" for k, s in enumerate(shapes))
    df = t.part.selectExpr("p_partkey", "p_size AS n").selectExpr("p_partkey", f"CASE p_partkey % 7 {cases} END AS s")
    h, w = decode.tile_shape(F.col("s"))
    return df.select("p_partkey", h.cast("int").alias("h"), w.cast("int").alias("w"))


# --- streams -----------------------------------------------------------------------------------------------------


@query("st2_current_generation", "SELECT event_id, user_id FROM (SELECT *, event_id%3 AS generation, max(event_id) OVER (PARTITION BY user_id)%3 AS current FROM events) e WHERE generation=current")
def _(t):
    from tessera.streaming import streams

    now = t.events.groupBy("user_id").agg((F.max("event_id") % 3).alias("current"))
    live = streams.events_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema)
    twice = live.withColumns({"generation": F.col("event_id") % 3, "copy": F.explode(F.array(F.lit(0), F.lit(1)))})  # each event arrives twice
    return streams.run_to_table(streams.current_generation(twice, now), "current").select("event_id", "user_id")
