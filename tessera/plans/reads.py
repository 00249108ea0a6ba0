"""Queries over reads, saved detections, metrics, display bytes, routing, checks and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo as G
from tessera.functions import text as T
from tessera.operators import checks, corrections, pixels, reads, routing, saved, spatial
from tessera.operators.storage import spread
from tessera.plans.exports import TIE, names
from tessera.plans.queries import BAND_WORDS, R1_SLOT, query, r6

# --- routing -----------------------------------------------------------------------------------------------------

_PROFILE = "CASE bands WHEN 3 THEN MAP {4:0,2:1,1:2} WHEN 4 THEN MAP {4:0,2:1,1:2,6:3} WHEN 5 THEN MAP {4:0,2:1,1:2,5:3,6:4} WHEN 7 THEN MAP {1:0,2:1,4:2,6:5} ELSE CASE WHEN bands>=8 THEN MAP {0:0,1:1,2:2,3:3,4:4,5:5,6:6,7:7} ELSE MAP {99:99} END END"
_ROUTED = f"""bands_ AS (SELECT raster_id, bands, i, lower(({BAND_WORDS})[CAST((raster_id+i*5)%12 AS INT)+1]) AS d FROM scenes, range(9) r(i) WHERE i<bands AND raster_id%3<>0),
    words AS (SELECT raster_id, slot, max(i) AS band FROM (SELECT raster_id, i, {R1_SLOT} AS slot FROM bands_) WHERE slot IS NOT NULL GROUP BY 1,2),
    enough AS (SELECT s.raster_id, count(w.slot)>=least(any_value(s.bands),3) AS ok FROM scenes s LEFT JOIN words w USING (raster_id) GROUP BY 1),
    routed AS (SELECT raster_id, CAST(slot AS INT) AS slot, CAST(band AS INT) AS band FROM words JOIN enough USING (raster_id) WHERE ok UNION ALL
      SELECT raster_id, CAST(e.key AS INT), CAST(e.value AS INT) FROM (SELECT raster_id, unnest(map_entries({_PROFILE})) AS e FROM scenes JOIN enough USING (raster_id) WHERE NOT ok) WHERE e.key<99)"""


def _routed(t):
    words = F.array(*map(F.lit, BAND_WORDS))
    i = F.sequence(F.lit(0), F.col("bands") - 1)
    described = F.transform(i, lambda k: F.get(words, ((F.col("raster_id") + k * 5) % 12).cast("int")))
    none = F.array().cast("array<string>")
    return spread(t.scenes).withColumn("mapping", routing.routed(F.when(F.col("raster_id") % 3 != 0, described).otherwise(none), F.col("bands")))


@query("r2_routed_slots", f"WITH {_ROUTED} SELECT * FROM routed", "scenes")
def _(t):
    return _routed(t).select("raster_id", F.explode("mapping").alias("slot", "band"))


@query("r3_rgb_indices", f"WITH {_ROUTED} SELECT s.raster_id, coalesce(max(band) FILTER (slot=4),0) AS r, coalesce(max(band) FILTER (slot=2),least(1,any_value(bands)-1)) AS g, coalesce(max(band) FILTER (slot=1),least(2,any_value(bands)-1)) AS b FROM scenes s LEFT JOIN routed USING (raster_id) GROUP BY 1", "scenes")
def _(t):
    return _routed(t).select("raster_id", routing.rgb_indices(F.col("mapping"), F.col("bands")).alias("i")).select("raster_id", "i.*")


@query("r3_slotted", "SELECT raster_id, CAST(slot AS INT) AS slot, row, col, coalesce(max(value) FILTER (band=CASE slot WHEN 4 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 WHEN 6 THEN 4 END),0) AS value FROM pixels, range(8) r(slot) GROUP BY raster_id, slot, row, col", "pixels")
def _(t):
    mapping = t.rasters.select("raster_id", routing.profile(F.col("bands")).alias("mapping"))
    return routing.slotted(t.pixels, mapping)


@query("r9_band_labels", "SELECT raster_id, CAST(i+1 AS INT) AS band, 'Band '||(i+1)||coalesce(' ('||CASE WHEN bands=3 THEN ['Red','Green','Blue'][i+1] WHEN bands=4 THEN ['Red','Green','Blue','NIR/Alpha'][i+1] WHEN bands>=7 THEN ['Blue','Green','Red','NIR','Red Edge','Red Edge 2','Red Edge 3'][i+1] END||')','') AS label FROM scenes, range(9) r(i) WHERE i<bands", "scenes")
def _(t):
    df = t.scenes.select("raster_id", "bands", F.explode(F.sequence(F.lit(1), F.col("bands"))).alias("band"))
    return df.select("raster_id", "band", routing.band_label(F.col("band"), F.col("bands")).alias("label"))


@query("p10_display_bands", "SELECT raster_id, list_reduce(CASE WHEN bands>=3 THEN [1,2,3] WHEN bands=2 THEN [1,2] ELSE [1] END, lambda a, b: a*10+b) AS plain, CASE WHEN bands>=5 THEN 25 WHEN bands>=2 THEN 2 ELSE 1 END AS wanted FROM scenes", "scenes")
def _(t):
    digits = lambda bands: F.aggregate(bands, F.lit(0), lambda a, b: a * 10 + b)
    wanted = pixels.display_bands(F.col("bands"), F.array(F.lit(2), F.lit(5), F.lit(11)))
    return t.scenes.select("raster_id", digits(pixels.display_bands(F.col("bands"))).alias("plain"), digits(wanted).alias("wanted"))


# --- reads -------------------------------------------------------------------------------------------------------

@query("p19_overview_levels", "SELECT det_id, CAST(CASE WHEN z>=1 THEN 0 ELSE list_position(g, list_min(g))-1 END AS INT) AS level FROM (SELECT det_id, z, list_transform([1,2,4,8,16,32,64,128], lambda f: abs(f-1/greatest(z,0.000001))) AS g FROM (SELECT det_id, CASE WHEN det_id%5=0 THEN score*1.2 ELSE score*score*0.3 END AS z FROM detections))", "detections")
def _(t):
    z = F.when(F.col("det_id") % 5 == 0, F.col("score") * 1.2).otherwise(F.col("score") * F.col("score") * 0.3)
    return t.detections.select("det_id", pixels.best_level(z).alias("level"))


@query("s2_window", "SELECT raster_id, CASE band WHEN 3 THEN 0 ELSE 1 END AS channel, band, row-2 AS row, col-10 AS col, value FROM pixels WHERE row BETWEEN 2 AND 21 AND col BETWEEN 10 AND 59 AND band IN (3,1)", "pixels")
def _(t):
    return reads.window(t.pixels, 10, 2, 50, 20, [3, 1])


@query("s2_window_coarse", f"SELECT raster_id, band-1 AS channel, band, CAST((row-4)//4 AS INT) AS row, CAST((col-8)//4 AS INT) AS col, round(avg(value)+{TIE:.10f},6) AS value FROM pixels WHERE row BETWEEN 4 AND 11 AND col BETWEEN 8 AND 47 GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY raster_id, band, (row-4)//4, (col-8)//4"), "pixels")
def _(t):
    return reads.window(t.pixels, 8, 4, 40, 8, level_factor=4).withColumn("value", F.round(F.col("value") + TIE, 6))


@query("s3_downsampled", f"SELECT raster_id, band, CAST(row//4 AS INT) AS row, CAST(col//4 AS INT) AS col, round(avg(value)+{TIE:.10f},6) AS value FROM pixels GROUP BY raster_id, band, row//4, col//4", "pixels")
def _(t):
    return reads.downsampled(t.pixels, t.rasters, 512).withColumn("value", F.round(F.col("value") + TIE, 6))


@query("s4_dual", f"SELECT raster_id, l AS level, band, CAST(row//k AS INT) AS row, CAST(col//k AS INT) AS col, round(avg(value)+{TIE:.10f},6) AS value FROM pixels, (VALUES ('display',8),('detection',2)) v(l,k) GROUP BY raster_id, l, band, row//k, col//k", "pixels")
def _(t):
    return reads.dual(t.pixels, t.rasters, 256, 1024).withColumn("value", F.round(F.col("value") + TIE, 6))


@query("s5_single_band", f"SELECT raster_id, band, CAST(row//2 AS INT) AS row, CAST(col//2 AS INT) AS col, round(avg(value)+{TIE:.10f},6) AS value FROM pixels WHERE band=2 GROUP BY raster_id, band, row//2, col//2", "pixels")
def _(t):
    df = reads.single_band(t.pixels, t.rasters, 2, 1024).unionByName(reads.single_band(t.pixels, t.rasters, 9, 1024))
    return df.withColumn("value", F.round(F.col("value") + TIE, 6))


@query("t6_tile_cells", "SELECT raster_id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, CAST(tx*512 AS INT) AS x, CAST(ty*512 AS INT) AS y, CAST(least(512,width-tx*512) AS INT) AS w, CAST(least(512,height-ty*512) AS INT) AS h FROM scenes, range(9) a(tx), range(8) b(ty) WHERE width>tx*512 AND height>ty*512", "scenes")
def _(t):
    df = t.scenes.withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(7))))
    df = df.withColumn("c", reads.tile_cell(F.col("tx"), F.col("ty"), F.col("width"), F.col("height"), 512)).where("c IS NOT NULL")
    return df.select("raster_id", "tx", "ty", "c.*")


@query("t8_visible_regions", "WITH v AS (SELECT det_id, least(greatest(CAST(trunc(x1-900.5) AS INT),0),1000) AS a, least(greatest(CAST(trunc(y1-1300.5) AS INT),0),500) AS b, CAST(trunc(x2-700.25) AS INT) AS c, CAST(trunc(y2-900.75) AS INT) AS d FROM detections), w AS (SELECT det_id, a, b, least(1000,greatest(c,a)) AS c, least(500,greatest(d,b)) AS d FROM v) SELECT det_id, CASE WHEN c<=a OR d<=b THEN 0 ELSE a END AS x, CASE WHEN c<=a OR d<=b THEN 0 ELSE b END AS y, CASE WHEN c<=a OR d<=b THEN 1000 ELSE c-a END AS w, CASE WHEN c<=a OR d<=b THEN 500 ELSE d-b END AS h FROM w", "detections")
def _(t):
    r = reads.visible_region(F.col("x1") - 900.5, F.col("y1") - 1300.5, F.col("x2") - 700.25, F.col("y2") - 900.75, F.lit(1000), F.lit(500))
    return t.detections.withColumn("r", r).select("det_id", "r.*")


@query("t9_work_areas", "SELECT polygon_id, CASE polygon_id%3 WHEN 0 THEN 5 WHEN 1 THEN NULL ELSE CASE WHEN polygon_id%2=1 THEN 3 ELSE 4 END END AS n FROM polygons", "polygons")
def _(t):
    mode = F.element_at(F.array(*map(F.lit, ["Visible part", "Entire image", "Polygons"])), (F.col("polygon_id") % 3 + 1).cast("int"))
    visible = reads.visible_region(F.col("px"), F.col("py"), F.col("px") + 10, F.col("py") + 10, F.lit(2048), F.lit(2048))
    rings = reads.area_rings(mode, visible, F.array("ring"))
    return t.polygons.withColumn("rings", rings).select("polygon_id", F.size(F.get("rings", F.lit(0))).alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("t11_estimates", "SELECT raster_id, o AS overlap, s AS stride, (width//s+1)*(height//s+1) AS tiles, round((width//s+1)*(height//s+1)*0.5/60,6) AS least_minutes, round((width//s+1)*(height//s+1)*2.0/60,6) AS most_minutes FROM (SELECT *, greatest(1,640-o) AS s FROM (SELECT *, CAST(CASE WHEN raster_id%2=0 THEN 640*(raster_id%50)//100 ELSE 64 END AS INT) AS o FROM scenes))", "scenes")
def _(t):
    percent = F.when(F.col("raster_id") % 2 == 0, F.col("raster_id") % 50)
    overlap, stride = reads.overlap_pixels(F.lit(640), percent, F.lit(64))
    df = t.scenes.withColumns({"overlap": overlap, "stride": stride})
    n, low, high = reads.estimate(F.col("width"), F.col("height"), F.col("stride"))
    return df.select("raster_id", "overlap", "stride", n.alias("tiles"), r6(low, "least_minutes"), r6(high, "most_minutes"))


@query("o3_prefetch", "SELECT raster_id, CAST(p AS INT) AS priority, CAST(width//2//512+i AS INT) AS tx, CAST(height//2//512+j AS INT) AS ty FROM scenes, (VALUES (0,0,0),(1,-1,0),(2,1,0),(3,0,-1),(4,0,1),(5,-1,-1),(6,1,-1),(7,-1,1),(8,1,1)) v(p,i,j) WHERE width//2//512+i>=0 AND height//2//512+j>=0 AND (width//2//512+i)*512<width AND (height//2//512+j)*512<height", "scenes")
def _(t):
    return reads.prefetch(t.scenes, 512)


@query("t12_padded", "SELECT vec_id, CAST(i AS INT) AS i, CASE WHEN i%8<5 AND i//8<4 THEN embedding[(i//8)*5+i%8+1]::DOUBLE ELSE 0 END AS value FROM embeddings, range(64) r(i)")
def _(t):
    payload = F.transform(F.slice("embedding", 1, 20), lambda v: v.cast("double"))
    return t.embeddings.select("vec_id", F.posexplode(reads.padded(payload, F.lit(5), F.lit(4), 8)).alias("i", "value"))


@query("t13_letterboxed", "SELECT vec_id, CAST(i AS INT) AS i, 1.0::DOUBLE AS scale, CAST(2 AS INT) AS \"left\", round(CASE WHEN i%12 BETWEEN 2 AND 9 THEN k*embedding[(i//12)*8+i%12-1] WHEN k*list_max(embedding)>1.5 THEN 114 ELSE 114/255.0 END,4)::DOUBLE+0.0 AS value FROM (SELECT *, CASE WHEN vec_id%2=0 THEN 10 ELSE 1 END AS k FROM embeddings), range(96) r(i)")
def _(t):
    tiles = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * F.when(F.col("vec_id") % 2 == 0, 10).otherwise(1)).cast("array<float>").alias("payload"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    df = pixels.letterboxed(tiles, 8, 12).select("vec_id", "scale", "left", F.posexplode("payload").alias("i", "value"))
    return df.select("vec_id", "i", "scale", "left", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"))


@query("t13_resized", """WITH p AS (SELECT vec_id, px, h, w, nh, nw, top, lft FROM (SELECT vec_id, [(v::DOUBLE*CASE WHEN vec_id%2=0 THEN 10 ELSE 1 END)::FLOAT::DOUBLE for v in embedding] AS px, vec_id%3 AS s FROM embeddings) e JOIN (VALUES (0,8,8,10,10,1,0),(1,4,16,2,10,5,0),(2,16,4,12,3,0,3)) t(s,h,w,nh,nw,top,lft) USING (s)),
    c AS (SELECT *, CAST(i AS INT) AS i, greatest(0,least(h-1,(i//10-top+0.5::DOUBLE)*h/nh-0.5)) AS sy, greatest(0,least(w-1,(i%10-lft+0.5::DOUBLE)*w/nw-0.5)) AS sx, i//10>=top AND i//10<top+nh AND i%10>=lft AND i%10<lft+nw AS inside FROM p, range(120) r(i)),
    k AS (SELECT *, CAST(floor(sy) AS INT) AS y0, least(CAST(floor(sy) AS INT)+1,h-1) AS y1, CAST(floor(sx) AS INT) AS x0, least(CAST(floor(sx) AS INT)+1,w-1) AS x1 FROM c),
    b AS (SELECT *, CASE WHEN inside THEN (px[y0*w+x0+1]*(1-(sy-y0))+px[y1*w+x0+1]*(sy-y0))*(1-(sx-x0))+(px[y0*w+x1+1]*(1-(sy-y0))+px[y1*w+x1+1]*(sy-y0))*(sx-x0) END AS v FROM k)
    SELECT vec_id, i, least(12.0::DOUBLE/h,10.0::DOUBLE/w) AS scale, CAST(lft AS INT) AS "left", CAST(top AS INT) AS "top", round(CASE WHEN inside THEN v::FLOAT WHEN max(v) OVER (PARTITION BY vec_id)>1.5 THEN 114::FLOAT ELSE (114/255.0::DOUBLE)::FLOAT END::DOUBLE,4)+0.0 AS value FROM b""")
def _(t):
    """Square tiles that grow, landscape and portrait ones that shrink, in one frame of 12 rows of 10."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("vec_id") % 3 + 1).cast("int"))
    payload = F.transform("embedding", lambda v: v.cast("double") * F.when(F.col("vec_id") % 2 == 0, 10).otherwise(1)).cast("array<float>")
    tiles = t.embeddings.select("vec_id", payload.alias("payload"), pick(8, 4, 16).alias("h"), pick(8, 16, 4).alias("w"))
    df = pixels.letterboxed(tiles, 12, 10).select("vec_id", "scale", "left", "top", F.posexplode("payload").alias("i", "value"))
    return df.select("vec_id", "i", "scale", "left", "top", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"))


@query("p14_scene_stretch", "SELECT raster_id, dtype LIKE 'float%' AS needs_stretch FROM scenes", "scenes")
def _(t):
    top = t.scenes.select("raster_id", F.lit(1).alias("band"), F.lit(200.0).alias("value"))
    return pixels.needs_stretch(top, t.scenes)


@query("p20_scene_sizes", "SELECT raster_id, CAST(CASE WHEN mb<=20 THEN greatest(width,height) ELSE floor(greatest(width,height)*sqrt(20/mb)) END AS BIGINT) AS side, round(least(1.0,512.0/greatest(width,height)),6)::DOUBLE AS scale FROM (SELECT *, width::DOUBLE*height*bands*CASE WHEN dtype='uint16' THEN 2 WHEN dtype LIKE 'float%' THEN 4 ELSE 1 END/1048576 AS mb FROM scenes)", "scenes")
def _(t):
    w, h = F.col("width"), F.col("height")
    return t.scenes.select("raster_id", pixels.optimal_dimension(w, h, F.col("bands"), F.col("dtype"), 20.0).alias("side"), r6(pixels.optimal_scale(w, h, 512), "scale"))


# --- display -----------------------------------------------------------------------------------------------------

@query("p6_overview", "WITH s AS (SELECT band, quantile_cont(value,0.02) FILTER (value<>0) AS lo, quantile_cont(value,0.98) FILTER (value<>0) AS hi FROM pixels GROUP BY 1) SELECT raster_id, band, row, col, CAST(CASE WHEN band=4 THEN CASE WHEN value<>0 THEN 0 ELSE 0 END ELSE floor((greatest(lo,least(hi,value))-lo)/(hi-lo)*255) END AS INT) AS value FROM pixels JOIN s USING (band)", "pixels")
def _(t):
    """Band 4 is flat: one value everywhere, so its width is 1e-5 and its bytes are 0."""
    flat = t.pixels.withColumn("value", F.when(F.col("band") == 4, 7.0).otherwise(F.col("value")))
    return pixels.overview(flat)


@query("p7_preview", "WITH s AS (SELECT band, quantile_cont(value,0.02) FILTER (value>0) AS lo, quantile_cont(value,0.98) FILTER (value>0) AS hi FROM pixels GROUP BY 1) SELECT raster_id, band, row, col, CAST(CASE WHEN band=4 THEN 0 ELSE floor((greatest(lo,least(hi,value))-lo)/(hi-lo)*255) END AS INT) AS value FROM pixels JOIN s USING (band)", "pixels")
def _(t):
    """Band 4 has nothing above 0."""
    return pixels.preview(t.pixels.withColumn("value", F.when(F.col("band") == 4, -F.abs("value")).otherwise(F.col("value"))))


@query("p9_grayscale", f"SELECT raster_id, row, col, round(avg(value)+{TIE:.10f},6) AS value FROM pixels WHERE band<=2 GROUP BY 1,2,3 UNION ALL SELECT 1, row, col, round(value+{TIE:.10f},6) FROM pixels WHERE band=1", "pixels")
def _(t):
    two = t.pixels.where("band <= 2")
    both = two.unionByName(t.pixels.withColumn("raster_id", F.lit(1)))
    sizes = t.spark.createDataFrame([(0, 2), (1, 4)], "raster_id int, bands int")
    return pixels.grayscale(both, sizes).withColumn("value", F.round(F.col("value") + TIE, 6))


# --- saved detections, metrics -------------------------------------------------------------------------------------

_SAVED = "saved AS (SELECT d.*, rs.a, rs.c, rs.e, rs.f, det_id AS row_no, CASE WHEN det_id%5=0 THEN '' ELSE 'c'||class_id END AS kelas FROM detections d JOIN rasters rs USING (raster_id))"
_LABELLED = "CASE WHEN kelas='' THEN 'sawit' ELSE kelas END AS label"
_CLASSED = "classed AS (SELECT raster_id, label, CAST(row_number() OVER (PARTITION BY raster_id ORDER BY seen)-1 AS INT) AS class_id FROM (SELECT raster_id, label, min(row_no) AS seen FROM l GROUP BY 1,2))"


def _saved(t):
    """Saved rows whose fields are stale; some rings are missing, of one point, or beyond the raster."""
    df = t.detections.join(t.rasters.select("raster_id", *"abcdef"), "raster_id").withColumn("row_no", F.col("det_id"))
    from tessera.functions import box as B

    ring = G.ring_to_crs(B.ring(B.cols()), G.transform_cols())
    point = F.slice(ring, 1, 1)
    beyond = F.transform(B.ring(B.cols()), lambda p: G.point(p["x"] + 1e7, p["y"] - 1e7))
    ring = F.when(F.col("det_id") % 7 == 0, None).when(F.col("det_id") % 11 == 0, point).when(F.col("det_id") % 13 == 0, beyond).otherwise(ring)
    kelas = F.when(F.col("det_id") % 5 == 0, "").otherwise(F.concat(F.lit("c"), F.col("class_id")))
    return df.select("raster_id", "row_no", ring.alias("ring"), F.lit(9999.0).alias("x1_px"), F.lit(9999.0).alias("y1_px"), F.lit(10000.0).alias("x2_px"), F.lit(9999.0).alias("y2_px"), F.col("score").alias("confidence"), kelas.alias("kelas"))


@query("s13_saved_fields", f"WITH {_SAVED}, l AS (SELECT *, {_LABELLED} FROM saved), {_CLASSED} SELECT raster_id, row_no, 9999.0::DOUBLE AS x1, 10000.0::DOUBLE AS x2, round(score,6) AS score, label, classed.class_id FROM l JOIN classed USING (raster_id, label)", "detections rasters")
def _(t):
    return saved.from_fields(_saved(t)).select("raster_id", "row_no", "x1", "x2", r6(F.col("score"), "score"), "label", "class_id")


@query("s14_saved_geometry", f"WITH {_SAVED}, l AS (SELECT *, {_LABELLED} FROM saved), {_CLASSED}, b AS (SELECT raster_id, row_no, label, round(score,6) AS score, CASE WHEN det_id%7=0 THEN 9999 WHEN det_id%11=0 THEN x1 WHEN det_id%13=0 THEN x1+1e7 ELSE x1 END AS x1, CASE WHEN det_id%7=0 THEN 9999 WHEN det_id%11=0 THEN y1 WHEN det_id%13=0 THEN y1-1e7 ELSE y1 END AS y1, CASE WHEN det_id%7=0 THEN 10000 WHEN det_id%11=0 THEN x1+1 WHEN det_id%13=0 THEN x2+1e7 ELSE x2 END AS x2, CASE WHEN det_id%7=0 THEN 10000 WHEN det_id%11=0 THEN y1+1 WHEN det_id%13=0 THEN y2-1e7 ELSE y2 END AS y2 FROM l) SELECT raster_id, row_no, round(x1,2)::DOUBLE AS x1, round(y1,2)::DOUBLE AS y1, round(x2,2)::DOUBLE AS x2, round(y2,2)::DOUBLE AS y2, score, label, class_id FROM b JOIN classed USING (raster_id, label)", "detections rasters")
def _(t):
    # Half a pixel is kept clear of the border, where the way through the CRS could put a vertex on either side.
    df = saved.from_geometry(_saved(t), t.rasters)
    return df.select("raster_id", "row_no", *[F.round(c, 2).alias(c) for c in saved.SIDES], r6(F.col("score"), "score"), "label", "class_id")


#: Inverse UTM by Snyder's series, apart from the library's own.
_SNYDER = """u AS (SELECT *, 0.0066943799901413165::DOUBLE AS e2, 6378137.0::DOUBLE AS ea FROM src), v AS (SELECT *, e2/(1-e2) AS ep, (1-sqrt(1-e2))/(1+sqrt(1-e2)) AS e1, gy/0.9996/(ea*(1-e2/4-3*e2*e2/64-5*e2*e2*e2/256)) AS mu FROM u),
    w AS (SELECT *, mu+(3*e1/2-27*e1**3/32)*sin(2*mu)+(21*e1**2/16-55*e1**4/32)*sin(4*mu)+151*e1**3/96*sin(6*mu)+1097*e1**4/512*sin(8*mu) AS p FROM v),
    x AS (SELECT *, ep*cos(p)**2 AS cc, tan(p)**2 AS tt, ea/sqrt(1-e2*sin(p)**2) AS nn, ea*(1-e2)/(1-e2*sin(p)**2)**1.5 AS rr FROM w), y AS (SELECT *, (gx-500000)/(nn*0.9996) AS d FROM x),
    ll AS (SELECT *, CASE WHEN epsg=4326 THEN gy WHEN epsg IS NULL THEN 0 ELSE degrees(p-nn*tan(p)/rr*(d**2/2-(5+3*tt+10*cc-4*cc**2-9*ep)*d**4/24)) END AS lat, CASE WHEN epsg=4326 THEN gx WHEN epsg IS NULL THEN 0 ELSE 105+degrees((d-(1+2*tt+cc)*d**3/6)/cos(p)) END AS lon FROM y)"""


@query("k3_centroid_metrics", f"WITH src AS (SELECT det_id, epsg, c+(x1+x2)/2*a AS gx, f+(y1+y2)/2*e AS gy, least(x2-x1,y2-y1)/2*(abs(a)+abs(e))/2 AS r FROM detections JOIN rasters USING (raster_id)), {_SNYDER} SELECT det_id, round(round_even(lat,8)+{TIE:.10f},5) AS lat, round(round_even(lon,8)+{TIE:.10f},5) AS lon, round_even(r,6) AS radius_m, round_even(2*r,6) AS diameter_m, round(pi()*r*r,5) AS area_m2 FROM ll", "detections rasters")
def _(t):
    df = saved.centroid_metrics(t.detections, t.rasters)
    return df.select("det_id", F.round(F.col("Latitude") + TIE, 5).alias("lat"), F.round(F.col("Longitude") + TIE, 5).alias("lon"), F.bround("radius_m", 6).alias("radius_m"), F.bround("diameter_m", 6).alias("diameter_m"), F.round("area_m2", 5).alias("area_m2"))


@query("k6_centroid_points", "SELECT raster_id, det_id AS id, round(c+(x1+x2)/2*a,6) AS lon, round_even(coalesce(r,0),2) AS radius_m, round_even(coalesce(2*r,0),2) AS diameter_m, coalesce(epsg,4326) AS epsg FROM (SELECT *, CASE WHEN det_id%4<>0 THEN least(x2-x1,y2-y1)/2 END AS r FROM detections) JOIN rasters USING (raster_id)", "detections rasters")
def _(t):
    df = t.detections.join(t.rasters, "raster_id")
    gx, gy = G.to_crs((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, G.transform_cols())
    r = F.when(F.col("det_id") % 4 != 0, F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 2)
    points = saved.centroid_points(df.select("raster_id", F.col("det_id").alias("id"), gx.alias("geo_x"), gy.alias("geo_y"), r.alias("radius_m"), "epsg"))
    return points.select("raster_id", "id", r6(F.col("lon"), "lon"), "radius_m", "diameter_m", "epsg")


@query("k7_canopy_circles", "SELECT det_id AS id, 65 AS n, round(x1+least(x2-x1,y2-y1)/2,6) AS max_x FROM detections WHERE det_id%4<>0", "detections")
def _(t):
    r = F.when(F.col("det_id") % 4 != 0, F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 2)
    rings = saved.canopy_circles(t.detections.select("raster_id", F.col("det_id").alias("id"), F.col("x1").alias("geo_x"), F.col("y1").alias("geo_y"), r.alias("radius_m")))
    return rings.select("id", F.size("ring").alias("n"), r6(F.array_max(F.transform("ring", lambda p: p["x"])), "max_x"))


_Q = "(1-0.0066943799901413165::DOUBLE)/2*(sin(radians({v}))/(1-0.0066943799901413165::DOUBLE*sin(radians({v}))**2)+atanh(0.08181919084262149::DOUBLE*sin(radians({v})))/0.08181919084262149::DOUBLE)"
_CEA = f"6378137.0::DOUBLE*6378137.0::DOUBLE*radians(side*a)*({_Q.format(v='lat1')}-{_Q.format(v='lat2')})/CASE WHEN polygon_id%2=1 THEN 2 ELSE 1 END"


@query("g8_geodesic_areas", f"SELECT polygon_id, round({_CEA},3) AS area FROM (SELECT *, f+py*e AS lat1, f+(py+side)*e AS lat2 FROM polygons JOIN rasters USING (raster_id) WHERE epsg=4326)", "polygons rasters")
def _(t):
    df = t.polygons.join(t.rasters.where("epsg = 4326"), "raster_id")
    return df.select("polygon_id", F.round(G.geodesic_area(G.ring_to_crs(F.col("ring"), G.transform_cols())), 3).alias("area"))


@query("g9_local_utm_areas", f"SELECT polygon_id, round(CASE WHEN epsg=4326 THEN 0.9996::DOUBLE*0.9996::DOUBLE*{_CEA} ELSE side*side*a*a/CASE WHEN polygon_id%2=1 THEN 2 ELSE 1 END END,0) AS area FROM (SELECT *, f+py*e AS lat1, f+(py+side)*e AS lat2 FROM polygons JOIN rasters USING (raster_id))", "polygons rasters")
def _(t):
    df = t.polygons.join(t.rasters, "raster_id")
    return df.select("polygon_id", F.round(G.area_m2(G.ring_to_crs(F.col("ring"), G.transform_cols()), F.col("epsg")), 0).alias("area"))


@query("g15_simple_rings", "SELECT polygon_id, polygon_id%2=1 OR polygon_id%10 IN (0,8) AS simple FROM polygons", "polygons")
def _(t):
    """Of the rectangles, some are twisted into a bow tie (2), get a spike (4) or an edge laid over another (6). Repeated vertices (8) mean nothing."""
    p = lambda i: F.get("ring", F.lit(i))
    half = lambda i, j, k=0.5: F.struct((p(i)["x"] * (1 - k) + p(j)["x"] * k).alias("x"), (p(i)["y"] * (1 - k) + p(j)["y"] * k).alias("y"))
    kinds = {
        2: [p(0), p(2), p(1), p(3)], 4: [p(0), p(1), half(1, 2, 2.0), p(2), p(3)], 6: [p(0), p(1), p(2), half(0, 2), half(0, 1), half(0, 1, 0.25), p(3)],
        8: [p(0), p(0), p(1), p(2), p(2), p(3), p(0)],
    }
    ring = F.col("ring")
    for kind, points in kinds.items():
        ring = F.when((F.col("polygon_id") % 2 == 0) & (F.col("polygon_id") % 10 == kind), F.array(*points)).otherwise(ring)
    return t.polygons.select("polygon_id", G.simple(ring).alias("simple"))


@query("g23_label_positions", "SELECT polygon_id, round(px+side/CASE WHEN polygon_id%2=1 THEN 3 ELSE 2 END,6) AS x, round(py+side/CASE WHEN polygon_id%2=1 THEN 3 ELSE 2 END,6) AS y FROM polygons", "polygons")
def _(t):
    x, y = G.label_position(F.col("ring"))
    return t.polygons.select("polygon_id", r6(x, "x"), r6(y, "y"))


@query("k13_zonal_table", "WITH z AS (SELECT raster_id, det_id, x1%100 AS zx, floor(y1/4) AS zy FROM detections) SELECT z.raster_id, det_id AS \"ID\", zx+3 AS \"Easting\", zy+3 AS \"Northing\", " + ", ".join(f"round(avg(value) FILTER (value<>-9999 AND band={b}),6) AS \"Band_{b}_mean\"" for b in (1, 2, 3, 4)) + " FROM z LEFT JOIN pixels p ON p.raster_id=z.raster_id AND col<zx+6 AND col+1>zx AND row<zy+6 AND row+1>zy GROUP BY 1,2,3,4", "detections pixels")
def _(t):
    z = t.detections.selectExpr("raster_id", "det_id AS zone_id", "x1 % 100 AS x1", "CAST(floor(y1/4) AS DOUBLE) AS y1").selectExpr("*", "x1 + 6 AS x2", "y1 + 6 AS y2", "x1 + 3 AS easting", "y1 + 3 AS northing")
    df = saved.zonal_table(pixels.zonal_means(z.drop("easting", "northing"), t.pixels), z, [1, 2, 3, 4])
    return df.select("raster_id", "ID", "Easting", "Northing", *[F.round(f"Band_{b}_mean", 6).alias(f"Band_{b}_mean") for b in (1, 2, 3, 4)])


@query("a8_centre_values", "SELECT d.det_id, band, value FROM detections d LEFT JOIN pixels p ON p.raster_id=d.raster_id AND p.col=round_even((x1+x2)/16,0) AND p.row=round_even((y1+y2)/16,0)", "detections pixels")
def _(t):
    small = t.detections.withColumns({c: F.col(c) / 8 for c in saved.SIDES})
    return saved.centre_values(small, t.pixels).select("det_id", "band", "value")


# --- texts, checks, sets -------------------------------------------------------------------------------------------

@query("z2_display_texts", "SELECT det_id, 'Avg '||printf('R: %.2fm', r)||printf(' | D: %.2fm', r*2) AS canopy, CASE WHEN class_id=0 THEN 'Lon: - | Lat: -' WHEN class_id=1 THEN printf('Lon: %.6f | Lat: %.6f', x1, y1) ELSE printf('X: %.2f | Y: %.2f', x1, y1) END AS place, printf('Elapsed: %02d:%02d | ETA: ', CAST(floor(x1/60) AS INT), CAST(x1%60 AS INT)) || CASE WHEN det_id%10=0 THEN '--:--' ELSE printf('%02d:%02d', CAST(l//60 AS INT), CAST(l%60 AS INT)) END AS eta FROM (SELECT *, least(x2-x1,y2-y1)/2 AS r, CASE WHEN det_id%10<>0 THEN CAST(trunc(greatest(0,x1/(det_id%10)*100-x1)) AS INT) END AS l FROM detections)", "detections")
def _(t):
    r = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 2
    known = F.when(F.col("class_id") != 0, F.col("x1"))
    percent = F.col("det_id") % 10
    return t.detections.select("det_id", T.canopy_text(r, "both", "Avg ").alias("canopy"), T.place_text(known, F.col("y1"), F.col("class_id") == 1).alias("place"), T.eta_text(F.col("x1"), F.when(percent > 0, percent)).alias("eta"))


@query("f6_overlay_boxes", "SELECT det_id, greatest(0,x1) AS x1, greatest(0,y1) AS y1, least(1500,x2) AS x2, least(1000,y2) AS y2 FROM (SELECT det_id, x1-100 AS x1, y1-100 AS y1, x2-100 AS x2, y2-100 AS y2 FROM detections WHERE class_id<2) WHERE x2>0 AND y2>0 AND x1<1500 AND y1<1000", "detections")
def _(t):
    """Boxes of class 2 are not finite."""
    moved = t.detections.withColumns({c: F.when(F.col("class_id") == 2, float("nan")).otherwise(F.col(c) - 100) for c in saved.SIDES})
    return checks.overlay_boxes(moved, F.lit(1500.0), F.lit(1000.0)).select("det_id", *saved.SIDES)


@query("f11_usable_polygons", "SELECT polygon_id FROM polygons WHERE polygon_id%5<>0 AND px<1200 AND py<900", "polygons")
def _(t):
    """Every fifth ring has an infinite vertex; rasters are smaller than where some polygons begin."""
    bad = F.when(F.col("polygon_id") % 5 == 0, F.transform("ring", lambda p: G.point(p["x"] / F.lit(0.0001) * float("inf"), p["y"]))).otherwise(F.col("ring"))
    small = t.rasters.withColumns({"width": F.lit(1200), "height": F.lit(900)}).unionByName(t.rasters.where("false"))
    rasters = small.select("raster_id", "width", "height")
    known = t.polygons.select("raster_id").distinct().join(rasters, "raster_id", "left").select("raster_id", F.lit(1200).alias("width"), F.lit(900).alias("height"))
    return checks.usable_polygons(t.polygons.withColumn("ring", bad), known).select("polygon_id")


@query("u_selections", "SELECT polygon_id, 'chosen' AS what FROM polygons WHERE polygon_id%3=0 UNION ALL SELECT polygon_id, 'rest' FROM polygons WHERE polygon_id%3<>0 UNION ALL SELECT polygon_id, 'not last' FROM polygons WHERE polygon_id<(SELECT max(polygon_id) FROM polygons) UNION ALL SELECT polygon_id, 'pending' FROM polygons WHERE polygon_id%3<>0 AND polygon_id%2<>0 UNION ALL SELECT polygon_id, 'both sources' FROM polygons WHERE role='aoi' UNION ALL SELECT polygon_id, 'both sources' FROM polygons WHERE role='aoi'", "polygons")
def _(t):
    p = t.polygons.select("polygon_id", "ring", "role")
    chosen, even = p.where("polygon_id % 3 = 0"), p.where("polygon_id % 2 = 0")
    aoi = p.where("role = 'aoi'")
    parts = {"chosen": checks.selected(p, chosen), "rest": checks.without(p, chosen, "polygon_id"), "not last": checks.without_last(p, "polygon_id", "polygon_id"), "pending": checks.pending(p, chosen, even, ["polygon_id"]), "both sources": aoi.unionByName(aoi)}
    out = [df.select("polygon_id", F.lit(k).alias("what")) for k, df in parts.items()]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


@query("u4_tiles_to_drop", "SELECT det_id, tx, ty FROM detections d, range(4) a(tx), range(4) b(ty) WHERE tx BETWEEN floor(x1/512) AND ceil((x2+500)/512)-1 AND ty BETWEEN floor(y1/512) AND ceil((y2+300)/512)-1 AND NOT (tx BETWEEN floor((x1+400)/512) AND ceil((x2+900)/512)-1 AND ty BETWEEN floor(y1/512) AND ceil((y2+300)/512)-1)", "detections")
def _(t):
    from tessera.operators import grid

    now = t.detections.selectExpr("det_id", "x1", "y1", "x2 + 500 AS x2", "y2 + 300 AS y2", "2048 AS width", "2048 AS height")
    then = now.withColumns({"x1": F.col("x1") + 400, "x2": F.col("x2") + 400})
    tiles = lambda v: grid.viewport_tiles(v).selectExpr("det_id", "CAST(tx AS BIGINT) AS tx", "CAST(ty AS BIGINT) AS ty")
    return tiles(now).exceptAll(tiles(then))


@query("o6_largest_parts", "SELECT polygon_id%10 AS feature, arg_max(polygon_id, k) AS part FROM (SELECT *, CASE WHEN polygon_id%2=1 THEN side*side/2 ELSE side*side END*1000000-polygon_id AS k FROM polygons) GROUP BY 1", "polygons")
def _(t):
    df = t.polygons.select((F.col("polygon_id") % 10).alias("feature"), F.col("polygon_id").alias("part"), "ring")
    return checks.largest_parts(df, ["feature"], F.abs(G.signed_area(F.col("ring")))).select("feature", "part")


@query("j8_nearest", "SELECT det_id AS click_id, arg_min(polygon_id, d*1000000+polygon_id) AS idx, round(min(d),6) AS distance FROM (SELECT det_id, polygon_id, sqrt((px-x1)*(px-x1)+(py-y1)*(py-y1)) AS d FROM detections JOIN polygons USING (raster_id)) WHERE d<=60 GROUP BY 1", "detections polygons")
def _(t):
    clicks = t.detections.select("raster_id", F.col("det_id").alias("click_id"), F.col("x1").alias("cx"), F.col("y1").alias("cy"))
    points = t.polygons.select("raster_id", F.col("polygon_id").alias("idx"), F.col("px").alias("x"), F.col("py").alias("y"))
    return spatial.nearest(clicks, points, 60.0).select("click_id", "idx", r6(F.col("distance"), "distance"))


# --- registry ------------------------------------------------------------------------------------------------------

@query("x10_registered_runs", "SELECT run_id, model_name FROM (SELECT p_partkey AS run_id, p_name AS model_name, p_size FROM part) WHERE model_name IN (SELECT p_name FROM part WHERE p_size>25)")
def _(t):
    runs = t.part.select(F.col("p_partkey").alias("run_id"), F.col("p_name").alias("model_name"))
    return saved.registered(runs, t.models.where("channels > 25")).select("run_id", "model_name")


@query("s16_model_list", "SELECT DISTINCT model_name, arg_max(description, created_at) OVER (PARTITION BY model_name) AS description FROM models WHERE model_name NOT IN (SELECT model_name FROM models WHERE channels%7=0)", "models")
def _(t):
    kept = saved.without_models(corrections.upserted(t.models), t.models.where("channels % 7 = 0").distinct())
    return saved.model_list(kept)


@query("k14_run_log", "SELECT CAST(CASE WHEN year(day)<1995 THEN row_number() OVER (ORDER BY year(day)>=1995, day) ELSE row_number() OVER (ORDER BY year(day)>=1995, day) END AS BIGINT) AS run_id, day AS created_at, n_tiles FROM runs", "runs")
def _(t):
    rows = t.runs.select(F.col("day").alias("created_at"), "n_tiles")
    none = rows.where("false").select(F.lit(0).cast("long").alias("run_id"), "created_at", "n_tiles")
    log = saved.appended_runs(none, rows.where("year(created_at) < 1995"))
    return saved.appended_runs(log, rows.where("year(created_at) >= 1995"))


@query("k17_log_rows", "SELECT '{\"event_id\":'||event_id||',\"event_type\":\"'||event_type||'\",\"user_id\":'||user_id||'}' AS value FROM events")
def _(t):
    return saved.log_rows(t.events.select("event_id", "event_type", "user_id"))


@query("k2_corrected_export", "WITH last AS (SELECT det_id, arg_max(action, event_id) AS action FROM corrections WHERE action IN ('edit','delete') GROUP BY 1) SELECT d.det_id, CASE WHEN action='edit' THEN 'edited' ELSE 'not_corrected' END AS status, 'A. Reviewer' AS reviewer, DATE '2024-05-01' AS corrected_on FROM detections d LEFT JOIN last USING (det_id) WHERE action IS DISTINCT FROM 'delete' AND score>=0.25", "detections corrections")
def _(t):
    """Edits and deletions only, so nothing is undone."""
    events = t.corrections.where("action IN ('edit', 'delete')")
    known = events.join(t.detections.select("det_id"), "det_id", "left_semi")
    out = corrections.corrected_export(corrections.current_state(t.detections, known), known, 0.25, "A. Reviewer", "2024-05-01")
    return out.select("det_id", "status", "reviewer", "corrected_on")


@query("st1_owned_stream", "SELECT det_id, tile_id FROM (SELECT d.det_id, CAST(CAST(floor(x/512) AS INT)+4*CAST(floor(y/512) AS INT)+1 AS INT) AS tile_id FROM (SELECT det_id, (x1+x2)/2 AS x, (y1+y2)/2 AS y FROM detections) d WHERE x<2048 AND y<2048)", "detections")
def _(t):
    """Boxes as they come, against tiles without overlap."""
    from tessera.operators import grid
    from tessera.plans.fixtures import SQL
    from tessera.streaming import streams

    tiles = grid.windows(t.rasters, 512, 0)
    cores = grid.core_bounds(tiles, t.rasters, 0)
    orders = streams.files_stream(t.spark, f"{t.sf_dir}/orders.parquet", t.orders.schema)
    boxes = t.spark.sql(SQL["detections"], orders=orders)
    tile = (F.floor((F.col("x1") + F.col("x2")) / 1024) + 4 * F.floor((F.col("y1") + F.col("y2")) / 1024) + 1).cast("int")
    return streams.run_to_table(streams.owned_stream(boxes.withColumn("tile_id", tile), cores), "owned").select("det_id", "tile_id")


@query("st4_above_threshold", "SELECT event_id, event_type FROM events JOIN (SELECT event_type, avg(value) AS threshold FROM events GROUP BY 1) USING (event_type) WHERE value>=threshold")
def _(t):
    from tessera.streaming import streams

    limits = t.events.groupBy("event_type").agg(F.avg("value").alias("threshold"))
    live = streams.files_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema)
    return streams.run_to_table(streams.above_threshold(live, limits), "above").select("event_id", "event_type")


@query("k5_metric_features", f"SELECT det_id, CASE class_id WHEN 0 THEN 'palm' WHEN 1 THEN 'tree' ELSE CAST(class_id AS VARCHAR) END AS name, round_even(least(x2-x1,y2-y1)/2*(abs(a)+abs(e))/2,4) AS radius_m FROM detections JOIN rasters USING (raster_id)", "detections rasters")
def _(t):
    from tessera.functions import box as B

    m = saved.centroid_metrics(t.detections, t.rasters, 8, 4)
    return m.join(t.detections.select("det_id", "class_id"), "det_id").select("det_id", B.class_name(F.col("class_id"), names()).alias("name"), "radius_m")
