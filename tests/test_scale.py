"""What shows only beyond the smallest tables."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import text as T
from tessera.operators import checks, pixels, routing, spatial, storage
from tessera.plans import basics  # noqa: F401  (registers its queries)
from tessera.plans import reads  # noqa: F401
from tessera.plans.queries import QUERIES
from tessera.sources import vector


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_manual_mappings_are_not_broadcast(spark):
    rasters = spark.range(3).select(F.col("id").cast("int").alias("raster_id"), F.lit(2).alias("bands"))
    given = rasters.select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("slot"))
    band = F.when(F.col("slot") == 1, F.lit(0)).when(F.col("slot") != 3, F.col("slot") % 2 + 1).cast("int")
    df = routing.checked_mapping(given.withColumn("input_band", band), rasters, [0, 1, 2, 3, 5])
    assert "BroadcastHashJoin" not in plan(df)
    got = {r["slot"]: (r["input_band"], r["status"]) for r in df.where("raster_id = 1").collect()}
    assert got == {0: (1, "duplicate"), 1: (0, "out_of_range"), 2: (1, "duplicate"), 3: (None, "blank"), 5: (None, "blank")}


def test_labels_round_ties_as_printf_does(spark):
    df = spark.sql("SELECT * FROM VALUES (26250.0D, 0.125D), (26350.0D, 0.375D), (123456789.0D, 1234.5D) t(m2, r)")
    got = df.select(T.area_label(F.col("m2")).alias("a"), T.canopy_text(F.col("r"), "radius").alias("c")).collect()
    assert [r.a.split("\n")[1].split(" (")[0] for r in got] == [f"{m / 10_000:.2f} ha" for m in (26250.0, 26350.0, 123456789.0)]
    assert [r.c for r in got] == [f"R: {v:.2f}m" for v in (0.125, 0.375, 1234.5)]


def test_corner_rows_take_all_features(spark, tmp_path):
    spark.range(1010).selectExpr("id * 50 AS vec_id", "array(CAST(id AS float)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r["top"] for r in QUERIES["mo3_corner_rows"](spark, str(tmp_path)).collect()] == [1009.0]


def test_unknown_slots_are_not_broadcast(spark):
    slots = lambda n: spark.range(3).select(F.col("id").cast("int").alias("raster_id"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("slot"))
    df = checks.unknown_slots(slots(4), slots(3))
    assert "BroadcastHashJoin" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [(0, 4), (1, 4), (2, 4)]


def test_tile_percentiles_are_those_of_sql(spark):
    rng = np.random.default_rng(5)
    rows = [(0, 1, 32 * k + i // 32, i % 32, float(np.round(rng.uniform(0, 1000), 2)) * 3) for k in range(60) for i in range(int(rng.integers(2, 1024)))]
    rows += [(0, 2, i // 32, i % 32, v) for i, v in enumerate([0.5] * 9 + [1.56, 1.62] + [1000.0] * 920)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (raster_id INT, band INT, row INT, col INT, value DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    want = con.execute("SELECT band, CAST(floor(row/32) AS INT), quantile_cont(value, 0.01) FILTER (value>0), quantile_cont(value, 0.99) FILTER (value>0) FROM t GROUP BY 1, 2").fetchall()
    got = pixels.tile_percentiles(spark.createDataFrame(rows, "raster_id int, band int, row int, col int, value double"), least=0.0).select("band", "ty", "lo", "hi").collect()
    assert sorted(map(tuple, got)) == sorted(want)  # to the last bit


def test_work_that_takes_long_a_row_is_spread(spark, sf):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("g7_ellipsoid_distances", "r2_routed_slots", "s9_either_coordinates"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= n, name


def test_coordinates_there_and_back(spark):
    df = spark.sql("SELECT * FROM VALUES (500123.0D, 1000.0D, 32648), (700000.0D, 9000000.0D, 32748), (105.5D, -7.0D, 4326), (1e6D, 2e6D, 3857), (1.0D, 2.0D, NULL) t(x, y, epsg)")
    lon, lat = geo.to_lonlat(F.col("x"), F.col("y"), F.col("epsg"))
    rows = df.withColumns({"lon": lon, "lat": lat}).withColumns(dict(zip(("u", "v"), geo.from_lonlat(F.col("lon"), F.col("lat"), F.col("epsg"))))).collect()
    for r in rows[:-1]:
        assert abs(r.u - r.x) < 1e-5 and abs(r.v - r.y) < 1e-5, r
    assert rows[-1].lon is None and rows[-1].v is None
    # A ring is computed once: the text of the plan does not grow with uses of a vertex.
    ring = F.array(geo.point(F.col("x"), F.col("y")))
    assert len(plan(df.select(vector.lonlat_to_pixel(ring, tuple(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)), F.col("epsg"))))) < 12_000


def test_gray_pixels_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    rows = spark.range(2000).selectExpr("CAST(id div 5000 AS INT) AS raster_id", "CAST(1 + id % 2 AS INT) AS band", "CAST(id div 20 AS INT) AS row", "CAST(id % 20 div 2 AS INT) AS col", "CAST(id AS DOUBLE) AS value")
    df = pixels.grayscale(rows, spark.createDataFrame([(0, 2)], "raster_id int, bands int"))
    assert df.rdd.getNumPartitions() == 21
    assert df.where("row = 3 AND col = 4").first()["value"] == 68.5 and df.count() == 1000


def test_touched_pixels_are_those_of_the_rectangles(spark):
    """Bits of cells against each pixel's rectangle; no ring goes along with the pixels."""
    rng = np.random.default_rng(3)
    rings = [[(3.0, 3.0), (40.0, 3.0), (3.0, 40.0)], [(-5.5, 10.25), (70.5, 12.5), (31.0, 66.0)], [(10.0, 10.0), (10.0, 10.0), (10.0, 10.0)], [(5.0, 5.0), (60.0, 60.0), (60.0, 5.0), (5.0, 60.0)], [(0.2, 0.2), (0.4, 0.2), (0.3, 0.4)], [(32.0, 0.0), (64.0, 0.0), (64.0, 32.0), (32.0, 32.0)], [], None]
    angle = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    rings += [list(zip((35 + r * np.cos(angle)).tolist(), (33 + r * np.sin(angle)).tolist())) for r in [rng.uniform(5, 34, 300), np.full(300, 20.0)]]
    rings += [[tuple(map(float, v)) for v in rng.uniform(-10, 80, (5, 2))] for _ in range(6)] + [[tuple(map(float, v)) for v in rng.integers(0, 64, (4, 2))] for _ in range(6)]
    polygons = spark.createDataFrame([(0, i, r) for i, r in enumerate(rings)], "raster_id int, polygon_id long, ring array<struct<x: double, y: double>>")
    grid = spark.range(70 * 70).selectExpr("0 AS raster_id", "CAST(id div 70 AS INT) AS row", "CAST(id % 70 AS INT) AS col")
    bands = grid.selectExpr("*", "explode(array(1, 2)) AS band", "CAST(row * 70 + col AS DOUBLE) AS value")
    x1, y1, x2, y2 = F.col("col") + 1e-6, F.col("row") + 1e-6, F.col("col") + (1 - 1e-6), F.col("row") + (1 - 1e-6)
    touched = bands.join(polygons, "raster_id").where(spatial.rectangle_meets(F.col("ring"), x1, y1, x2, y2))
    want = touched.groupBy("raster_id", "polygon_id", "band").agg(F.avg(F.when(F.col("value") != 9.0, F.col("value"))).alias("mean"), F.count("*").alias("n"))
    got = pixels.mean_touched(bands, polygons, nodata=9.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "exists(" not in plan(got)
