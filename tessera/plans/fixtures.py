"""Raster tables derived from the given ones, by the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "rasters": """select raster_id, 2048 as width, 2048 as height, 4 as bands, 'float32' as dtype,
      case raster_id % 3 when 0 then 32648 when 1 then 4326 end as epsg,
      case when raster_id % 3 = 1 then cast(0.000001 as double) else cast(0.1 as double) end as a, cast(0 as double) as b,
      case when raster_id % 3 = 1 then cast(105 as double) else cast(500000 + raster_id*1000 as double) end as c, cast(0 as double) as d,
      case when raster_id % 3 = 1 then cast(-0.000001 as double) else cast(-0.1 as double) end as e,
      case when raster_id % 3 = 1 then cast(1 as double) else cast(100000 as double) end as f, cast(-9999 as double) as nodata
      from (select distinct cast(floor(o_orderkey/3750) as int) as raster_id from {orders}) t""",
    "detections": """select o_orderkey as det_id, cast(floor(o_orderkey/3750) as int) as raster_id, cast(o_orderkey % 3 as int) as class_id,
      cast((o_orderkey*7919) % 1951 as double) as x1, cast((o_orderkey*104729+o_custkey*31) % 1949 as double) as y1,
      cast((o_orderkey*7919) % 1951 + 20 + (o_orderkey % 23)*2 as double) as x2,
      cast((o_orderkey*104729+o_custkey*31) % 1949 + 20 + (o_orderkey % 19)*2 as double) as y2,
      cast(cast(floor(o_totalprice*100) as bigint) % 9973 as double)/9973 as score from {orders}""",
    "pixels": """select 0 as raster_id, n_nationkey + 1 as band, cast(floor(event_id/100) as int) as row, cast(event_id % 100 as int) as col,
      case when event_id % 17 = 0 then cast(-9999 as double) when event_id % 29 = 0 then cast(0 as double) else value*(n_nationkey+1) end as value
      from {events}, {nation} where n_nationkey < 4""",
    "polygons": """select cast(floor(s_suppkey/5) as int) as raster_id, s_suppkey as polygon_id,
      case when s_suppkey % 5 < 4 then 'aoi' else 'exclude' end as role,
      cast((s_suppkey*397) % 1500 as double) as px, cast((s_suppkey*211) % 1500 as double) as py, cast(150 + (s_suppkey % 7)*40 as double) as side from {supplier}""",
    "local_polygons": """select 0 as raster_id, s_suppkey as polygon_id, case when s_suppkey % 5 < 4 then 'aoi' else 'exclude' end as role,
      cast((s_suppkey*397) % 80 as double) as px, cast(s_suppkey as double) as py, cast(15 + (s_suppkey % 7)*4 as double) as side from {supplier}""",
    "corrections": """select user_id as session_id, cast(row_number() over (partition by user_id order by event_id) as bigint) as seq,
      case event_id % 10 when 8 then 'undo' when 9 then 'redo' when 7 then 'add' when 6 then 'edit' when 5 then 'edit' else 'delete' end as action,
      cast(event_id % 15000 as bigint) as det_id, event_id from {events}""",
    "scenes": """select cast(p_partkey as int) as raster_id, cast(300 + (p_partkey*397) % 4000 as int) as width, cast(300 + (p_partkey*211) % 3500 as int) as height,
      cast(1 + p_partkey % 9 as int) as bands, case p_partkey % 4 when 0 then 'uint8' when 1 then 'uint16' when 2 then 'float32' else 'float64' end as dtype,
      case p_partkey % 4 when 0 then 32648 when 1 then 4326 when 3 then 32748 end as epsg,
      case when p_partkey % 4 = 1 then cast(0.00001 as double) else cast(0.5 as double) end as a, cast(0 as double) as b,
      case when p_partkey % 4 = 1 then cast(100 + p_partkey % 40 as double) else cast(400000 + p_partkey % 2000 * 100 as double) end as c, cast(0 as double) as d,
      case when p_partkey % 4 = 1 then cast(-0.00001 as double) else cast(-0.5 as double) end as e,
      case when p_partkey % 4 = 1 then cast(p_partkey % 81 - 40 as double) else cast(5000000 + p_partkey % 4000 * 10 as double) end as f from {part}""",
    "runs": """select cast(o_orderdate as date) as day, count(*) as n_tiles, sum(o_custkey) as n_detections from {orders} group by 1""",
    "models": """select p_name as model_name, p_type as description, p_partkey as created_at, p_size as channels from {part}""",
}
BASES = ["orders", "events", "nation", "supplier", "part"]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASES if "{" + t + "}" in SQL[name]}
    df = spark.sql(SQL[name], **tables)
    if name in ("polygons", "local_polygons"):  # rectangles, and triangles for odd ids
        p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
        a, b, c, d = p("px", "py"), p("px + side", "py"), p("px + side", "py + side"), p("px", "py + side")
        df = df.selectExpr("*", f"CASE WHEN polygon_id % 2 = 1 THEN array({a}, {b}, {d}) ELSE array({a}, {b}, {c}, {d}) END AS ring")
    return df


def ctes(*names: str) -> str:
    """DuckDB's WITH clause of fixtures; ``poly_edges`` gives polygons edge by edge."""
    parts = [f"{n} AS ({SQL[n].format(**{t: t for t in BASES})})" for n in names if n != "poly_edges"]
    if "poly_edges" in names:
        v = "unnest(CASE WHEN polygon_id % 2 = 1 THEN [[px,py,px+side,py],[px+side,py,px,py+side],[px,py+side,px,py]] ELSE [[px,py,px+side,py],[px+side,py,px+side,py+side],[px+side,py+side,px,py+side],[px,py+side,px,py]] END)"
        parts.append(f"poly_edges AS (SELECT raster_id, polygon_id, role, px, py, side, v[1] AS ax, v[2] AS ay, v[3] AS bx, v[4] AS by_ FROM (SELECT *, {v} AS v FROM polygons) t)")
    return ", ".join(parts)
