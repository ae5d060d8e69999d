"""Deterministic scenes derived from the driver's tables; the SQL text runs alike in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "fx_segments2d": """select seg_id, x1, y1, x1+dx as x2, y1+dy as y2 from (
  select p_partkey as seg_id, cast((p_partkey*37)%200 - 100 as double)+cast(0.25 as double) as x1,
         cast((p_partkey*73)%190 - 95 as double)+cast(0.5 as double) as y1,
         cast(p_size%13 - 6 as double)+cast(0.125 as double) as dx,
         cast((p_partkey*11)%17 - 8 as double)+cast(0.375 as double) as dy from part) s""",
    "fx_origins2d": """select s_suppkey as origin_id, cast((s_suppkey*7)%41 - 20 as double)+cast(0.0625 as double) as ox,
       cast((s_suppkey*13)%37 - 18 as double)+cast(0.03125 as double) as oy from supplier where s_suppkey < 8""",
    "fx_points3d": """select event_id as point_id, cast((event_id*31)%257 - 128 as double)/16 + cast(user_id as double)/1024 as x,
       cast((event_id*17)%241 - 120 as double)/16 + cast(user_id as double)/2048 as y,
       cast((event_id*7)%97 - 48 as double)/16 + cast(0.015625 as double) as z,
       cast((event_id*3)%256 as double)/256 as r, cast((event_id*5)%256 as double)/256 as g,
       cast((event_id*11)%256 as double)/256 as b from events""",
    "fx_cameras": """select s_suppkey as cam_id, cast(s_suppkey%5 - 2 as double) as qx, cast(s_suppkey%3 - 1 as double) as qy,
       cast(s_suppkey%7 - 3 as double) as qz, cast(4 as double) as qw, cast((s_suppkey*3)%11 - 5 as double)/8 as tx,
       cast((s_suppkey*5)%13 - 6 as double)/8 as ty, cast((s_suppkey*2)%9 as double)/8 as tz from supplier where s_suppkey < 6""",
    # The navigable rectangles of the walk.
    "fx_rects": """select 0 as rect_id, cast(-47 as double) as xmin, cast(-4 as double) as ymin, cast(5 as double) as xmax, cast(0 as double) as ymax
  union all select 1, cast(-12 as double), cast(0 as double), cast(5 as double), cast(9 as double)
  union all select 2, cast(-11 as double), cast(9 as double), cast(-7 as double), cast(15 as double)
  union all select 3, cast(-3 as double), cast(9 as double), cast(2 as double), cast(14 as double)
  union all select 4, cast(-1 as double), cast(14 as double), cast(2 as double), cast(18 as double)""",
    "fx_polyline": """select user_id as curve_id, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as vertex_idx,
       cast((event_id*31)%257 - 128 as double)/16 as x, cast((event_id*17)%241 - 120 as double)/16 as y,
       cast((event_id*7)%97 - 48 as double)/16 as z from events""",
    "fx_noise": """select cast(event_id%5 as int) as walk_id, cast(floor(event_id/5) as int) as step,
       cast((event_id*37)%101 - 50 as double)/256 as n_theta, cast((event_id*53)%89 - 44 as double)/512 as n_step,
       cast((event_id*29)%61 - 30 as double)/1024 as n_bounce, cast((event_id*43)%71 - 35 as double)/512 as n_view
  from events where event_id < 200""",
    "fx_knn": "select point_id, x, y, z from fx_points3d where point_id < 500",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame over the tables of ``sf_dir``."""
    sql = FIXTURES[name]
    for table in ("part", "supplier", "events", "fx_points3d"):
        if f"from {table}" in sql:
            (fixture(spark, sf_dir, table) if table in FIXTURES else spark.read.parquet(f"{sf_dir}/{table}.parquet")).createOrReplaceTempView(table)
    return spark.sql(sql)
