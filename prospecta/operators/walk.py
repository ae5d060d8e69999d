"""Smooth random walks inside a union of rectangles (rect_id, xmin, ymin, xmax, ymax)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WALK = "walk_id int, step int, x double, y double, yaw double, vx double, vy double, vz double"


def rect_area() -> Column:
    return F.greatest(F.lit(0.0), F.col("xmax") - F.col("xmin")) * F.greatest(F.lit(0.0), F.col("ymax") - F.col("ymin"))


def inside(x: Column, y: Column, rects: list) -> Column:
    """Whether (x, y) is in any of the collected rectangles; a plan has few of them, each a conjunction."""
    out = F.lit(False)
    for r in rects:
        out = out | (x.between(r["xmin"], r["xmax"]) & y.between(r["ymin"], r["ymax"]))
    return out


def in_union(points: DataFrame, rects: DataFrame, x: str = "ox", y: str = "oy") -> DataFrame:
    """The points inside any rectangle."""
    return points.join(rects, F.col(x).between(F.col("xmin"), F.col("xmax")) & F.col(y).between(F.col("ymin"), F.col("ymax")), "left_semi")


def area_shares(rects: DataFrame) -> DataFrame:
    total = rects.agg(F.sum(rect_area()).alias("total"))
    return rects.crossJoin(F.broadcast(total)).select("rect_id", rect_area().alias("area"), (rect_area() / F.nullif("total", F.lit(0.0))).alias("share"))


def sample_in_union(spark: SparkSession, rects: DataFrame, n: int, seed: int) -> DataFrame:
    """(sample_id, rect_id, x, y): rectangles by area, then uniform inside; overlaps are drawn twice as often."""
    order = Window.orderBy("rect_id")
    shares = area_shares(rects)
    if not (shares.agg(F.sum("area")).first()[0] or 0) > 0:
        raise ValueError("the rectangles have no area.")
    upto = F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))
    steps = shares.where("area > 0").select("rect_id", (upto - F.col("share")).alias("lo"), upto.alias("hi"), F.max("rect_id").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    bands = rects.join(steps, "rect_id").withColumn("hi", F.when(F.col("rect_id") == F.col("last"), 2.0).otherwise(F.col("hi")))
    drawn = spark.range(n).select(F.col("id").alias("sample_id"), F.rand(seed).alias("u"), F.rand(seed + 1).alias("ux"), F.rand(seed + 2).alias("uy"))
    met = drawn.join(F.broadcast(bands), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return met.select("sample_id", "rect_id", (F.col("xmin") + (F.col("xmax") - F.col("xmin")) * F.col("ux")).alias("x"), (F.col("ymin") + (F.col("ymax") - F.col("ymin")) * F.col("uy")).alias("y"))


def walk_from_noise(noise: DataFrame, rects: DataFrame, start: tuple[float, float], theta0: float, step: float = 0.2, pitch: float = -0.1, pull: float = 0.1) -> DataFrame:
    """Walks whose noise is data (walk_id, step, n_theta, n_step, n_bounce, n_view): a fold over each walk's steps."""
    corners = rects.collect()
    if not any(r["xmin"] <= start[0] <= r["xmax"] and r["ymin"] <= start[1] <= r["ymax"] for r in corners):
        raise ValueError("the start lies outside the rectangles.")
    state = F.struct(F.lit(float(start[0])).alias("x"), F.lit(float(start[1])).alias("y"), F.lit(float(theta0)).alias("th"), F.lit(float(theta0)).alias("yaw"))
    record = "array<struct<step:int,x:double,y:double,yaw:double>>"

    def advance(acc, e):
        s = acc["s"]
        th, length = s["th"] + e["n_theta"], F.greatest(F.lit(0.0), step + e["n_step"])
        x1, y1 = s["x"] + length * F.cos(th), s["y"] + length * F.sin(th)
        back = th + math.pi + e["n_bounce"]
        x2, y2 = s["x"] + length * F.cos(back), s["y"] + length * F.sin(back)
        ok1, ok2 = inside(x1, y1, corners), inside(x2, y2, corners)
        way = F.when(ok1, th).otherwise(back)
        x, y = F.when(ok1, x1).when(ok2, x2).otherwise(s["x"]), F.when(ok1, y1).when(ok2, y2).otherwise(s["y"])
        yaw = (1.0 - pull) * s["yaw"] + pull * way + e["n_view"]
        new = F.struct(x.alias("x"), y.alias("y"), way.alias("th"), yaw.alias("yaw"))
        return F.struct(new.alias("s"), F.concat(acc["out"], F.array(F.struct(e["step"].alias("step"), x.alias("x"), y.alias("y"), yaw.alias("yaw")))).alias("out"))

    steps = noise.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("step", "n_theta", "n_step", "n_bounce", "n_view"))).alias("steps"))
    folded = steps.select("walk_id", F.aggregate("steps", F.struct(state.alias("s"), F.array().cast(record).alias("out")), advance).alias("f"))
    path = folded.select("walk_id", F.inline("f.out"))
    return path.withColumns(view_of("yaw", pitch))


def view_of(yaw, pitch: float) -> dict[str, Column]:
    y = F.col(yaw)
    return {"vx": math.cos(pitch) * F.cos(y), "vy": math.cos(pitch) * F.sin(y), "vz": F.lit(math.sin(pitch))}


def heading_walk(start, rects, rng: np.random.Generator, n_steps=300, step=0.1, sigma_theta=0.15, sigma_step=0.02, pitch=-0.1, sigma_view=0.07, view_pull=0.1) -> pd.DataFrame:
    """One walk in the draw order theta0, then per step heading, length, bounce if needed, view."""
    box = np.asarray(rects, float)
    within = lambda x, y: bool(((box[:, 0] <= x) & (x <= box[:, 2]) & (box[:, 1] <= y) & (y <= box[:, 3])).any())
    x, y = map(float, start)
    if not within(x, y):
        raise ValueError("the start lies outside the rectangles.")
    heading = yaw = rng.uniform(0, 2 * math.pi)
    out = []
    for i in range(n_steps):
        heading += rng.normal(scale=sigma_theta)
        length = max(0.0, step + rng.normal(scale=sigma_step))
        for bounce in (False, True):
            if bounce:
                heading += math.pi + rng.normal(scale=0.05)
            nx, ny = x + length * math.cos(heading), y + length * math.sin(heading)
            if within(nx, ny):
                x, y = nx, ny
                break
        yaw = (1.0 - view_pull) * yaw + view_pull * heading + rng.normal(scale=sigma_view)
        out.append((i, x, y, yaw, math.cos(pitch) * math.cos(yaw), math.cos(pitch) * math.sin(yaw), math.sin(pitch)))
    return pd.DataFrame(out, columns=["step", "x", "y", "yaw", "vx", "vy", "vz"])


def seeded_walks(spark: SparkSession, rects: DataFrame, n_walks: int, n_steps: int = 40, step: float = 0.2, sigma_theta: float = 0.15, sigma_step: float = 0.1, samples: int = 10_000) -> DataFrame:
    """Walk ``walk_id`` is seeded by its id: mixture samples, one of them as start, then the steps."""
    box = [(r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in rects.orderBy("rect_id").collect()]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(pdf.walk_id.iloc[0]))
        b = np.asarray(box)
        area = np.clip(b[:, 2] - b[:, 0], 0, None) * np.clip(b[:, 3] - b[:, 1], 0, None)
        picks = rng.choice(len(b), size=samples, p=area / area.sum())
        points = np.array([[rng.uniform(b[i, 0], b[i, 2]), rng.uniform(b[i, 1], b[i, 3])] for i in picks])
        out = heading_walk(rng.choice(points), b, rng, n_steps, step, sigma_theta, sigma_step)
        out.insert(0, "walk_id", pdf.walk_id.iloc[0])
        return out

    return spark.range(n_walks).select(F.col("id").cast("int").alias("walk_id")).groupBy("walk_id").applyInPandas(walk, WALK)
