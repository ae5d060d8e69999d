"""Isovists in the plane: three kernels over (origin_id, ox, oy) x (seg_id, x1, y1, x2, y2).

A batch of origins is the base case; a single origin is a batch of one. Segments meet origins on a grid of
cells as wide as the radius, so no side is broadcast and no pair beyond the neighbouring cells is formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta.functions import geometry as g

#: Walls at least so long are split into equal pieces by the corner kernel.
LONGEST = 5.0


def segments_in_range(origins: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """Pairs of origin and segment with at least one end of the segment within the radius, ends relative to the origin.

    The pairs are dealt out by their ids: a small file of segments is one scan task, and what a pair grows into (rays, points, pieces) would stay in it.
    """
    cell = lambda x: F.floor(x / radius)
    ends = F.array(*(F.struct(F.lit(k).alias("end"), cell(F.col(f"x{k}")).alias("cx"), cell(F.col(f"y{k}")).alias("cy")) for k in (1, 2)))
    walls = segments.select("seg_id", "x1", "y1", "x2", "y2", F.inline(ends))
    around = F.array(*(F.struct((cell(F.col("ox")) + i).alias("cx"), (cell(F.col("oy")) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = origins.select("origin_id", "ox", "oy", F.inline(around)).join(walls, ["cx", "cy"])
    near = near.select("origin_id", "ox", "oy", "seg_id", "end", *((F.col(c) - F.col(o)).alias(c) for c, o in (("x1", "ox"), ("y1", "oy"), ("x2", "ox"), ("y2", "oy"))))
    near = near.withColumns({"d1": F.hypot("x1", "y1"), "d2": F.hypot("x2", "y2")})
    # A pair is kept at its first end in range only, so it occurs once.
    once = ((F.col("end") == 1) & (F.col("d1") <= radius)) | ((F.col("end") == 2) & (F.col("d2") <= radius) & (F.col("d1") > radius))
    parts = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return near.where(once).drop("end").repartition(parts, "origin_id", "seg_id")


def ring(origins: DataFrame, n: int) -> DataFrame:
    return origins.select("origin_id", "ox", "oy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ray_id"))


def _ray_angle(i: Column, n: int) -> Column:
    return i * (2 * math.pi / n)


def ray_hits(near: DataFrame, radius: float, n: int) -> DataFrame:
    """(origin_id, seg_id, ray_id, t): where counter-clockwise rays from +x meet segments, by the exact 2 x 2 test.

    A segment is tested only against the rays of its angular interval, widened by one; all rays if the origin lies on its line's carrier.
    """
    step = 2 * math.pi / n
    a1, a2 = F.atan2("y1", "x1"), F.atan2("y2", "x2")
    span = g.floored_angle(a2 - a1)
    low = F.when(span <= math.pi, a1).otherwise(a2)
    width = F.when(span <= math.pi, span).otherwise(2 * math.pi - span)
    flat = F.abs(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) <= 1e-9 * (1 + F.col("d1") * F.col("d2"))
    first = F.when(flat, F.lit(0)).otherwise((F.floor(low / step) - 1).cast("int"))
    last = F.when(flat, F.lit(n - 1)).otherwise(F.least(F.ceil((low + width) / step) + 1, F.floor(low / step) - 1 + n - 1).cast("int"))
    rays = near.withColumn("k", F.explode(F.sequence(first, last))).withColumn("ray_id", F.pmod("k", F.lit(n)))
    c, s = F.cos(_ray_angle(F.col("ray_id"), n)), F.sin(_ray_angle(F.col("ray_id"), n))
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rays = rays.withColumns({"det": c * -ey - s * -ex, "det_t": F.col("x1") * -ey - F.col("y1") * -ex, "det_u": c * F.col("y1") - s * F.col("x1")})
    rays = rays.where("det <> 0").withColumns({"t": F.col("det_t") / F.nullif("det", F.lit(0.0)), "u": F.col("det_u") / F.nullif("det", F.lit(0.0))})
    return rays.where((F.col("t") > 0) & (F.col("t") < radius) & F.col("u").between(0, 1)).select("origin_id", "seg_id", "ray_id", "t")


def nearest_hits(origins: DataFrame, hits: DataFrame, radius: float, n: int) -> DataFrame:
    """(origin_id, ray_id, r): the nearest hit of each ray, the radius where there is none."""
    default = ring(origins, n).select("origin_id", "ray_id", F.lit(float(radius)).alias("t"))
    return hits.select("origin_id", "ray_id", "t").unionByName(default).groupBy("origin_id", "ray_id").agg(F.min("t").alias("r"))


def polygon_areas(hits: DataFrame) -> DataFrame:
    """(origin_id, area) of the ring (origin_id, ray_id, dx, dy) of points relative to the origin."""
    ordered = Window.partitionBy("origin_id").orderBy("ray_id")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(ordered), F.first(c).over(whole))
    turned = hits.withColumns({"nx": following("dx"), "ny": following("dy")})
    return turned.groupBy("origin_id").agg((F.abs(F.sum(F.col("dx") * F.col("ny") - F.col("nx") * F.col("dy"))) / 2).alias("area"))


def hit_points(radii: DataFrame, origins: DataFrame, angle: Column, clockwise: bool = False) -> DataFrame:
    """(origin_id, ray_id, theta, r, dx, dy, hx, hy)."""
    cos, sin = (F.sin(angle), F.cos(angle)) if clockwise else (F.cos(angle), F.sin(angle))
    if clockwise:
        cos, sin = (x.cast("float").cast("double") for x in (cos, sin))
    out = radii.join(origins, "origin_id").withColumns({"theta": angle, "dx": cos * F.col("r"), "dy": sin * F.col("r")})
    return out.select("origin_id", "ray_id", "theta", "r", "dx", "dy", (F.col("ox") + F.col("dx")).alias("hx"), (F.col("oy") + F.col("dy")).alias("hy"))


def distance_stats(hits: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and population deviation of the distance from the origin to its hit points."""
    d = F.hypot("dx", "dy")
    return hits.groupBy("origin_id").agg(F.min(d).alias("min_distance"), F.max(d).alias("max_distance"), F.avg(d).alias("mean_distance"), F.stddev_pop(d).alias("std_distance"))


def _need_polygon(n: int) -> None:
    if n < 3:
        raise ValueError("a polygon needs at least three rays")


def segments_angle(origins: DataFrame, segments: DataFrame, radius: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(areas, hit points) by exact ray casting."""
    _need_polygon(n)
    radii = nearest_hits(origins, ray_hits(segments_in_range(origins, segments, radius), radius, n), radius, n)
    points = hit_points(radii, origins, _ray_angle(F.col("ray_id"), n))
    return polygon_areas(points), points


def wall_points(near: DataFrame, n: int) -> DataFrame:
    """(origin_id, seg_id, i, x, y): walls in range as points about 15 / n apart, laid from the first end."""
    count = F.floor(F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1"))) / F.lit(15.0 / n)).cast("int")
    points = near.withColumn("count", count).where("count > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    t = F.col("i") / (F.col("count") - 1 + 1e-6)
    return points.select("origin_id", "seg_id", "i", (F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("y"))


def nearest_ray(x, y, n: int) -> Column:
    """The ray nearest to a direction, among n clockwise rays from +y of which the last repeats the first."""
    return F.rint(g.floored_angle(F.atan2(g.col(x), g.col(y))) / (2 * math.pi / (n - 1))).cast("int")


def discretized(origins: DataFrame, segments: DataFrame, radius: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(areas, hit points) from walls as points in angular bins; an empty bin reaches min(1000, radius)."""
    _need_polygon(n)
    points = wall_points(segments_in_range(origins, segments, radius), n).withColumn("t", F.hypot("x", "y")).where(F.col("t") <= radius)
    hits = points.select("origin_id", F.lit(0).alias("seg_id"), nearest_ray("x", "y", n).alias("ray_id"), "t")
    radii = nearest_hits(origins, hits, min(1e3, radius), n).withColumn("r", F.least("r", F.lit(float(radius))))
    shown = hit_points(radii, origins, F.col("ray_id") * (2 * math.pi / (n - 1)), clockwise=True)
    return polygon_areas(shown), shown


def subdivided(near: DataFrame) -> DataFrame:
    """Walls of LONGEST or more as equal pieces; shorter walls as they are (piece 0)."""
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pieces = near.withColumn("length", F.sqrt(ex * ex + ey * ey)).withColumn("pieces", F.when(F.col("length") >= LONGEST, F.ceil(F.col("length") / LONGEST)).otherwise(1).cast("int"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    at = lambda c, k: F.when(F.col("pieces") == 1, F.col(f"{c}{k}")).otherwise(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * ((F.col("piece") + (k - 1)) / F.col("pieces")))
    return pieces.select("origin_id", "seg_id", "piece", at("x", 1).alias("px1"), at("y", 1).alias("py1"), at("x", 2).alias("px2"), at("y", 2).alias("py2"))


def polar_intervals(pieces: DataFrame) -> DataFrame:
    """(origin_id, seg_id, piece, part, a0, d0, a1, d1): counter-clockwise angular intervals, split at the cut at pi."""
    ends = pieces.select("origin_id", "seg_id", "piece", F.atan2("py1", "px1").alias("b0"), F.atan2("py2", "px2").alias("b1"), F.hypot("px1", "py1").alias("e0"), F.hypot("px2", "py2").alias("e1"))
    turn = g.swapped("b0", "b1")
    way = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    ccw = ends.select("origin_id", "seg_id", "piece", way("b0", "b1").alias("a0"), way("b1", "b0").alias("a1"), way("e0", "e1").alias("d0"), way("e1", "e0").alias("d1"))
    part = lambda k, a0, a1: F.struct(F.lit(k).alias("part"), a0.alias("a0"), a1.alias("a1"))
    parts = F.when(g.wraps("a0", "a1"), F.array(part(0, F.col("a0"), F.lit(math.pi)), part(1, F.lit(-math.pi), F.col("a1")))).otherwise(F.array(part(0, F.col("a0"), F.col("a1"))))
    return ccw.select("origin_id", "seg_id", "piece", "d0", "d1", F.inline(parts))


def envelope(intervals: DataFrame, radius: float, n: int) -> DataFrame:
    """(origin_id, k, theta, r): the lower envelope on n angles from the least to the greatest interval end, at most the radius."""
    bounds = intervals.groupBy("origin_id").agg(F.min(F.least("a0", "a1")).alias("low"), F.max(F.greatest("a0", "a1")).alias("high"))
    grid = bounds.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    step = (F.col("high") - F.col("low")) / max(1, n - 1)
    index = lambda a: F.when(step == 0, F.lit(0.0)).otherwise((a - F.col("low")) / F.nullif(step, F.lit(0.0)))
    left, right = F.least("a0", "a1"), F.greatest("a0", "a1")
    first, last = F.greatest(F.floor(index(left)) - 1, F.lit(0)).cast("int"), F.least(F.ceil(index(right)) + 1, F.lit(n - 1)).cast("int")
    met = intervals.join(bounds, "origin_id").withColumn("k", F.explode(F.when(step == 0, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.sequence(first, last))))
    theta = g.linspace("k", F.col("low"), F.col("high"), n)
    met = met.withColumn("theta", theta).where((F.col("theta") >= left) & (F.col("theta") <= right))
    low = met.select("origin_id", "k", g.polar_lerp("theta", "a0", "d0", "a1", "d1").alias("r"))
    default = grid.select("origin_id", "k", F.lit(float(radius)).alias("r"))
    lowest = low.unionByName(default).groupBy("origin_id", "k").agg(F.greatest(F.min("r"), F.lit(0.0)).alias("r"))
    return lowest.join(bounds, "origin_id").select("origin_id", "k", theta.alias("theta"), "r")


def corner(origins: DataFrame, segments: DataFrame, radius: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(areas, hit points) from the lower envelope of angular intervals; the mean squared radius is scaled to the full circle.

    An origin without walls in range has the whole disc; one on the end of a wall has a null area and no points.
    """
    near = segments_in_range(origins, segments, radius)
    pieces = subdivided(near)
    on_end = pieces.where("(px1 = 0 and py1 = 0) or (px2 = 0 and py2 = 0)").select("origin_id").distinct().withColumn("spoilt", F.lit(True))
    low = envelope(polar_intervals(pieces), radius, n).join(on_end, "origin_id", "left_anti")
    areas = low.groupBy("origin_id").agg((F.avg(F.col("r") * F.col("r")) * math.pi).alias("measured"))
    areas = origins.select("origin_id").join(areas, "origin_id", "left").join(on_end, "origin_id", "left")
    areas = areas.select("origin_id", F.when(F.col("spoilt"), None).otherwise(F.coalesce("measured", F.lit(math.pi * radius * radius))).alias("area"))
    points = low.withColumnRenamed("k", "ray_id").join(origins, "origin_id").withColumns({"dx": F.col("r") * F.cos("theta"), "dy": F.col("r") * F.sin("theta")})
    return areas, points.select("origin_id", "ray_id", "theta", "r", "dx", "dy", (F.col("ox") + F.col("dx")).alias("hx"), (F.col("oy") + F.col("dy")).alias("hy"))


KERNELS = {"corner": corner, "discretized": discretized, "segments_angle": segments_angle}


def boundary_samples(segments: DataFrame, step: float | None = None, samples_per_segment: int = 1, include_endpoints: bool = False) -> DataFrame:
    """(origin_id, ox, oy): points along the segments, distinct after rounding to 12 places, numbered in (x, y) order."""
    if step is not None and step <= 0:
        raise ValueError("step must be positive.")
    if samples_per_segment <= 0:
        raise ValueError("samples_per_segment must be positive.")
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(ex * ex + ey * ey)
    count = F.lit(samples_per_segment) if step is None else F.greatest(F.ceil(length / step), F.lit(1)).cast("int")
    count = F.when(length == 0, F.lit(1)).otherwise(count)
    laid = segments.withColumns({"length": length, "count": count})
    if include_endpoints:
        laid = laid.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("length") == 0, F.lit(0)).otherwise(F.col("count") + 1))))
        t = F.when(F.col("length") == 0, F.lit(0.0)).when(F.col("i") == F.col("count") + 1, F.lit(1.0)).otherwise(F.col("i") / (F.col("count") + 1))
    else:
        laid = laid.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
        t = F.when(F.col("length") == 0, F.lit(0.0)).otherwise((F.col("i") + 0.5) / F.col("count"))
    points = laid.select(F.bround(F.col("x1") + ex * t, 12).alias("ox"), F.bround(F.col("y1") + ey * t, 12).alias("oy")).distinct()
    return numbered(points, ["ox", "oy"], "origin_id")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their rank in ``order`` from 0, by ranges and their sizes rather than in one task."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*order)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(before, "_part").select((F.col("_before") + F.row_number().over(own) - 1).cast("long").alias(name), *rows.columns)
