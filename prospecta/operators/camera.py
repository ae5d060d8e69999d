"""Camera projections, z-buffers and rasters over (point_id, x, y, z, r, g, b)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.functions import geometry as g


def poses(cameras: DataFrame) -> DataFrame:
    """Cameras with rotation entries m0..m8, centre cx, cy, cz and view direction vx, vy, vz in the world."""
    m = g.rotation_of("qx", "qy", "qz", "qw")
    out = cameras.withColumns({f"m{k}": e for k, e in enumerate(m)})
    m = [F.col(f"m{k}") for k in range(9)]
    center = g.camera_center(m, ("tx", "ty", "tz"))
    n = g.norm3(m[6], m[7], m[8])
    view = {f"v{a}": m[6 + k] / n for k, a in enumerate("xyz")}
    return out.withColumns({f"c{a}": c for a, c in zip("xyz", center, strict=True)} | view)


def project_pinhole(points: DataFrame, cameras: DataFrame, intrinsics: dict) -> DataFrame:
    """(cam_id, point_id, depth, px, py) of the points in front of each camera, pixels rounded half to even.

    Cameras are few beside points and only their pose is sent; Spark broadcasts them while they are below its threshold.
    """
    posed = poses(cameras).select("cam_id", "tx", "ty", "tz", *(f"m{k}" for k in range(9)))
    met = points.select("point_id", "x", "y", "z").crossJoin(posed)
    x, y, z = (e + F.col(t) for e, t in zip(g.apply([F.col(f"m{k}") for k in range(9)], ("x", "y", "z")), ("tx", "ty", "tz"), strict=True))
    cam = met.select("cam_id", "point_id", x.alias("X"), y.alias("Y"), z.alias("depth")).where("depth > 0")
    u = intrinsics["fx"] * (F.col("X") / F.col("depth")) + intrinsics["cx"]
    v = intrinsics["fy"] * (F.col("Y") / F.col("depth")) + intrinsics["cy"]
    return cam.select("cam_id", "point_id", "depth", F.rint(u).alias("px"), F.rint(v).alias("py"))


def in_frame(projected: DataFrame, width: int, height: int) -> DataFrame:
    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)
    return projected.where(inside).withColumns({"px": F.col("px").cast("long"), "py": F.col("py").cast("long")}).withColumn("pix", F.col("py") * width + F.col("px"))


def nearest_per_pixel(rows: DataFrame, *keys: str) -> DataFrame:
    """The nearest point of every pixel, the smallest id on equal depth: a hash-combined minimum."""
    return rows.groupBy(*keys, "pix").agg(F.min(F.struct("depth", "point_id")).alias("best")).select(*keys, "pix", "best.depth", "best.point_id")


def visible_points(points: DataFrame, cameras: DataFrame, intrinsics: dict) -> DataFrame:
    """(cam_id, pix, depth, point_id, x, y, z, r, g, b) of the points that each camera sees."""
    seen = nearest_per_pixel(in_frame(project_pinhole(points, cameras, intrinsics), intrinsics["W"], intrinsics["H"]), "cam_id")
    return seen.join(points, "point_id")


def frustum_points(points: DataFrame, vantage: tuple, view: tuple, fov: tuple[float, float], near: float, far: float) -> DataFrame:
    """Points inside the view pyramid with their camera coordinates (cx, cy, depth)."""
    right, up, forward = g.camera_basis(view)
    rel = [F.col(a) - float(o) for a, o in zip("xyz", vantage, strict=True)]
    dot = lambda v: rel[0] * v[0] + rel[1] * v[1] + rel[2] * v[2]
    cam = points.withColumns({"cx": dot(right), "cy": dot(up), "depth": dot(forward)})
    cam = cam.where((F.col("depth") > 1e-6) & F.col("depth").between(near, far))
    return cam.where((F.abs(F.col("cx") / F.col("depth")) <= math.tan(fov[0] / 2)) & (F.abs(F.col("cy") / F.col("depth")) <= math.tan(fov[1] / 2)))


def rasterised(cam: DataFrame, fov: tuple[float, float], width: int, height: int) -> DataFrame:
    """Pixel column ui, row vi and index pix; fractions are cut off."""
    u = ((F.col("cx") / F.col("depth") / math.tan(fov[0] / 2)) * 0.5 + 0.5) * (width - 1)
    v = (0.5 - (F.col("cy") / F.col("depth") / math.tan(fov[1] / 2)) * 0.5) * (height - 1)
    clip = lambda x, n: F.least(F.greatest(x.cast("int"), F.lit(0)), F.lit(n - 1))
    return cam.withColumns({"ui": clip(u, width), "vi": clip(v, height)}).withColumn("pix", F.col("vi") * width + F.col("ui"))


def render(points: DataFrame, vantage, view, fov, near, far, width, height) -> DataFrame:
    """(pix, ui, vi, depth, point_id, r8, g8, b8): the pixel winners with byte colours."""
    cam = rasterised(frustum_points(points, vantage, view, fov, near, far), fov, width, height)
    best = cam.groupBy("pix").agg(F.min(F.struct("depth", "point_id", "ui", "vi", "r", "g", "b")).alias("w")).select("pix", "w.*")
    return best.select("pix", "ui", "vi", "depth", "point_id", *(g.color_byte(c).alias(f"{c}8") for c in "rgb"))


def pixel_grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    return spark.range(width * height).select(F.col("id").cast("int").alias("pix"), (F.col("id") % width).cast("int").alias("ui"), F.floor(F.col("id") / width).cast("int").alias("vi"))


def dense_raster(winners: DataFrame, width: int, height: int, background=(0, 0, 0), with_depth: bool = True) -> DataFrame:
    """All pixels: the winner's colour and depth, else the background and infinity."""
    grid = pixel_grid(winners.sparkSession, width, height)
    out = grid.join(winners.select("pix", "depth", "r8", "g8", "b8"), "pix", "left")
    cols = [F.coalesce(f"{c}8", F.lit(b)).alias(f"{c}8") for c, b in zip("rgb", background, strict=True)]
    return out.select("pix", "ui", "vi", *cols, *([F.coalesce("depth", F.lit(float("inf"))).alias("depth")] if with_depth else []))


def aligned(points: DataFrame, center: tuple, view: tuple) -> DataFrame:
    """``points`` in the frame whose x axis is the view direction and whose origin is the viewpoint (ax, ay, az)."""
    m = g.rotation_between(view, (1.0, 0.0, 0.0))
    out = g.apply(m, tuple(F.col(a) - g.col(c) for a, c in zip("xyz", center, strict=True)))
    return points.withColumns({f"a{a}": e for a, e in zip("xyz", out, strict=True)})
