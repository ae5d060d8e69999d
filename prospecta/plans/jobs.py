"""The two batch jobs as plans over all images, or all steps of all walks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.functions import geometry as g
from prospecta.operators import camera, graphs, space3d, walk


def slice_job(points: DataFrame, images: DataFrame, intrinsics: dict, *, dirs=120_000, farthest=40.0, heightlims=(0.0, 20.0), k=3) -> tuple[DataFrame, DataFrame]:
    """(metrics, aligned visible points with graph_id = cam_id): one pass over all images.

    Volume statistics run per pose, as the frustum differs by image; poses are rows of the image list, read once.
    """
    fov = g.field_of_view(intrinsics["W"], intrinsics["fx"]), g.field_of_view(intrinsics["H"], intrinsics["fy"])
    posed = camera.poses(images)
    stats = []
    for p in posed.select("cam_id", "cx", "cy", "cz", "vx", "vy", "vz").collect():
        own = space3d.volume_spherical(points, (p.cx, p.cy, p.cz), farthest=farthest, n=dirs, view_dir=(p.vx, p.vy, p.vz), fov=fov, heightlims=heightlims)
        stats.append(own.select(F.lit(p.cam_id).alias("cam_id"), F.lit(dirs).alias("dirs"), F.lit(20).alias("max_distance"), F.col("vol").alias("vol_calc"), "mean_dist", F.col("std_dist").alias("dist_std"), "min_dist", "max_dist", F.lit(p.cx).alias("posX"), F.lit(p.cy).alias("posY")))
    seen = camera.visible_points(points, images, intrinsics).join(posed.select("cam_id", *(f"{a}{b}" for a in "cv" for b in "xyz")), "cam_id")
    near = camera.aligned(seen, ("cx", "cy", "cz"), ("vx", "vy", "vz"))
    metrics = reduce(DataFrame.unionByName, stats) if stats else points.sparkSession.createDataFrame([], "cam_id long, dirs int, max_distance int, vol_calc double, mean_dist double, dist_std double, min_dist double, max_dist double, posX double, posY double")
    return metrics, near.select(F.col("cam_id").alias("graph_id"), "point_id", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"), "r", "g", "b")


def walk_views(points: DataFrame, path: DataFrame, *, fov, near=0.0, far=40.0, width=512, height=384, eye=-3.5) -> DataFrame:
    """(walk_id, step, pix, ui, vi, depth, point_id): the rendered winners of every step of every walk, in one plan."""
    right, up, forward = g.basis_columns(("vx", "vy", "vz"))
    named = {f"{n}{a}": c for n, v in (("r", right), ("u", up), ("f", forward)) for a, c in zip("xyz", v, strict=True)}
    poses = path.withColumns({f"b{k}": c for k, c in named.items()}).select("walk_id", "step", F.col("x").alias("px"), F.col("y").alias("py"), *(f"b{k}" for k in named))
    met = points.select("point_id", "x", "y", "z").crossJoin(poses)
    rel = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("z") - F.lit(float(eye))
    dot = lambda n: rel[0] * F.col(f"b{n}x") + rel[1] * F.col(f"b{n}y") + rel[2] * F.col(f"b{n}z")
    cam = met.withColumns({"cx": dot("r"), "cy": dot("u"), "depth": dot("f")}).where((F.col("depth") > 1e-6) & F.col("depth").between(near, far))
    cam = cam.where((F.abs(F.col("cx") / F.col("depth")) <= math.tan(fov[0] / 2)) & (F.abs(F.col("cy") / F.col("depth")) <= math.tan(fov[1] / 2)))
    best = camera.rasterised(cam, fov, width, height).groupBy("walk_id", "step", "pix").agg(F.min(F.struct("depth", "point_id", "ui", "vi")).alias("w"))
    return best.select("walk_id", "step", "pix", "w.ui", "w.vi", "w.depth", "w.point_id")


def walk_job(points: DataFrame, rects: DataFrame, n_walks: int, *, fov, width=512, height=384, n_steps=40, k=3) -> dict[str, DataFrame]:
    """The bundle tables of seeded walks: image, nodes, edges, location and view direction."""
    path = walk.seeded_walks(points.sparkSession, rects, n_walks, n_steps)
    seen = walk_views(points, path, fov=fov, width=width, height=height).join(points, "point_id")
    posed = seen.join(path.select("walk_id", "step", F.col("x").alias("lx"), F.col("y").alias("ly"), "vx", "vy", "vz"), ["walk_id", "step"])
    near = camera.aligned(posed, (F.col("lx"), F.col("ly"), F.lit(-3.5)), ("vx", "vy", "vz"))
    nodes = near.select("walk_id", "step", "point_id", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"), "r", "g", "b")
    return {
        "image": seen.select("walk_id", "step", "ui", "vi", *(g.color_byte(c).alias(f"{c}8") for c in "rgb"), F.col("depth").cast("float").alias("depth")),
        "nodes": nodes,
        "edges": graphs.knn_graph(nodes, k, ("walk_id", "step")),
        "loc": path.select("walk_id", "step", "x", "y", F.lit(-3.5).alias("z")),
        "view_dir": path.select("walk_id", "step", "vx", "vy", "vz"),
    }
