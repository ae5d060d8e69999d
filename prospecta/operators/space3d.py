"""Visible volume over spherical direction bins, for one viewpoint over (point_id, x, y, z, r, g, b)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospecta.functions import geometry as g

#: Candidate directions per point lie within this many lattice steps (in units of sqrt(n)) of the point's own height.
WINDOW = 2.0


def directions(spark: SparkSession, n: int) -> DataFrame:
    """(dir_id, dx, dy, dz): the Fibonacci lattice."""
    x, y, z = g.fibonacci("dir_id", n)
    return spark.range(n).select(F.col("id").cast("int").alias("dir_id")).select("dir_id", x.alias("dx"), y.alias("dy"), z.alias("dz"))


def in_frustum(dirs: DataFrame, view: tuple, fov: tuple[float, float], margin: float = 0.0) -> DataFrame:
    """The directions in front of the camera within half the fields of view, less a margin, either way."""
    right, up, forward = g.camera_basis(view)
    dot = lambda v: F.col("dx") * v[0] + F.col("dy") * v[1] + F.col("dz") * v[2]
    x, y, z = dot(right), dot(up), dot(forward)
    return dirs.where((z > 0) & (F.abs(F.atan2(x, z)) <= fov[0] / 2 - margin) & (F.abs(F.atan2(y, z)) <= fov[1] / 2 - margin))


def points_in_range(points: DataFrame, origin: tuple, nearest: float, farthest: float) -> DataFrame:
    """Points by their distance from the origin, both bounds included, with relative position and direction."""
    rel = {c: F.col(a) - float(o) for c, a, o in zip(("rx", "ry", "rz"), "xyz", origin, strict=True)}
    out = points.withColumns(rel).withColumn("dist", g.norm3("rx", "ry", "rz")).where(F.col("dist").between(nearest, farthest))
    return out.withColumns({u: F.col(r) / (F.col("dist") + 1e-5) for u, r in (("ux", "rx"), ("uy", "ry"), ("uz", "rz"))})


def _dot() -> Column:
    return F.col("ux") * F.col("dx") + F.col("uy") * F.col("dy") + F.col("uz") * F.col("dz")


def _best(met: DataFrame) -> DataFrame:
    best = met.groupBy("point_id").agg(F.max(F.struct(_dot().alias("dot"), (-F.col("dir_id")).alias("id"))).alias("best"))
    return best.select("point_id", (-F.col("best.id")).alias("dir_id"))


def nearest_direction(points: DataFrame, n: int, view: tuple | None = None, fov: tuple[float, float] | None = None) -> DataFrame:
    """``points`` with the nearest retained of the n directions, the smallest id on ties.

    The lattice descends evenly in z, so a point's candidates are a window of ids around its own height: an
    equi-join on bands of ids. If the nearest of all directions is not retained, the point lies outside the view pyramid or
    beside its edge, and the nearest retained one is close to the edge: within a few lattice steps of it,
    about sqrt(n) directions, which is what is broadcast for those points.
    """
    dirs = directions(points.sparkSession, n)
    width = max(1, math.ceil(WINDOW * math.sqrt(n)))
    own = F.floor((1 - F.col("uz")) * n / 2 / width).cast("int")
    slim = points.select("point_id", "ux", "uy", "uz")
    banded = slim.withColumn("band", F.explode(F.array(own - 1, own, own + 1)))
    found = _best(banded.join(dirs.withColumn("band", F.floor(F.col("dir_id") / width).cast("int")), "band"))
    if view is not None:
        kept = in_frustum(dirs, view, fov)
        inner = in_frustum(dirs, view, fov, 4 * math.sqrt(4 * math.pi / n))
        edge = kept.join(inner.select("dir_id"), "dir_id", "left_anti")
        inside = found.join(F.broadcast(kept.select("dir_id")), "dir_id", "left_semi").select("point_id", "dir_id")
        outside = slim.join(inside, "point_id", "left_anti")
        found = inside.unionByName(_best(outside.crossJoin(F.broadcast(edge))))
    return points.join(found, "point_id")


def nearest_direction_plain(points: DataFrame, dirs: DataFrame) -> DataFrame:
    """The same by comparing every point with every direction of ``dirs``; for checks."""
    return points.join(_best(points.select("point_id", "ux", "uy", "uz").crossJoin(dirs)), "point_id")


def bin_minimum(dirs: DataFrame, assigned: DataFrame) -> DataFrame:
    """(dir_id, dx, dy, dz, dist): the nearest point of each direction, 1e5 where there is none."""
    low = assigned.groupBy("dir_id").agg(F.min("dist").alias("low"))
    return dirs.join(low, "dir_id", "left").select("dir_id", "dx", "dy", "dz", F.coalesce("low", F.lit(1e5)).alias("dist"))


def unknown(bins: DataFrame, farthest: float, as_farthest: bool) -> DataFrame:
    """Bins beyond the range become 0, or the range itself."""
    return bins.withColumn("dist", F.when(F.col("dist") > farthest, float(farthest) if as_farthest else 0.0).otherwise(F.col("dist")))


def solid_angle(fov: tuple[float, float] | None) -> float:
    if fov is None:
        return 4 * math.pi
    if max(fov) > math.pi:
        raise ValueError("a field of view beyond pi folds back; leave view_dir out for the full sphere")
    return 4 * math.asin(math.sin(fov[0] / 2) * math.sin(fov[1] / 2))


def volume_stats(bins: DataFrame, omega: float, farthest: float) -> DataFrame:
    """One row: vol, min, max, mean and population deviation over all bins, zeros included."""
    clean = bins.withColumn("dist", valid_ray(F.col("dist"), farthest))
    d = F.col("dist")
    return clean.agg((F.sum(d * d * d) * omega / (3 * F.count("*"))).alias("vol"), F.min(d).alias("min_dist"), F.max(d).alias("max_dist"), F.avg(d).alias("mean_dist"), F.stddev_pop(d).alias("std_dist"))


def valid_ray(d: Column, farthest: float) -> Column:
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")) | (d > farthest), 0.0).otherwise(d)


def spherical_bins(points: DataFrame, origin, *, nearest=0.0, farthest=40.0, n=1200, view_dir=None, fov=None, heightlims=None, max_unknown=False, clip_to_frustum=False) -> DataFrame:
    """The direction bins of a viewpoint. Points outside the frustum count for their nearest ray unless clipped."""
    dirs = directions(points.sparkSession, n)
    kept = dirs if view_dir is None else in_frustum(dirs, view_dir, fov)
    seen = points_in_range(points, origin, nearest, farthest)
    if clip_to_frustum and view_dir is not None:
        seen = in_frustum(seen.withColumns({"dx": F.col("ux"), "dy": F.col("uy"), "dz": F.col("uz")}), view_dir, fov).drop("dx", "dy", "dz")
    bins = bin_minimum(kept, nearest_direction(seen, n, view_dir, fov))
    if heightlims is not None:
        bins = bins.withColumn("dist", g.height_clip("dist", "dz", heightlims[0] - origin[2], heightlims[1] - origin[2]))
    return unknown(bins, farthest, max_unknown)


def volume_spherical(points: DataFrame, origin, *, fov=None, farthest=40.0, **how) -> DataFrame:
    bins = spherical_bins(points, origin, fov=fov, farthest=farthest, **how)
    return volume_stats(bins, solid_angle(fov if how.get("view_dir") is not None else None), farthest)


def visible_ends(bins: DataFrame, farthest: float) -> DataFrame:
    """(dir_id, ex, ey, ez): end points of the rays that have a distance, relative to the viewpoint."""
    rays = bins.withColumn("dist", valid_ray(F.col("dist"), farthest)).where("dist > 0")
    return rays.select("dir_id", *((F.col(d) * F.col("dist")).alias(e) for d, e in (("dx", "ex"), ("dy", "ey"), ("dz", "ez"))))


def nearest_color(ends: DataFrame, seen: DataFrame, cell: float = 1.0) -> DataFrame:
    """The colour of the point nearest to each ray's end.

    An end and its point lie within a few cells as a rule: cells are probed in growing shells, doubling
    the cell for the ends that are not settled, until every end has a point no farther than the cell.
    """
    left, out = ends, None
    while True:
        c = lambda a, s=cell: F.floor(F.col(a) / s)
        around = F.array(*(F.struct((c("ex") + i).alias("cx"), (c("ey") + j).alias("cy"), (c("ez") + k).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
        placed = seen.select("point_id", "rx", "ry", "rz", "r", "g", "b", c("rx").alias("cx"), c("ry").alias("cy"), c("rz").alias("cz"))
        met = left.select("*", F.inline(around)).join(placed, ["cx", "cy", "cz"])
        dist = g.norm3(F.col("ex") - F.col("rx"), F.col("ey") - F.col("ry"), F.col("ez") - F.col("rz"))
        best = met.withColumn("dist", dist).groupBy("dir_id").agg(F.min(F.struct("dist", "point_id", "r", "g", "b")).alias("best")).where(F.col("best.dist") <= cell)
        found = best.select("dir_id", "best.r", "best.g", "best.b", F.col("best.point_id").alias("point_id"))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("dir_id"), "dir_id", "left_anti")
        if left.isEmpty() or seen.isEmpty():
            return out
        cell *= 4


def directional_raycast(points: DataFrame, origin, view_dir, fov: tuple[float, float], *, nearest=0.0, farthest=40.0, n=1200, heightlims=None, max_unknown=False) -> tuple[DataFrame, DataFrame]:
    """(rays, stats) of one camera pose: the rays that reach a distance, with end point and colour, and one row of volume statistics.

    rays: (dir_id, ex, ey, ez, point_id, r, g, b), ends relative to the origin, coloured by the point in range nearest to the end, the smallest id on ties. Without a point in
    range there are no rays. stats: as volume_stats gives them, over all directions of the frustum.
    """
    bins = spherical_bins(points, origin, nearest=nearest, farthest=farthest, n=n, view_dir=view_dir, fov=fov, heightlims=heightlims, max_unknown=max_unknown)
    ends = visible_ends(bins, farthest)
    rays = ends.join(nearest_color(ends, points_in_range(points, origin, nearest, farthest)), "dir_id")
    return rays.select("dir_id", "ex", "ey", "ez", "point_id", "r", "g", "b"), volume_stats(bins, solid_angle(fov), farthest)


def interpolated_linear(bins: DataFrame) -> DataFrame:
    """(dir_id, value): zero bins filled along the bin index, ends clamped."""
    back = Window.orderBy("dir_id").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("dir_id").rowsBetween(0, Window.unboundedFollowing)
    known = lambda c: F.when(F.col("dist") != 0, c)
    ends = bins.select("dir_id", "dist", F.last(known(F.col("dir_id")), True).over(back).alias("i0"), F.last(known(F.col("dist")), True).over(back).alias("v0"), F.first(known(F.col("dir_id")), True).over(ahead).alias("i1"), F.first(known(F.col("dist")), True).over(ahead).alias("v1"))
    share = (F.col("dir_id") - F.col("i0")) / F.nullif(F.col("i1") - F.col("i0"), F.lit(0))
    return ends.select("dir_id", F.coalesce(F.when(F.col("dist") != 0, F.col("dist")), F.col("v0") + (F.col("v1") - F.col("v0")) * share, F.col("v0"), F.col("v1")).alias("value"))


def interpolated_knn(bins: DataFrame, k: int) -> DataFrame:
    """(dir_id, value): the inverse-distance mean of the k known bins nearest in index; known bins keep their value."""
    known = F.broadcast(bins.where("dist <> 0").select(F.col("dir_id").alias("j"), F.col("dist").alias("v")))
    near = Window.partitionBy("dir_id").orderBy("gap", "j")
    met = bins.select("dir_id").crossJoin(known).withColumn("gap", F.abs(F.col("dir_id") - F.col("j")))
    top = met.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    weight = 1.0 / F.nullif(F.col("gap"), F.lit(0))
    value = F.coalesce(F.max(F.when(F.col("gap") == 0, F.col("v"))), F.sum(weight * F.col("v")) / F.sum(weight))
    return top.groupBy("dir_id").agg(value.alias("value"))


def interpolated_cubic(bins: DataFrame) -> DataFrame:
    """(dir_id, value): a natural-cubic-like spline through the known bins, with not-a-knot ends where four or more are known."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dir_id")
        x, y, at = pdf.dir_id[pdf.dist != 0].to_numpy(float), pdf.dist[pdf.dist != 0].to_numpy(float), pdf.dir_id.to_numpy(float)
        return pd.DataFrame({"dir_id": pdf.dir_id.to_numpy(), "value": spline(x, y, at)})

    return bins.select("dir_id", "dist", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(solve, "dir_id int, value double")


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with not-a-knot ends; the interpolating polynomial for fewer than four points."""
    if len(x) == 0:
        return np.full(len(at), np.nan)
    if len(x) < 4:
        return np.polyval(np.polyfit(x, y, len(x) - 1), at)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    n = len(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (d[i] - d[i - 1])
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[i]
    return y[i] + t * (d[i] - h[i] * (2 * m[i] + m[i + 1]) / 6) + m[i] / 2 * t**2 + (m[i + 1] - m[i]) / (6 * h[i]) * t**3


def hull_volume(points: DataFrame, key: str | None = None) -> DataFrame:
    """The volume of the convex hull of (ex, ey, ez), one group per ``key``; a group is one viewpoint's rays, so bounded by n."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"hull_volume": [convex_volume(pdf[["ex", "ey", "ez"]].to_numpy(float))]})
        if key is not None:
            out.insert(0, key, pdf[key].iloc[0])
        return out

    kind = "hull_volume double" if key is None else f"{key} {points.schema[key].dataType.simpleString()}, hull_volume double"
    return points.withColumn("_all", F.lit(0)).groupBy(key or "_all").applyInPandas(solve, kind)


def convex_volume(p: np.ndarray) -> float:
    """Incremental hull: a new point replaces the faces that it sees by a fan over their horizon."""
    p = np.unique(p, axis=0)
    if len(p) < 4:
        return 0.0
    scale = np.abs(p - p.mean(0)).max() or 1.0
    eps = 1e-10 * scale**3
    a = 0
    b = int(np.argmax(((p - p[a]) ** 2).sum(1)))
    c = int(np.argmax((np.cross(p - p[a], p[b] - p[a]) ** 2).sum(1)))
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    d = int(np.argmax(np.abs((p - p[a]) @ normal)))
    if abs((p[d] - p[a]) @ normal) <= eps:
        return 0.0
    inner = p[[a, b, c, d]].mean(0)

    def face(i, j, k):
        n = np.cross(p[j] - p[i], p[k] - p[i])
        return (i, j, k) if (inner - p[i]) @ n < 0 else (i, k, j)

    faces = np.array([face(a, b, c), face(a, b, d), face(a, c, d), face(b, c, d)])
    for q in range(len(p)):
        normals = np.cross(p[faces[:, 1]] - p[faces[:, 0]], p[faces[:, 2]] - p[faces[:, 0]])
        seen = np.einsum("ij,ij->i", normals, p[q] - p[faces[:, 0]]) > eps
        if not seen.any():
            continue
        edges = {(int(f[i]), int(f[(i + 1) % 3])) for f in faces[seen] for i in range(3)}
        fan = [(i, j, q) for i, j in edges if (j, i) not in edges]
        faces = np.vstack([faces[~seen], fan])
    v = p - inner
    return float(np.abs(np.einsum("ij,ij->i", v[faces[:, 0]], np.cross(v[faces[:, 1]], v[faces[:, 2]]))).sum() / 6)
