"""Column expressions for plane and space geometry. Angles are radians; divisions guard against zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def norm3(x, y, z) -> Column:
    x, y, z = map(col, (x, y, z))
    return F.sqrt(x * x + y * y + z * z)


def floored_angle(a) -> Column:
    """The angle modulo 2 pi, in [0, 2 pi)."""
    return F.pmod(col(a), F.lit(TWO_PI))


def swapped(a0, a1) -> Column:
    """Whether the ends must change places for the short way round to be counter-clockwise."""
    return floored_angle(col(a1) - col(a0)) > math.pi


def wraps(a0, a1) -> Column:
    """Whether a counter-clockwise interval crosses the cut at pi."""
    a0, a1 = col(a0), col(a1)
    return (a0 > 0) & (a1 < 0) & (a0 - a1 >= math.pi)


def polar_lerp(theta, a0, d0, a1, d1) -> Column:
    """The radius at theta on the line from (a0, d0) to (a1, d1) in the (angle, radius) plane; the smaller end if upright."""
    theta, a0, d0, a1, d1 = map(col, (theta, a0, d0, a1, d1))
    return F.when(a0 == a1, F.least(d0, d1)).otherwise(d0 + (d1 - d0) / F.nullif(a1 - a0, F.lit(0.0)) * (theta - a0))


def polar_to_xy(ox, oy, r, theta) -> tuple[Column, Column]:
    return col(ox) + col(r) * F.cos(col(theta)), col(oy) + col(r) * F.sin(col(theta))


def linspace(i, start: Column, stop: Column, n: int, closed: bool = True) -> Column:
    """The i-th of n evenly spaced values; with ``closed`` the last is exactly ``stop``."""
    start, stop, i = col(start), col(stop), col(i)
    if not closed:
        return start + i * ((stop - start) / n)
    return F.when(i == n - 1, stop).otherwise(start + i * ((stop - start) / max(1, n - 1)))


def spherical(x, y, z) -> tuple[Column, Column, Column]:
    """(radius, azimuth, elevation)."""
    x, y, z = map(col, (x, y, z))
    return norm3(x, y, z), F.atan2(y, x), F.atan2(z, F.sqrt(x * x + y * y))


def rotation_of(qx, qy, qz, qw) -> list[Column]:
    """The nine entries, row by row, of the rotation of a quaternion that need not be of unit length."""
    x, y, z, w = map(col, (qx, qy, qz, qw))
    n = x * x + y * y + z * z + w * w
    s = F.lit(2.0) / F.nullif(n, F.lit(0.0))
    return [
        1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
    ]


def apply(m: list[Column], v: tuple) -> tuple[Column, Column, Column]:
    """Matrix times vector."""
    v = [col(x) for x in v]
    return tuple(m[3 * k] * v[0] + m[3 * k + 1] * v[1] + m[3 * k + 2] * v[2] for k in range(3))


def transposed(m: list[Column]) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def camera_center(m: list[Column], t: tuple) -> tuple[Column, Column, Column]:
    return tuple(-x for x in apply(transposed(m), t))


def field_of_view(size: float, focal: float) -> float:
    return 2 * math.atan(size / (2 * focal))


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def camera_basis(view: tuple[float, float, float]) -> tuple[list[float], list[float], list[float]]:
    """(right, up, forward) of a constant view direction; up is z unless the view is nearly upright, then y."""
    def unit(v):
        n = math.sqrt(sum(x * x for x in v)) + 1e-9
        return [x / n for x in v]

    forward = unit(view)
    world = (0.0, 1.0, 0.0) if abs(forward[2]) > 0.99 else (0.0, 0.0, 1.0)
    right = unit(cross(forward, world))
    return right, list(cross(right, forward)), forward


def basis_columns(view: tuple) -> tuple[tuple, tuple, tuple]:
    """``camera_basis`` for a view direction in columns."""
    v = tuple(map(col, view))
    n = norm3(*v) + 1e-9
    f = tuple(x / n for x in v)
    steep = F.abs(f[2]) > 0.99
    world = (F.lit(0.0), F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0))
    r = cross(f, world)
    rn = norm3(*r) + 1e-9
    r = tuple(x / rn for x in r)
    return r, cross(r, f), f


def rotation_between(a: tuple, b: tuple[float, float, float]) -> list[Column]:
    """The rotation that takes direction a (columns) to direction b (constants): Rodrigues, with the parallel cases apart."""
    eps = 1e-12
    a = tuple(map(col, a))
    n = norm3(*a) + eps
    a = tuple(x / n for x in a)
    bn = math.sqrt(sum(x * x for x in b)) + eps
    b = tuple(F.lit(x / bn) for x in b)
    v = cross(a, b)
    c = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    s = norm3(*v)
    k = tuple(x / F.nullif(s, F.lit(0.0)) for x in v)
    side = F.abs(a[0]) > 0.9
    u = cross(a, (F.when(side, 0.0).otherwise(1.0), F.when(side, 1.0).otherwise(0.0), F.lit(0.0)))
    un = norm3(*u) + eps
    u = tuple(x / un for x in u)
    skew = [F.lit(0.0), -k[2], k[1], k[2], F.lit(0.0), -k[0], -k[1], k[0], F.lit(0.0)]
    out = []
    for i in range(3):
        for j in range(3):
            one = 1.0 if i == j else 0.0
            square = k[i] * k[j] - one
            out.append(F.when((s < eps) & (c > 0), F.lit(one)).when(s < eps, 2.0 * u[i] * u[j] - one).otherwise(one + skew[3 * i + j] * s + square * (1.0 - c)))
    return out


def fibonacci(i, n: int) -> tuple[Column, Column, Column]:
    """Direction i of n on the Fibonacci lattice, at float precision."""
    at = col(i) + 0.5
    phi, theta = F.acos(1 - 2 * at / n), math.pi * (1 + 5**0.5) * at
    return tuple(x.cast("float").cast("double") for x in (F.sin(phi) * F.cos(theta), F.sin(phi) * F.sin(theta), F.cos(phi)))


def height_clip(d, dz, floor: float, ceiling: float) -> Column:
    """A bin's distance after the floor and the ceiling (relative to the viewpoint); both tests use the distance before."""
    d, dz = col(d), col(dz)
    cut = lambda x: F.sqrt(F.greatest(F.lit(0.0), d * d - x * x))
    return F.when(d * dz < floor, cut(F.abs(d + floor))).when(d * dz > ceiling, cut(F.abs(d - ceiling))).otherwise(d)


def color_byte(c) -> Column:
    return F.least(F.greatest(col(c) * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int")
