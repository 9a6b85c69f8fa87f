"""Quaternions, rigid transforms and box geometry as column expressions.

Quaternions are (w, x, y, z). Ego frame: x forward, y left, z up; a pose named a_to_b takes a-coordinates to b. Everything is
plain arithmetic on double columns, so it stays inside code generation and works on batch and streaming frames alike.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, prefix: str, names: str = "xyz") -> Vec:
        """Columns prefix + x, y, z."""
        return cls(*(F.col(prefix + n) for n in names))

    def plus(self, other: Vec) -> Vec:
        return Vec(*(a + b for a, b in zip(self, other, strict=True)))

    def minus(self, other: Vec) -> Vec:
        return Vec(*(a - b for a, b in zip(self, other, strict=True)))

    def named(self, prefix: str) -> dict[str, Column]:
        return {prefix + n: c for n, c in zip("xyz", self, strict=True)}


class Quat(NamedTuple):
    w: Column
    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, prefix: str) -> Quat:
        """Columns prefix + w, x, y, z."""
        return cls(*(F.col(prefix + n) for n in "wxyz"))

    def named(self, prefix: str) -> dict[str, Column]:
        return {prefix + n: c for n, c in zip("wxyz", self, strict=True)}


class Pose(NamedTuple):
    """A unit quaternion and a translation: p -> R(q) p + t."""

    q: Quat
    t: Vec


def normalized(q: Quat) -> Quat:
    """Unit quaternion; the zero quaternion is an error."""
    n = F.sqrt(q.w * q.w + q.x * q.x + q.y * q.y + q.z * q.z)
    safe = F.when(n > 0, n).otherwise(F.raise_error(F.lit("a quaternion of length zero has no direction")).cast("double"))
    return Quat(*(c / safe for c in q))


def conjugate(q: Quat) -> Quat:
    return Quat(q.w, -q.x, -q.y, -q.z)


def multiply(a: Quat, b: Quat) -> Quat:
    """The rotation b first, then a."""
    return Quat(
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
    )


def matrix(q: Quat) -> tuple[Vec, Vec, Vec]:
    """Rows of the rotation matrix of a unit quaternion."""
    w, x, y, z = q
    return (
        Vec(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        Vec(2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        Vec(2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def rotate(q: Quat, v: Vec) -> Vec:
    return Vec(*(r.x * v.x + r.y * v.y + r.z * v.z for r in matrix(q)))


def apply(pose: Pose, p: Vec) -> Vec:
    return rotate(pose.q, p).plus(pose.t)


def invert(pose: Pose) -> Pose:
    q = conjugate(pose.q)
    back = rotate(q, pose.t)
    return Pose(q, Vec(*(-c for c in back)))


def apply_inverse(pose: Pose, p: Vec) -> Vec:
    return rotate(conjugate(pose.q), p.minus(pose.t))


def compose(outer: Pose, inner: Pose) -> Pose:
    """inner first, then outer."""
    return Pose(multiply(outer.q, inner.q), apply(outer, inner.t))


def yaw(q: Quat) -> Column:
    """Angle of the rotated x axis in the ground plane."""
    return F.atan2(2 * (q.x * q.y + q.w * q.z), 1 - 2 * (q.y * q.y + q.z * q.z))


def from_yaw(angle: Column) -> Quat:
    return Quat(F.cos(angle / 2), F.lit(0.0), F.lit(0.0), F.sin(angle / 2))


#: Corner signs (x, y, z) in the order of the box model (fixed values).
CORNER_SIGNS = ((1, 1, 1), (1, -1, 1), (1, -1, -1), (1, 1, -1), (-1, 1, 1), (-1, -1, 1), (-1, -1, -1), (-1, 1, -1))


def corners(center: Vec, size: Vec, q: Quat) -> list[Vec]:
    """The 8 corners of a box; size is (length, width, height)."""
    half = Vec(size.x / 2, size.y / 2, size.z / 2)
    return [center.plus(rotate(q, Vec(half.x * a, half.y * b, half.z * c))) for a, b, c in CORNER_SIGNS]


#: fx, fy, cx, cy: the same for all rows, or columns.
Intrinsics = tuple[Column | float, Column | float, Column | float, Column | float]
#: Columns of a frame's own intrinsics.
OWN_INTRINSICS = ("kfx", "kfy", "kcx", "kcy")


def own_intrinsics() -> Intrinsics:
    """Each row's own camera, as sources.dataset reads it."""
    return tuple(F.col(c) for c in OWN_INTRINSICS)


def project(p: Vec, k: Intrinsics) -> tuple[Column, Column]:
    """Pinhole pixel (u, v) of a point in camera coordinates; k is (fx, fy, cx, cy)."""
    fx, fy, cx, cy = k
    return (p.x * fx + p.z * cx) / p.z, (p.y * fy + p.z * cy) / p.z


def visible(p: Vec, u: Column, v: Column, width: Column, height: Column, near: float = 0.1, inside: bool = True) -> Column:
    """In front of the near plane (strictly), and inside the image if asked."""
    front = p.z > near
    return front & (u >= 0) & (u < width) & (v >= 0) & (v < height) if inside else front


def project_matrix(p: Vec, k: Column) -> tuple[Column, Column]:
    """Pixel (u, v) of a point by a row's own intrinsic matrix, a 3 x 3 array of arrays with skew; null where nothing is in front to divide by."""
    row = lambda i: p.x * k[i][0] + p.y * k[i][1] + p.z * k[i][2]
    depth = row(2)
    return F.try_divide(row(0), depth), F.try_divide(row(1), depth)


def finite(*values: Column) -> Column:
    """All values are numbers: neither null nor NaN nor infinite."""
    out = F.lit(True)
    for v in values:
        out = out & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return out
