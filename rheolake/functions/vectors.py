"""Three-component vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
Vec = tuple[Column, Column, Column]


def vec(prefix: str, names: str = "xyz") -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)  # type: ignore[return-value]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vec, b: Vec) -> Vec:
    return (a[0] - b[0], a[1] - b[1], a[2] - b[2])


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def softened_unit(a: Vec) -> Vec:
    """a over (its length + a tiny number): zero stays zero."""
    n = norm(a) + EPS
    return (a[0] / n, a[1] / n, a[2] / n)


def unit_or_x(a: Vec) -> Vec:
    """a over its length, or (1, 0, 0) for a vector without one."""
    n = norm(a)
    small = n <= EPS
    safe = F.when(small, 1.0).otherwise(n)
    return (F.when(small, 1.0).otherwise(a[0] / safe), F.when(small, 0.0).otherwise(a[1] / safe), F.when(small, 0.0).otherwise(a[2] / safe))


def tangential(v: Vec, n: Vec) -> Vec:
    """v without its part along the unit vector n."""
    d = dot(v, n)
    return (v[0] - d * n[0], v[1] - d * n[1], v[2] - d * n[2])


def in_plane_frame(n: Vec) -> tuple[Vec, Vec]:
    """Two unit vectors that span the plane of the unit normal n; with n they are right-handed.

    The first is square to the normal and to y where the normal points mostly along z, else to z.
    """
    along_z = F.abs(n[2]) > F.greatest(F.abs(n[0]), F.abs(n[1]))
    up = (F.lit(0.0), F.when(along_z, 1.0).otherwise(0.0), F.when(along_z, 0.0).otherwise(1.0))
    u = softened_unit(cross(n, up))
    return u, softened_unit(cross(n, u))


def direction_text(a: Vec) -> Column:
    """Axis of the largest component (the first at a tie) with its sign; empty for a zero vector."""
    x, y, z = a
    signed = lambda name, c: F.concat(F.lit(name), F.when(c >= 0, "+").otherwise("-"))
    return (
        F.when(norm(a) <= EPS, "")
        .when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), signed("LR", x))
        .when(F.abs(y) >= F.abs(z), signed("AP", y))
        .otherwise(signed("HF", z))
    )


def voxel_of(p: Column, origin: Column | float, spacing: Column | float, size: Column | int) -> Column:
    """Nearest voxel number (half to even), kept inside the volume."""
    at = F.rint((p - origin) / (spacing + F.lit(EPS))).cast("int")
    return F.least(F.greatest(at, F.lit(0)), F.lit(size) - 1 if isinstance(size, int) else size - 1)
