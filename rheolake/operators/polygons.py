"""The polygons that planes cut from voxels: corners in turn and centroids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rheolake.functions.vectors import cross, dot, in_plane_frame, minus, vec
from rheolake.operators.planes import FLAT


def cut_corners(normal: tuple[Column, Column, Column], offset: Column, sides) -> Column:
    """Places where a plane meets the edges of a box, in no order, counted from the box's low corner.

    offset: distance along the unit normal from that corner to the plane.  Corners on the plane count as behind it, so a
    face on the plane belongs to the box ahead of it; a place where several edges meet the plane is listed once.
    """
    n = [F.when(F.abs(c) > FLAT, c).otherwise(0.0) for c in normal]
    height = lambda p: sum((c * (a * s) for c, a, s in zip(n, p, sides, strict=True)), -offset)
    places = []
    for axis in range(3):
        for start in product((0, 1), repeat=3):
            if start[axis]:
                continue
            end = tuple(1 if m == axis else a for m, a in enumerate(start))
            h, g = height(start), height(end)
            part = h / (h - g)
            at = [F.when(F.lit(m == axis), part * s).otherwise(float(a * s)).alias(c) for m, (a, s, c) in enumerate(zip(start, sides, "xyz", strict=True))]
            places.append(F.when((h <= 0) != (g <= 0), F.struct(*at)))
    return F.array_distinct(F.filter(F.array(*places), lambda p: p.isNotNull()))


def _part(p: Column) -> tuple[Column, Column, Column]:
    return (p["x"], p["y"], p["z"])


def polygons(cut: DataFrame, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """cut(i, j, k, cx .. cz, nx .. nz with unit normals) with corners (x, y, z in mm, counter-clockwise seen from the
    normal's tip) and px, py, pz, the centroid of the polygon between them.

    A polygon without an area to speak of has the mean of its corners, and one without corners the middle of its voxel.
    """
    low = [F.col(c) * s + o for c, s, o in zip("ijk", spacing, origin, strict=True)]
    offset = dot(vec("n"), (F.col("cx") - low[0], F.col("cy") - low[1], F.col("cz") - low[2]))
    names = cut.columns
    rows = cut.withColumn("_loose", cut_corners(vec("n"), offset, spacing))
    total = lambda c: F.aggregate("_loose", F.lit(0.0), lambda a, p: a + p[c])
    rows = rows.withColumn("_mean", F.struct(*[(total(c) / F.greatest(F.size("_loose"), F.lit(1))).alias(c) for c in "xyz"]))
    u, v = in_plane_frame(vec("n"))
    rows = rows.withColumn("_frame", F.struct(*[F.struct(*[x.alias(c) for x, c in zip(w, "xyz", strict=True)]).alias(name) for name, w in (("u", u), ("v", v))]))

    def turned(p: Column) -> Column:
        out = minus(_part(p), _part(F.col("_mean")))
        angle = F.atan2(dot(out, _part(F.col("_frame.v"))), dot(out, _part(F.col("_frame.u"))))
        return F.struct(angle.alias("angle"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))

    rows = rows.withColumn("_loop", F.array_sort(F.transform("_loose", turned)))
    first = _part(F.col("_loop")[0])
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("area", "x", "y", "z")])

    def fan(so_far: Column, m: Column) -> Column:
        a, b = _part(F.col("_loop")[m]), _part(F.col("_loop")[m + 1])
        size = dot(cross(minus(a, first), minus(b, first)), vec("n")) / 2.0
        middle = [(so_far[c] + size * (f + p + q) / 3.0).alias(c) for c, f, p, q in zip("xyz", first, a, b, strict=True)]
        return F.struct((so_far["area"] + size).alias("area"), *middle)

    sums = F.when(F.size("_loop") >= 3, F.aggregate(F.sequence(F.lit(1), F.size("_loop") - 2), zero, fan)).otherwise(zero)
    rows = rows.withColumn("_sums", sums)
    least = 1e-12 * spacing[0] * spacing[1]
    inside = {
        c: F.when(F.col("_sums.area") > least, F.col(f"_sums.{c}") / F.col("_sums.area")).when(F.size("_loop") > 0, F.col(f"_mean.{c}")).otherwise(s / 2.0)
        for c, s in zip("xyz", spacing, strict=True)
    }
    placed = F.transform("_loop", lambda p: F.struct(*[(p[c] + o).alias(c) for c, o in zip("xyz", low, strict=True)]))
    return rows.select(*names, placed.alias("corners"), *[(inside[c] + o).alias(f"p{c}") for c, o in zip("xyz", low, strict=True)])
