"""Wall shear stress: velocities at three places inward from the wall, their tangential parts, the gradient at the wall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rheolake.functions.vectors import dot, norm, tangential, vec
from rheolake.operators.voxel import probe


def wall_gradient(t0: Column, t1: Column, t2: Column, d: Column | float, parabolic: bool = True) -> Column:
    """Slope at the wall from values at 0, d and 2d: the exact parabola's forward difference over 2d/14, or over d."""
    d = F.lit(d) if not isinstance(d, Column) else d
    slope = (-3.0 * t0 + 4.0 * t1 - t2) / (2.0 * d)
    bend = (t0 - 2.0 * t1 + t2) / (2.0 * d * d)
    return slope + bend * (2.0 * d / 14.0 if parabolic else d)


def wall_shear_stress(
    vertices: DataFrame, flow: DataFrame, viscosity: float = 4.0, inward: float = 0.6, parabolic: bool = True, no_slip: bool = True, spacing=(1.0, 1.0, 1.0)
) -> DataFrame:
    """vertices(case_id, vid, x, y, z, nx, ny, nz) with inward unit normals, flow(case_id, i, j, k, vx, vy, vz) in cm/s.

    Velocities in m/s, viscosity in mPa s, distance in mm; the stress is in Pa.  The value at 2d is weighted by how far
    the two tangential velocities agree (their product, kept in [-1, 1]).
    """
    depth = F.explode(F.array(*[F.lit(float(n)) for n in range(3)])).alias("n")
    places = vertices.select("case_id", "vid", "x", "y", "z", "nx", "ny", "nz", depth)
    moved = places.withColumns({c: F.col(c) + F.col("n") * inward * F.col(f"n{c}") for c in "xyz"})
    found = probe(flow, moved, ["vx", "vy", "vz"], spacing=spacing)
    speed = tuple(F.col(f"v{c}") / 100.0 for c in "xyz")
    along = tangential(speed, vec("n"))
    rows = found.select("case_id", "vid", F.col("n").cast("int").alias("n"), *[a.alias(f"a{c}") for a, c in zip(along, "xyz", strict=True)])
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(f"a{c}"))).alias(f"a{n}{c}")
    wide = rows.groupBy("case_id", "vid").agg(*[pick(n, c) for n in range(3) for c in "xyz"])
    a = [vec(f"a{n}") for n in range(3)]
    t0 = F.lit(0.0) if no_slip else norm(a[0])
    agree = F.least(F.greatest(dot(a[1], a[2]), F.lit(-1.0)), F.lit(1.0))
    stress = wall_gradient(t0, norm(a[1]), norm(a[2]) * agree, inward, parabolic) * viscosity
    return wide.select("case_id", "vid", stress.alias("wss"))


def sample_seeds(mask: DataFrame, ratio: float = 0.02, seed: int = 0, least: int = 50) -> DataFrame:
    """A portable random choice of voxels: of K, min(K, max(least, round(K ratio))) of the smallest keyed hashes.

    A mask(case_id, i, j, k, t) gets a choice of its own at each time, with the seed moved on by t.
    """
    whole = ["case_id", "t"] if "t" in mask.columns else ["case_id"]
    moved = F.lit(seed) + F.col("t") if "t" in mask.columns else F.lit(seed)
    order = Window.partitionBy(*whole).orderBy(F.md5(F.concat_ws("|", moved, "i", "j", "k")), "i", "j", "k")
    sizes = mask.groupBy(*whole).agg(F.count("*").alias("size"))
    wanted = F.least(F.col("size"), F.greatest(F.lit(least).cast("long"), F.rint(F.col("size") * ratio).cast("long")))
    ranked = mask.select(*whole, "i", "j", "k").withColumn("line_id", F.row_number().over(order) - 1)
    return ranked.join(sizes, whole).where(F.col("line_id") < wanted).drop("size")


#: Fixed value: what the seed is moved on by from path to path.
PATH_STRIDE = 104729


def plane_seeds(cut: DataFrame, ratio: float = 0.02, seed: int = 0, least: int = 50, times: DataFrame | None = None, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Places on each plane to start streamlines from, in voxels: max(least, ceil(n ratio)) of its n, by the smallest hashes.

    They are the centroids (px, py, pz in mm) of the cut's polygons where it has them, else its voxels' middles.  With
    times(case_id, t) each time has a choice of its own; the seed is moved on by the path's stride and by the time.
    """
    rows = cut if times is None else cut.join(times, "case_id")
    moved = F.lit(seed)
    if "path_id" in cut.columns:
        moved = moved + PATH_STRIDE * F.coalesce("path_id", F.lit(0))
    moved = moved if times is None else moved + F.col("t")
    key = ["case_id", "plane_index", *([] if times is None else ["t"])]
    whole = Window.partitionBy(*key)
    order = whole.orderBy(F.md5(F.concat_ws("|", moved, "plane_index", "i", "j", "k")), "i", "j", "k")
    ranked = rows.withColumns({"n": F.count("*").over(whole), "line_id": F.row_number().over(order) - 1})
    chosen = ranked.where(F.col("line_id") < F.greatest(F.lit(least).cast("long"), F.ceil(F.col("n") * ratio)))
    at = [F.col(f"p{p}") / s if f"p{p}" in cut.columns else F.col(c) + 0.5 for c, p, s in zip("ijk", "xyz", spacing, strict=True)]
    return chosen.select(*key, "line_id", *[a.alias(p) for a, p in zip(at, "xyz", strict=True)])
