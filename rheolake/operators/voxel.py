"""Voxel tables: boxes, crops, morphology by offset joins, faces, slices, resampling.

A mask is a table of its voxels (case_id, i, j, k); a volume adds values.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("case_id", "i", "j", "k")
FACES = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))
CROSS = ((0, 0, 0), *FACES)


def offsets(steps) -> Column:
    """An array of steps, for explode."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("di", "dj", "dk"), s, strict=True)]) for s in steps])


def time_merge(mask: DataFrame) -> DataFrame:
    """Voxels that are in the mask at any time."""
    return mask.select(*KEY).distinct()


def unique_labels(seg: DataFrame) -> DataFrame:
    """Labels other than 0 per case, sorted."""
    return seg.where("label <> 0").groupBy("case_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def mask_bbox(mask: DataFrame, meta: DataFrame, pad: int = 0) -> DataFrame:
    """Box of each case's mask, padded, inside the volume; the whole volume where the mask is empty.

    meta: case_id, dims (array of three sizes).  Bounds are inclusive.
    """
    found = mask.groupBy("case_id").agg(*[f(c).alias(f"{n}_{c}") for c in "ijk" for n, f in (("lo", F.min), ("hi", F.max))])
    both = meta.select("case_id", "dims").join(found, "case_id", "left")
    lo = [F.coalesce(F.greatest(F.col(f"lo_{c}") - pad, F.lit(0)), F.lit(0)).cast("int").alias(f"lo_{c}") for c in "ijk"]
    hi = [F.coalesce(F.least(F.col(f"hi_{c}") + pad, F.col("dims")[n] - 1), F.col("dims")[n] - 1).cast("int").alias(f"hi_{c}") for n, c in enumerate("ijk")]
    return both.select("case_id", *lo, *hi)


def crop(volume: DataFrame, bbox: DataFrame) -> DataFrame:
    """Voxels inside their case's box, counted from its corner.  One row per case on the right: Spark broadcasts it."""
    inside = volume.join(bbox, "case_id").where(" AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in "ijk"))
    return inside.withColumns({c: F.col(c) - F.col(f"lo_{c}") for c in "ijk"}).drop(*[f"{n}_{c}" for n in ("lo", "hi") for c in "ijk"])


def dilate(mask: DataFrame, bounds: DataFrame | None = None, steps=CROSS) -> DataFrame:
    """Voxels within one step of the mask.  bounds (as of mask_bbox) keeps the result inside a box per case."""
    moved = mask.select(*KEY, F.explode(offsets(steps)).alias("s")).select("case_id", *[(F.col(c) + F.col(f"s.d{c}")).alias(c) for c in "ijk"]).distinct()
    return moved if bounds is None else moved.join(bounds, "case_id").where(" AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in "ijk")).select(*KEY)


def erode(mask: DataFrame, steps=CROSS) -> DataFrame:
    """Voxels all of whose steps stay in the mask; outside counts as empty."""
    moved = mask.select(*KEY, F.explode(offsets(steps)).alias("s")).select("case_id", *[(F.col(c) + F.col(f"s.d{c}")).alias(c) for c in "ijk"])
    return moved.groupBy(*KEY).count().where(F.col("count") == len(steps)).join(mask.select(*KEY), list(KEY), "left_semi").select(*KEY)


def close_mask(mask: DataFrame, bounds: DataFrame) -> DataFrame:
    """Dilation inside the boxes, then erosion: borders of a tight box erode, as outside counts as empty."""
    return erode(dilate(mask, bounds))


def open_mask(mask: DataFrame, bounds: DataFrame) -> DataFrame:
    return dilate(erode(mask), bounds)


def component_sizes(components: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """components(case_id, i, j, k, component): voxels, volume and box of each."""
    cell = spacing[0] * spacing[1] * spacing[2]
    box = [f(c).alias(f"{n}_{c}") for c in "ijk" for n, f in (("lo", F.min), ("hi", F.max))]
    return components.groupBy("case_id", "component").agg(F.count("*").alias("voxels"), *box).withColumn("volume", F.col("voxels") * F.lit(cell))


def drop_small_components(components: DataFrame, least: float, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Without components whose volume is below least."""
    small = component_sizes(components, spacing).where(F.col("volume") < least).select("case_id", "component")
    return components.join(small, ["case_id", "component"], "left_anti")


def largest_component(components: DataFrame) -> DataFrame:
    """Each case's largest component; at a tie the lowest number."""
    sizes = components.groupBy("case_id", "component").count()
    best = sizes.groupBy("case_id").agg(F.max(F.struct("count", -F.col("component"))).alias("b"))
    return components.join(best.select("case_id", (-F.col("b.col2")).alias("component")), ["case_id", "component"], "left_semi")


def boundary_faces(mask: DataFrame) -> DataFrame:
    """Faces between a voxel of the mask and one that is not: the voxel and the outward axis and side."""
    steps = mask.select(*KEY, F.explode(offsets(FACES)).alias("s"))
    near = steps.select(*KEY, "s", *[(F.col(c) + F.col(f"s.d{c}")).alias(f"n{c}") for c in "ijk"])
    inside = mask.select("case_id", *[F.col(c).alias(f"n{c}") for c in "ijk"])
    open_ = near.join(inside, ["case_id", "ni", "nj", "nk"], "left_anti")
    axis = F.when(F.col("s.di") != 0, 0).when(F.col("s.dj") != 0, 1).otherwise(2)
    side = F.col("s.di") + F.col("s.dj") + F.col("s.dk")
    return open_.select(*KEY, axis.cast("int").alias("axis"), side.cast("int").alias("side"))


def face_corners(faces: DataFrame) -> DataFrame:
    """The four lattice corners of each face, with the face's outward normal."""
    rows = faces.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in product((0, 1), (0, 1))])).alias("c"))
    ahead = F.when(F.col("side") > 0, 1).otherwise(0)
    place = {
        "i": F.when(F.col("axis") == 0, ahead).otherwise(F.col("c.a")),
        "j": F.when(F.col("axis") == 1, ahead).when(F.col("axis") == 0, F.col("c.a")).otherwise(F.col("c.b")),
        "k": F.when(F.col("axis") == 2, ahead).otherwise(F.col("c.b")),
    }
    normal = [F.when(F.col("axis") == n, F.col("side")).otherwise(0).cast("double").alias(f"n{c}") for n, c in enumerate("xyz")]
    return rows.select("case_id", *[(F.col(c) + v).cast("int").alias(f"v{c}") for c, v in place.items()], *normal)


def vertex_normals(faces: DataFrame, inward: bool = True) -> DataFrame:
    """Unit normal of each corner: the sum of its faces' normals; a zero sum stays zero."""
    total = face_corners(faces).groupBy("case_id", "vi", "vj", "vk").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    turn = -1.0 if inward else 1.0
    return total.withColumns({f"n{c}": F.when(length > 0, turn * F.col(f"n{c}") / length).otherwise(0.0) for c in "xyz"})


def face_loops(faces: DataFrame, number, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Each face with its four corners (vid, x, y, z) in turn, and outward: 1 or -1 if that turn is seen from outside or not.

    number: the vertex id of lattice place (i, j, k).
    """
    ahead = F.when(F.col("side") > 0, 1).otherwise(0)

    def corner(a: int, b: int):
        i = F.col("i") + F.when(F.col("axis") == 0, ahead).otherwise(a)
        j = F.col("j") + F.when(F.col("axis") == 1, ahead).when(F.col("axis") == 0, a).otherwise(b)
        k = F.col("k") + F.when(F.col("axis") == 2, ahead).otherwise(b)
        at = [(p * s).cast("double").alias(c) for p, s, c in zip((i, j, k), spacing, "xyz", strict=True)]
        return F.struct(number(i.cast("long"), j.cast("long"), k.cast("long")).alias("vid"), *at)

    outward = F.col("side") * F.when(F.col("axis") == 1, -1).otherwise(1)
    loop = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    return faces.select("case_id", F.struct("i", "j", "k", "axis", "side").alias("face"), loop.alias("loop"), outward.alias("outward"))


def loop_vertices(loops: DataFrame) -> DataFrame:
    return loops.select("case_id", F.explode("loop").alias("v")).select("case_id", "v.*").distinct()


def loop_edges(loops: DataFrame) -> DataFrame:
    """The sides of faces, as edges between vertices."""
    at = lambda n: F.col("loop")[n % 4]["vid"]
    sides = F.array(*[F.struct(F.least(at(n), at(n + 1)).alias("src"), F.greatest(at(n), at(n + 1)).alias("dst")) for n in range(4)])
    return loops.select("case_id", F.explode(sides).alias("e")).select("case_id", "e.*").distinct()


def loop_normals(loops: DataFrame, vertices: DataFrame, inward: bool = True) -> DataFrame:
    """Unit normals at vertices(case_id, vid, x, y, z): the sum of those of the faces around, by area; a zero sum stays zero."""
    corners = loops.select("case_id", "face", "outward", F.posexplode(F.transform("loop", lambda v: v["vid"])).alias("n", "vid"))
    placed = corners.join(vertices.select("case_id", "vid", F.struct("x", "y", "z").alias("p")), ["case_id", "vid"])
    faces = placed.groupBy("case_id", "face", "outward").agg(F.map_from_entries(F.collect_list(F.struct("n", "p"))).alias("p"))
    d, e = ([F.col("p")[b][c] - F.col("p")[a][c] for c in "xyz"] for a, b in ((0, 2), (1, 3)))
    cross = (d[1] * e[2] - d[2] * e[1], d[2] * e[0] - d[0] * e[2], d[0] * e[1] - d[1] * e[0])
    flat = faces.select("case_id", "face", *[(F.col("outward") * v).alias(f"n{c}") for v, c in zip(cross, "xyz", strict=True)])
    total = corners.join(flat, ["case_id", "face"]).groupBy("case_id", "vid").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    turn = -1.0 if inward else 1.0
    return total.withColumns({f"n{c}": F.when(length > 1e-12, turn * F.col(f"n{c}") / length).otherwise(0.0) for c in "xyz"})


def slice_at(volume: DataFrame, axis: str, at: int) -> DataFrame:
    """Axial (k), coronal (j) or sagittal (i) slice, as rows and columns of the other two."""
    rest = [c for c in "ijk" if c != axis]
    return volume.where(F.col(axis) == at).withColumnsRenamed({rest[0]: "row", rest[1]: "col"}).drop(axis)


def at_time(volume: DataFrame, t: int, times: int) -> DataFrame:
    """One time step; numbers outside [0, times) are moved to the nearest inside."""
    return volume.where(F.col("t") == min(max(0, t), times - 1))


def scatter_max(values: DataFrame, origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0), dims: DataFrame | tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """values(case_id [, t], x, y, z, value) into the nearest voxels: the largest value of each, 0 at least.

    dims: sizes of all volumes, or a table (case_id, dims).  Places outside go to the voxel of the border next to them;
    voxels without a value have no row.
    """
    from rheolake.functions.vectors import voxel_of

    per_case = isinstance(dims, DataFrame)
    rows = values.join(dims.select("case_id", "dims"), "case_id") if per_case else values
    sizes = [F.col("dims")[n] for n in range(3)] if per_case else list(dims)
    at = [voxel_of(F.col(p), F.lit(o), F.lit(s), n).alias(c) for p, o, s, n, c in zip("xyz", origin, spacing, sizes, "ijk", strict=True)]
    key = [*KEY, "t"] if "t" in values.columns else list(KEY)
    return rows.select(*[c for c in key if c not in "ijk"], *at, "value").groupBy(*key).agg(F.greatest(F.lit(0.0), F.max("value")).alias("value"))


def peak_over_time(volume: DataFrame, mask: DataFrame, value: str) -> DataFrame:
    """Largest value over time of each voxel of the mask; voxels without values get 0."""
    peak = volume.groupBy(*KEY).agg(F.max(value).alias("peak"))
    return mask.select(*KEY).join(peak, list(KEY), "left").withColumn("peak", F.coalesce("peak", F.lit(0.0)))


def mesh_values(volume: DataFrame, mask: DataFrame, dims: DataFrame, value: str) -> DataFrame:
    """Values of the volume at the corners of the mask's voxels: case_id, vi, vj, vk (lattice places) and the value.

    A corner has the value of the voxel that begins there, and one on the far border that of the border's voxel; voxels
    that the volume does not hold count as 0.  dims(case_id, dims).
    """
    corner = F.explode(offsets(product((0, 1), repeat=3))).alias("o")
    places = mask.select(*KEY, corner).select("case_id", *[(F.col(c) + F.col(f"o.d{c}")).alias(f"v{c}") for c in "ijk"]).distinct()
    cells = places.join(dims.select("case_id", "dims"), "case_id")
    cells = cells.withColumns({c: F.least(F.col(f"v{c}"), F.col("dims")[n] - 1) for n, c in enumerate("ijk")})
    found = cells.join(volume.select(*KEY, F.col(value).alias("value")), list(KEY), "left")
    return found.select("case_id", "vi", "vj", "vk", F.coalesce("value", F.lit(0.0)).alias("value"))


def is_static(mask: DataFrame, times: DataFrame) -> DataFrame:
    """Whether each case's mask is the same at all its times.  mask(case_id, i, j, k, t), times(case_id, times)."""
    seen = mask.groupBy(*KEY).agg(F.count_distinct("t").alias("n"))
    return seen.join(times, "case_id").groupBy("case_id").agg(F.bool_and(F.col("n") == F.col("times")).alias("static"))


def color_limits(volume: DataFrame, value: str) -> DataFrame:
    """Symmetric limits per case: the largest absolute value, 1e-6 at least."""
    v = F.col(value)
    return volume.groupBy("case_id").agg(F.greatest(F.max(F.abs(v)), F.lit(1e-6)).alias("limit"))


def trilinear(volume: DataFrame, points: DataFrame, value: str = "val") -> DataFrame:
    """points(case_id, point_id, x, y, z in voxel units): interpolated values, outside counts as 0.

    Eight corners of a point are joined by their voxel, so the volume is shuffled once and never copied.
    """
    corner = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "c"), s, strict=True)]) for s in product((0, 1), repeat=3)]))
    near = points.select("*", *[F.floor(p).cast("int").alias(f"f{p}") for p in "xyz"], corner.alias("o"))
    weight = None
    for p, o in zip("xyz", "abc", strict=True):
        part = F.when(F.col(f"o.{o}") == 1, F.col(p) - F.col(f"f{p}")).otherwise(1 - (F.col(p) - F.col(f"f{p}")))
        weight = part if weight is None else weight * part
    rows = near.select("case_id", "point_id", *[(F.col(f"f{p}") + F.col(f"o.{o}")).alias(c) for p, o, c in zip("xyz", "abc", "ijk", strict=True)], weight.alias("w"))
    values = rows.join(volume.select(*KEY, F.col(value).alias("v")), list(KEY), "left")
    return values.groupBy("case_id", "point_id").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("value"))


def probe(volume: DataFrame, points: DataFrame, fields: list[str], origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Values of the cell that contains each point(case_id, ..., x, y, z); 0 outside."""
    at = {c: F.floor((F.col(p) - o) / s).cast("int") for c, p, o, s in zip("ijk", "xyz", origin, spacing, strict=True)}
    found = points.withColumns(at).join(volume.select(*KEY, *fields), list(KEY), "left")
    return found.withColumns({f: F.coalesce(f, F.lit(0.0)) for f in fields}).drop("i", "j", "k")


def content(volume: DataFrame, name: str) -> DataFrame:
    """One scalar view: flow_x, flow_y, flow_z, magnitude, speed, angiogram (magnitude times speed), wss or tke."""
    from rheolake.functions.signal import speed

    fast = speed(F.col("vx"), F.col("vy"), F.col("vz"))
    views = {"flow_x": "vx", "flow_y": "vy", "flow_z": "vz", "magnitude": "mag", "wss": "wss", "tke": "tke"}
    value = F.col(views[name]) if name in views else {"speed": fast, "angiogram": F.col("mag") * fast}[name]
    return volume.select(*[c for c in (*KEY, "t") if c in volume.columns], value.alias("value"))


def keep_labels(seg: DataFrame, labels: list[int] | None = None) -> DataFrame:
    """seg with some labels only; without a list it stays as it is."""
    return seg if not labels else seg.where(F.col("label").isin(labels))
