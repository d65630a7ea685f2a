"""Cross-section planes: area of each cut voxel, flow through a plane over time, cycle metrics, consistency."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rheolake.functions.vectors import dot, unit_or_x, vec

FLAT = 1e-6


def cut_area(normal: tuple[Column, Column, Column], offset: Column, sides: tuple[Column | float, ...]) -> Column:
    """Area of a plane inside a box.  offset: distance along the unit normal from the box's low corner to the plane.

    Closed form over the axes that the normal touches: with m of them the area is the product of the other sides over
    (m - 1)! times the product of their |n|, times the alternating sum of max(0, d - |n| s over a subset) ** (m - 1);
    d is the offset counted from the corner where the normal starts.  A face on the plane belongs to the box above it.
    """
    a = [F.abs(n) for n in normal]
    s = [F.lit(x) if not isinstance(x, Column) else x for x in sides]
    d = offset
    for n, ai, si in zip(normal, a, s, strict=True):
        d = d + F.when(n < 0, ai * si).otherwise(0.0)
    out: Column = F.lit(0.0)
    for active in product((False, True), repeat=3):
        m = sum(active)
        if not m:
            continue
        on = [n for n in range(3) if active[n]]
        is_this = None
        for n in range(3):
            c = (a[n] > FLAT) if active[n] else (a[n] <= FLAT)
            is_this = c if is_this is None else is_this & c
        flat: Column = F.lit(1.0)
        for n in range(3):
            if not active[n]:
                flat = flat * s[n]
        if m == 1:
            at = d / a[on[0]]
            area = F.when((at >= 0) & (at < s[on[0]]), flat).otherwise(0.0)
        else:
            below = a[on[0]] * a[on[1]] * (a[on[2]] * 2.0 if m == 3 else 1.0)
            total: Column = F.lit(0.0)
            for chosen in product((0, 1), repeat=m):
                reach = d
                for bit, n in zip(chosen, on, strict=True):
                    if bit:
                        reach = reach - a[n] * s[n]
                term = F.greatest(reach, F.lit(0.0))
                total = total + F.lit((-1.0) ** sum(chosen)) / below * (term if m == 2 else term * term)
            area = flat * F.greatest(total, F.lit(0.0))
        out = F.when(is_this, area).otherwise(out)
    return out


#: Voxels along a side of the cubes that planes are held against first.
CUBE = 16


def cut_voxels(planes: DataFrame, mask: DataFrame, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Voxels that planes cut, with the area of each: planes(case_id, plane_index, cx..cz, nx..nz), mask(case_id, i, j, k).

    Planes of a case meet the cubes that its voxels lie in, and the voxels of those cubes only that they reach.  Centres,
    spacing and origin that are decimals or integers are subtracted as such, without a binary fraction's error.
    """
    n = unit_or_x(vec("n"))
    flat = planes.select("case_id", "plane_index", "cx", "cy", "cz", *[v.alias(f"n{c}") for v, c in zip(n, "xyz", strict=True)])
    place = ["case_id", "bi", "bj", "bk"]
    placed = mask.withColumns({f"b{c}": F.floor(F.col(c) / CUBE).cast("int") for c in "ijk"})
    middle = [(F.col(f"b{c}") + 0.5) * CUBE * s + o for c, s, o in zip("ijk", spacing, origin, strict=True)]
    gap = F.abs(dot(vec("n"), (F.col("cx") - middle[0], F.col("cy") - middle[1], F.col("cz") - middle[2])))
    reach = sum(F.abs(F.col(f"n{c}")) * s for c, s in zip("xyz", spacing, strict=True))
    hit = placed.select(*place).distinct().join(flat, "case_id").where(gap <= reach * (CUBE / 2 + 1))
    low = [F.col(c) * s + o for c, s, o in zip("ijk", spacing, origin, strict=True)]
    offset = dot(vec("n"), (F.col("cx") - low[0], F.col("cy") - low[1], F.col("cz") - low[2]))
    near = placed.join(hit, place).withColumn("offset", offset).where(F.abs("offset") <= reach)
    return near.withColumn("area", cut_area(vec("n"), F.col("offset"), spacing)).where("area > 0").drop("offset", "bi", "bj", "bk").withColumns({c: F.col(c).cast("double") for c in ("cx", "cy", "cz")})


def flow_samples(cut: DataFrame, flow: DataFrame, branch: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Area and through-plane velocity of each cut voxel at each time; with branches, of the plane's own branch only.

    The cut is made once, on the merged mask, and joined to all times.
    """
    key = ["case_id", "i", "j", "k"]
    rows = cut
    if branch is not None and labels is not None:
        own = labels.select("case_id", "plane_index", F.col("label").alias("own"))
        rows = rows.join(branch, key).join(own, ["case_id", "plane_index"]).where("label = own")
    through = F.col("vx") * F.col("nx") + F.col("vy") * F.col("ny") + F.col("vz") * F.col("nz")
    return rows.join(flow, key).select("case_id", "plane_index", "t", "area", through.alias("proj"))


def plane_series(samples: DataFrame, planes: DataFrame, times: DataFrame) -> DataFrame:
    """Sums of each plane and time, zero where nothing is cut: area, flow in total, forward and reverse, peaks.

    samples(case_id, plane_index, t, area, proj); planes(case_id, plane_index, forward_sign); times(case_id, t).
    """
    own = samples.join(planes, ["case_id", "plane_index"]).withColumn("along", F.col("proj") * F.col("forward_sign"))
    part = F.col("area") * F.col("along")
    ahead, back = F.col("along") > 0, F.col("along") < 0
    sums = own.groupBy("case_id", "plane_index", "t").agg(
        F.sum("area").alias("area"),
        F.sum(part).alias("flow_signed"),
        F.sum(F.when(ahead, part)).alias("flow_forward"),
        F.sum(F.when(back, -part)).alias("flow_reverse"),
        F.max(F.abs("proj")).alias("peak"),
        F.max(F.when(ahead, F.col("along"))).alias("peak_forward"),
        F.max(F.when(back, -F.col("along"))).alias("peak_reverse"),
    )
    every = planes.join(times, "case_id").select("case_id", "plane_index", "t")
    out = every.join(sums, ["case_id", "plane_index", "t"], "left")
    return out.fillna(0, ["area", "flow_signed", "flow_forward", "flow_reverse", "peak", "peak_forward", "peak_reverse"])


def cycle_metrics(series: DataFrame, rr: float | DataFrame = 1000.0) -> DataFrame:
    """One row per plane: mean flow (mL/s from cm/s times mm2), volumes per beat, peaks, mean velocities, reflux.

    rr: milliseconds of a beat, of all cases or as a table (case_id, rr).
    """
    mean = lambda c: F.sum(c) / F.count("*") / 100.0
    sums = series.groupBy("case_id", "plane_index").agg(
        F.count("*").alias("times"), mean("flow_signed").alias("flow_signed"), mean("flow_forward").alias("flow_forward"), mean("flow_reverse").alias("flow_reverse"),
        F.max("peak").alias("peak"), F.max("peak_forward").alias("peak_forward"), F.max("peak_reverse").alias("peak_reverse"),
        (F.sum("area") / F.count("*")).alias("area"),
        F.avg(F.when(F.col("area") > 0, F.col("flow_signed") / F.col("area")).otherwise(0.0)).alias("mean_velocity_signed"),
    )
    beat = F.lit(rr / 1000.0) if not isinstance(rr, DataFrame) else F.col("rr") / 1000.0
    if isinstance(rr, DataFrame):
        sums = sums.join(rr.select("case_id", "rr"), "case_id")
    return sums.select(
        "case_id", "plane_index", "times", "area", "flow_signed", "flow_forward", "flow_reverse", "peak", "peak_forward", "peak_reverse", "mean_velocity_signed",
        (F.col("flow_signed") * beat).alias("net_signed"), F.abs(F.col("flow_signed") * beat).alias("net"),
        (F.col("flow_forward") * beat).alias("net_forward"), (F.col("flow_reverse") * beat).alias("net_reverse"),
        F.when(F.col("flow_forward") > 1e-12, F.col("flow_reverse") / F.col("flow_forward")).otherwise(0.0).alias("reflux"),
    )


def forward_signs(planes: DataFrame, points: DataFrame, least: float = 0.1) -> DataFrame:
    """Sign of each plane's normal against its path's direction, and where it comes from.

    The path's direction at the stored distance decides, unless the plane's centre is nearer to another place of the
    path than a tolerance (twice the median step, 1 at least) allows; then the direction there.  A plane nearly along
    its path has no sign of its own and takes +1.
    """
    from rheolake.operators import polyline

    steps = polyline.segments(points).withColumn("size", F.col("next_cum") - F.col("cum")).where("size > 1e-12")
    tolerance = steps.groupBy("case_id", "path_id").agg(F.greatest(F.lit(1.0), 2.0 * F.median("size")).alias("tol"))
    stored = polyline.points_at_distance(points, planes.select("case_id", "path_id", F.col("plane_index").alias("target_id"), "distance"))
    centre = planes.select("case_id", "path_id", F.col("plane_index").alias("query_id"), *[F.col(f"c{c}").alias(f"p{c}") for c in "xyz"])
    nearest = polyline.project_points(points, centre).select("case_id", "path_id", F.col("query_id").alias("plane_index"), F.col("segment").alias("near_segment"), F.col("distance").alias("near_error"))
    rows = planes.join(stored.select("case_id", "path_id", F.col("target_id").alias("plane_index"), "segment", *[F.col(c).alias(f"s{c}") for c in "xyz"]), ["case_id", "path_id", "plane_index"], "left")
    rows = rows.join(nearest, ["case_id", "path_id", "plane_index"], "left").join(tolerance, ["case_id", "path_id"], "left")
    gap = F.sqrt(sum((F.col(f"c{c}") - F.col(f"s{c}")) * (F.col(f"c{c}") - F.col(f"s{c}")) for c in "xyz"))
    use_stored = gap <= F.greatest(F.col("tol"), F.col("near_error") + F.col("tol"))
    rows = rows.withColumn("at", F.when(use_stored, F.col("segment")).otherwise(F.col("near_segment")))
    tangent = polyline.tangents(points).select("case_id", "path_id", F.col("segment").alias("at"), "tx", "ty", "tz", "kind")
    found = rows.join(tangent, ["case_id", "path_id", "at"], "left")
    n = unit_or_x(vec("n"))
    cos = F.coalesce(dot(n, vec("t")), F.lit(0.0))
    known = F.col("kind").isNotNull() & (F.col("kind") != "degenerate")
    source = F.when(known & (F.abs(cos) >= least), "flow_tangent").when(known, "geometry_fallback").otherwise("none")
    sign = F.when(cos < 0, -1).otherwise(1)
    return planes.join(found.select("case_id", "plane_index", cos.alias("normal_tangent_cos"), source.alias("forward_sign_source"), sign.cast("int").alias("forward_sign")), ["case_id", "plane_index"])


# --------------------------------------------------------------------------------------------------------- consistency


def path_consistency(metrics: DataFrame) -> DataFrame:
    """metrics(case_id, plane_index, path_id, net): 1 less the mean relative deviation of a path's planes, in [0, 1].

    One plane gives 1; a mean near zero gives 1 if all are near zero, else 0.
    """
    x = F.abs("net")
    mean = F.avg(x).over(Window.partitionBy("case_id", "path_id"))
    rows = metrics.withColumn("mean", mean).withColumn("off", F.abs(x - F.col("mean")))
    found = rows.groupBy("case_id", "path_id").agg(F.count("*").alias("planes"), F.first("mean").alias("mean"), F.max(x).alias("most"), F.avg("off").alias("off"))
    ic = (
        F.when(F.col("planes") <= 1, 1.0)
        .when(F.col("mean") <= 1e-12, F.when(F.col("most") <= 1e-12, 1.0).otherwise(0.0))
        .otherwise(F.least(F.greatest(1 - F.col("off") / F.col("mean"), F.lit(0.0)), F.lit(1.0)))
    )
    return found.select("case_id", "path_id", "planes", "mean", ic.alias("ic"))


def fork_consistency(forks: DataFrame, paths: DataFrame) -> DataFrame:
    """forks(case_id, node, incoming, outgoing), paths(case_id, path_id, mean): how well flow in and out agree, in [0, 1].

    A path without planes counts as 0; nothing on either side gives 1.
    """
    side = lambda name: forks.select("case_id", "node", F.explode(name).alias("path_id"), F.lit(name).alias("side"))
    rows = side("incoming").unionByName(side("outgoing")).join(paths.select("case_id", "path_id", "mean"), ["case_id", "path_id"], "left")
    total = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("mean"))), F.lit(0.0))
    sums = rows.groupBy("case_id", "node").agg(total("incoming").alias("flow_in"), total("outgoing").alias("flow_out"))
    both = F.col("flow_in") + F.col("flow_out")
    ic = F.when(both <= 1e-12, 1.0).otherwise(F.least(F.greatest(1 - 2 * F.abs(F.col("flow_in") - F.col("flow_out")) / both, F.lit(0.0)), F.lit(1.0)))
    return sums.withColumn("ic", ic)


def attach_consistency(metrics: DataFrame, path_ic: DataFrame, forks: DataFrame, fork_ic: DataFrame) -> DataFrame:
    """metrics with path_ic (1 where unknown) and the forks of its path: node, role, ic.  Incoming wins over outgoing."""
    side = lambda name: forks.select("case_id", "node", F.explode(name).alias("path_id"), F.lit(name).alias("role"))
    member = side("incoming").unionByName(side("outgoing")).groupBy("case_id", "node", "path_id").agg(F.min("role").alias("role"))
    listed = member.join(fork_ic.select("case_id", "node", "ic"), ["case_id", "node"])
    per_path = listed.groupBy("case_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("node", "role", "ic"))).alias("fork_ic"))
    out = metrics.join(path_ic.select("case_id", "path_id", F.col("ic").alias("path_ic")), ["case_id", "path_id"], "left").join(per_path, ["case_id", "path_id"], "left")
    empty = F.array().cast(per_path.schema["fork_ic"].dataType)
    return out.withColumns({"path_ic": F.coalesce("path_ic", F.lit(1.0)), "fork_ic": F.coalesce("fork_ic", empty)})


def wide_metrics(series: DataFrame, times: list[int], values: list[str]) -> DataFrame:
    """One row per plane with a column per value and time: value_t0, value_t1, ..."""
    columns = [F.max(F.when(F.col("t") == t, F.col(v))).alias(f"{v}_t{t}") for v in values for t in times]
    return series.groupBy("case_id", "plane_index").agg(*columns)


def case_timing(runs: DataFrame) -> DataFrame:
    """runs(status, seconds): cases, failures, mean and sample deviation of the seconds of good ones (0 for one)."""
    ok = F.col("status") == "ok"
    seconds = F.when(ok, F.col("seconds"))
    return runs.agg(
        F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.avg(seconds).alias("mean"), F.coalesce(F.stddev_samp(seconds), F.lit(0.0)).alias("std")
    )


def update_plane(planes: DataFrame, changed: DataFrame, metrics: DataFrame, recompute) -> DataFrame:
    """Metrics after some planes moved: those are computed anew by recompute(planes), all others are taken over.

    Consistency is a cheap pass over metrics and is run again by the caller.
    """
    moved = changed.select("case_id", "plane_index")
    return metrics.join(moved, ["case_id", "plane_index"], "left_anti").unionByName(recompute(changed))
