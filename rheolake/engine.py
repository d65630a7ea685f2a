"""The steps over all cases at once.  A step asked for makes what it needs first, and each is made once."""

from __future__ import annotations

import copy
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rheolake import documents
from rheolake.config import EngineConfig
from rheolake.operators import bricks, edit, graph, kernels, oblique, planes, polygons, polyline, rounds, surface, voxel
from rheolake.operators.guard import guarded, split
from rheolake.sources.cases import mask_at_times
from rheolake.storage import discard, materialize


def lattice_number(i, j, k, side: int = 100_000):
    """One number per place of a lattice of up to side places each way."""
    i, j, k = (F.col(c) if isinstance(c, str) else c for c in (i, j, k))
    return i.cast("long") + side * (j.cast("long") + side * k.cast("long"))


#: Steps that follow from the planes: an engine whose planes moved makes them anew, and takes over all others.
OF_PLANES = ("planes", "cut", "series", "metrics", "qc", "plane_seeds", "plane_streamlines")
#: Cases named in a filter, which scans prune partitions and row groups by; more are joined.
NAMED_CASES = 1_000


class Engine:
    """seg(case_id, i, j, k, t, label), flow(case_id, i, j, k, t, vx, vy, vz [, tke]), meta(case_id, dims).

    saved(case_id, plane_index, cx .. cz, nx .. nz): planes of an earlier run; cases that have some take these, put on the
    paths of now, and make none of their own.
    """

    def __init__(self, seg: DataFrame, flow: DataFrame, meta: DataFrame, config: EngineConfig | None = None, saved: DataFrame | None = None):
        self.seg, self.meta, self.config, self.saved = seg, meta, config or EngineConfig(), saved
        self._notes: list[DataFrame] = []
        self._written: list[DataFrame] = []
        self._moved: tuple[Engine, DataFrame, DataFrame, DataFrame] | None = None
        self.whole_flow = flow
        in_mask = seg.where("label > 0").select("case_id", "i", "j", "k").distinct()
        self.flow = flow.join(in_mask, ["case_id", "i", "j", "k"], "left_semi")

    # ------------------------------------------------------------------------------------------------------------- steps

    def _kept(self, df: DataFrame) -> DataFrame:
        """What several later steps use is written to the shared folder once, which also keeps plans small."""
        found = materialize(df, "step")
        self._written.append(found)
        return found

    def close(self) -> None:
        """Delete what the steps have written; no table of this engine, nor of one moved from it, may be read any more."""
        while self._written:
            discard(self._written.pop())

    def _guard(self, step: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A grouped kernel's rows, written.  Groups that raised are noted, and their cases go no further from here."""
        with guarded():
            found = self._kept(make())
        rows, notes = split(found)
        case = "case_id.case_id" if isinstance(found.schema["case_id"].dataType, StructType) else "case_id"
        self._notes.append(notes.select(F.col(case).alias("case_id"), F.lit(step).alias("step"), "error", "seconds"))
        bad = self._notes[-1].where("error IS NOT NULL").select("case_id").distinct()
        if bad.isEmpty():
            return rows
        own = F.col("case_id.case_id" if case != "case_id" else "case_id")
        return rows.withColumn("_case", own).join(bad.withColumnRenamed("case_id", "_case"), "_case", "left_anti").drop("_case")

    @property
    def notes(self) -> DataFrame:
        """case_id, step, error, seconds of the groups that kernels have handled so far."""
        found = self.meta.select("case_id", F.lit("").alias("step"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("seconds")).where("false")
        for one in self._notes:
            found = found.unionByName(one)
        return found

    def _components(self, mask: DataFrame, connectivity: int = 6, step: str = "components") -> DataFrame:
        if side := self.config.brick:
            return self._kept(bricks.connected_components(mask, connectivity, side))
        return self._guard(step, lambda: kernels.connected_components(mask, connectivity))

    def _skeletonize(self, components: DataFrame) -> DataFrame:
        if side := self.config.brick:  # a halo of half a brick at most
            return bricks.skeletonize(components, side, max(1, min(6, side // (2 * bricks.FACE_HALO))))
        return self._guard("skeleton", lambda: kernels.skeletonize(components))

    def _streamlines(self, step: str, flow: DataFrame, seeds: DataFrame, **limits: float) -> DataFrame:
        spacing = self.config.spacing
        if side := self.config.brick:
            return bricks.streamlines(flow, seeds, spacing, side=side, **limits)
        return self._guard(step, lambda: kernels.streamlines(flow, seeds, spacing, **limits))

    @cached_property
    def timed_seg(self) -> DataFrame:
        """The segmentation at each time of the flow: one of a single time holds at all of them."""
        return mask_at_times(self.seg, self.flow.groupBy("case_id").agg((F.max("t") + 1).alias("times")))

    @cached_property
    def mask(self) -> DataFrame:
        """Merged over time; small components are dropped if the parameters say so.  voxel numbers lie i first."""
        merged = voxel.time_merge(self.seg.where("label > 0")).join(self.meta.select("case_id", "dims"), "case_id")
        number = F.col("i") + F.col("dims")[0] * (F.col("j") + F.col("dims")[1].cast("long") * F.col("k"))
        rows = merged.select("case_id", "i", "j", "k", number.cast("long").alias("voxel"))
        p = self.config.skeleton
        if not p.remove_small:
            return self._kept(rows)
        return self._kept(voxel.drop_small_components(self._components(rows), p.min_volume, self.config.spacing).drop("component"))

    @cached_property
    def prepared(self) -> DataFrame:
        """The mask after closing, opening and smoothing, each component in its own box."""
        p = self.config.skeleton
        rows = self._components(self.mask)
        if p.closing or p.opening:
            box = voxel.component_sizes(rows).select(F.struct("case_id", "component").alias("case_id"), *[f"{n}_{c}" for n in ("lo", "hi") for c in "ijk"])
            own = rows.select(F.struct("case_id", "component").alias("case_id"), "i", "j", "k")
            own = voxel.close_mask(own, box) if p.closing else own
            own = voxel.open_mask(own, box) if p.opening else own
            rows = own.select("case_id.case_id", "case_id.component", "i", "j", "k")
        if p.gaussian:
            return self._kept(self._guard("prepared", lambda: kernels.gaussian_mask(rows, p.sigma)).distinct())
        return self._kept(rows.select("case_id", "i", "j", "k").distinct())

    @cached_property
    def skeleton(self) -> DataFrame:
        """node_id by voxel number; x, y, z are voxel numbers times the spacing."""
        numbered = self.prepared.withColumn("voxel", lattice_number("i", "j", "k"))
        thin = self._skeletonize(self._components(numbered, 26)).select("case_id", "i", "j", "k")
        node = lattice_number("i", "j", "k")
        at = [(F.col(c) * s).alias(p) for c, s, p in zip("ijk", self.config.spacing, "xyz", strict=True)]
        return self._kept(thin.select("case_id", node.alias("node_id"), "i", "j", "k", *at))

    @cached_property
    def edges(self) -> DataFrame:
        every = self._kept(graph.lattice_edges(self.skeleton))
        marked = every.join(graph.triangle_edges(every).withColumn("in_triangle", F.lit(True)), ["case_id", "src", "dst"], "left").fillna(False, ["in_triangle"])
        if self.config.brick:
            return self._kept(rounds.prune_triangles(marked))
        return self._guard("edges", lambda: kernels.prune_triangles(marked))

    @cached_property
    def raw_paths(self) -> DataFrame:
        chains = self._kept(rounds.trace_paths(self.edges)) if self.config.brick else self._guard("raw_paths", lambda: kernels.trace_paths(self.edges))
        points = chains.join(self.skeleton, ["case_id", "node_id"])
        at = points.select("case_id", "path_id", "seq", "x", "y", "z", "node_id", "i", "j", "k")
        total = self.flow.groupBy("case_id", "i", "j", "k").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in "xyz"])
        flow = at.join(total, ["case_id", "i", "j", "k"]).select("case_id", "path_id", "seq", "vx", "vy", "vz")
        return self._kept(polyline.orient_by_flow(at, flow).drop("i", "j", "k", "reversed", "confidence"))

    @cached_property
    def path_ends(self) -> DataFrame:
        ends = self.raw_paths.groupBy("case_id", "path_id").agg(F.min_by("node_id", "seq").alias("start_node"), F.max_by("node_id", "seq").alias("end_node"))
        return ends

    @cached_property
    def forks(self) -> DataFrame:
        return graph.forks(self.path_ends)

    @cached_property
    def path_info(self) -> DataFrame:
        return graph.path_info(self.path_ends, self.forks, polyline.chord(self.raw_paths))

    @cached_property
    def branches(self) -> DataFrame:
        """Branch label of each voxel of the mask."""
        return self._kept(graph.nearest_path_labels(self.mask, self.raw_paths, self.config.spacing))

    @cached_property
    def paths(self) -> DataFrame:
        """Interpolated and smoothed."""
        p = self.config.planes
        return self._guard("paths", lambda: kernels.smooth_paths(polyline.interpolate(self.raw_paths, p.interpolation), p.window, p.order))

    @cached_property
    def planes(self) -> DataFrame:
        p = self.config.planes
        found = polyline.centre_planes(self.paths) if p.centre_only else polyline.spaced_planes(self.paths, p.start, p.end, p.distance)
        if self.saved is not None:
            ask = self.saved.select("case_id", "plane_index", *[f"{n}{c}" for n in "cn" for c in "xyz"])
            kept = polyline.reproject_planes(ask, self.paths).where("path_id IS NOT NULL")
            found = found.join(ask.select("case_id").distinct(), "case_id", "left_anti").unionByName(kept)
        return self._kept(planes.forward_signs(self._kept(found), self.paths))

    def _cut(self, heads: DataFrame, mask: DataFrame, branches: DataFrame) -> DataFrame:
        s = self.config.spacing
        every = planes.cut_voxels(heads.select("case_id", "plane_index", "path_id", *[f"{n}{c}" for n in "cn" for c in "xyz"]), mask.drop("voxel"), s)
        branch = branches.withColumnRenamed("label", "branch")
        # a plane without a label has that of the voxel at its centre
        at = [F.floor(F.col(f"c{p}") / e).cast("int").alias(c) for p, e, c in zip("xyz", s, "ijk", strict=True)]
        labelled = heads.select("case_id", "plane_index", "label", *at).join(branch, ["case_id", "i", "j", "k"], "left")
        own = labelled.select("case_id", "plane_index", F.when(F.col("label") > 0, F.col("label")).otherwise(F.col("branch")).alias("label"))
        kept = every.join(branch, ["case_id", "i", "j", "k"]).join(own, ["case_id", "plane_index"]).where("branch = label").drop("branch", "label")
        return self._guard("cut", lambda: kernels.nearest_region(polygons.polygons(kept, s).drop("corners")))

    @cached_property
    def cut(self) -> DataFrame:
        """What planes cut from voxels of their own branch, in the region nearest their centre: area, centroid (px, py, pz)."""
        return self._cut(self.planes, self.mask, self.branches)

    @property
    def polygons(self) -> DataFrame:
        """The cut with the corners of its polygons."""
        return polygons.polygons(self.cut.drop("px", "py", "pz"), self.config.spacing)

    def _series(self, heads: DataFrame, cut: DataFrame, flow: DataFrame) -> DataFrame:
        samples = planes.flow_samples(cut, flow)
        return self._kept(planes.plane_series(samples, heads.select("case_id", "plane_index", "forward_sign"), flow.select("case_id", "t").distinct()))

    @cached_property
    def series(self) -> DataFrame:
        return self._series(self.planes, self.cut, self.flow)

    def move_planes(self, asked: DataFrame) -> Engine:
        """An engine in which asked(case_id, plane_index, some of cx .. cz and nx .. nz) has moved planes; this one stays as it is.

        Planes that move less than a tolerance (edit.moved_planes) count as unmoved.  Cuts and series are made for moved
        planes only, from the rows of their cases; those of the others are taken over, and so is every step that
        planes do not enter.  Consistency is a pass over the planes' cycle metrics.  Moves of moved planes take the place
        of the former ones, so plans do not grow with the number of moves.  The rows are those of a run from the start.
        """
        key = ["case_id", "plane_index"]
        base, *before = self._moved or (self,)
        _ = base.cut, base.series
        raw = self.planes.drop("normal_tangent_cos", "forward_sign_source", "forward_sign")
        fresh = self._kept(edit.moved_planes(raw, asked, self.config.spacing))
        cases = [r["case_id"] for r in fresh.select("case_id").distinct().limit(NAMED_CASES + 1).collect()]
        if not cases:
            return self
        named = fresh.select("case_id").distinct()
        own = lambda df: df.where(F.col("case_id").isin(cases)) if len(cases) <= NAMED_CASES else df.join(named, "case_id", "left_semi")
        new = copy.copy(self)
        new.__dict__ = {k: v for k, v in self.__dict__.items() if k not in OF_PLANES}
        heads = self._kept(planes.forward_signs(fresh, own(self.paths)))
        cut = self._cut(heads, own(self.mask), own(self.branches))
        series = self._series(heads, cut, own(self.flow))
        made = [heads.select(*base.planes.columns), cut.select(*base.cut.columns), series.select(*base.series.columns)]
        if before:
            made = [self._kept(edit.remove_rows(old, heads, key).unionByName(now)) for old, now in zip(before, made, strict=True)]
        new._moved = (base, *made)
        there = made[0].select(*key)
        both = lambda old, now: edit.remove_rows(old, there, key).unionByName(now)
        new.planes, new.cut, new.series = (both(old, now) for old, now in zip((base.planes, base.cut, base.series), made, strict=True))
        return new

    @property
    def beats(self):
        """Milliseconds of a beat: each case's own where meta has them."""
        if "rr" not in self.meta.columns:
            return self.config.rr
        return self.meta.select("case_id", F.coalesce("rr", F.lit(self.config.rr)).alias("rr"))

    @cached_property
    def metrics(self) -> DataFrame:
        rows = planes.cycle_metrics(self.series, self.beats).join(self.planes.select("case_id", "plane_index", "path_id", "label", "distance"), ["case_id", "plane_index"])
        path_ic = planes.path_consistency(rows)
        return planes.attach_consistency(rows, path_ic, self.forks, planes.fork_consistency(self.forks, path_ic))

    @cached_property
    def qc(self) -> DataFrame:
        rows = planes.cycle_metrics(self.series, self.beats).join(self.planes.select("case_id", "plane_index", "path_id"), ["case_id", "plane_index"])
        return planes.fork_consistency(self.forks, planes.path_consistency(rows)).join(self.forks, ["case_id", "node"])

    @property
    def documents(self) -> DataFrame:
        """One row a case: the nested metrics of its planes and the agreement of flow at its forks."""
        return documents.plane_documents(self.planes, self.metrics, self.series, self.qc, self.path_info)

    @cached_property
    def wall(self) -> DataFrame:
        """Wall shear stress at the smoothed surface's corners, by time: each time's own mask, and its surface's own normals."""
        p, s = self.config.wall, self.config.spacing
        keyed = lambda df: df.withColumn("case_id", F.struct("case_id", "t"))
        mask = keyed(self.timed_seg.where("label > 0")).select("case_id", "i", "j", "k").distinct()
        loops = self._kept(voxel.face_loops(voxel.boundary_faces(mask), lattice_number, s))
        smooth = self._guard("wall", lambda: kernels.smooth_surface(voxel.loop_vertices(loops), voxel.loop_edges(loops), p.smoothing))
        at = smooth.join(voxel.loop_normals(loops, smooth), ["case_id", "vid"])
        found = surface.wall_shear_stress(at, keyed(self.flow).drop("t"), p.viscosity, p.inward, p.parabolic, p.no_slip, s)
        return self._kept(found.join(smooth, ["case_id", "vid"]).select("case_id.case_id", "case_id.t", "vid", "x", "y", "z", "wss"))

    @cached_property
    def wss_volume(self) -> DataFrame:
        """The surface's stress in the voxels next to its corners, by time: the largest of each; other voxels have no row."""
        return voxel.scatter_max(self.wall.withColumnRenamed("wss", "value"), spacing=self.config.spacing, dims=self.meta)

    @cached_property
    def tke_time(self) -> DataFrame:
        """Turbulent energy inside each time's own mask."""
        here = self.timed_seg.where("label > 0").select("case_id", "i", "j", "k", "t").distinct()
        return self.flow.join(here, ["case_id", "i", "j", "k", "t"], "left_semi").select("case_id", "i", "j", "k", "t", "tke")

    @cached_property
    def tke_peak(self) -> DataFrame:
        return voxel.peak_over_time(self.tke_time, self.mask, "tke")

    @cached_property
    def tke_mesh(self) -> DataFrame:
        """The peak at the corners of the mask's voxels."""
        return voxel.mesh_values(self.tke_peak, self.mask, self.meta, "peak")

    @cached_property
    def seeds(self) -> DataFrame:
        """Voxels' centres, chosen anew at each time."""
        p = self.config.streamlines
        times = self.mask.drop("voxel").join(self.flow.select("case_id", "t").distinct(), "case_id")
        found = surface.sample_seeds(times, p.ratio, p.seed, p.least_seeds)
        return found.select("case_id", "t", "line_id", *[(F.col(c) + 0.5).alias(q) for c, q in zip("ijk", "xyz", strict=True)])

    @cached_property
    def streamlines(self) -> DataFrame:
        p = self.config.streamlines
        return self._streamlines("streamlines", self.flow, self.seeds, max_steps=p.max_steps, least_speed=p.least_speed)

    @cached_property
    def plane_seeds(self) -> DataFrame:
        """Centroids of the planes' polygons, chosen anew at each time; line_id counts through the planes of a case."""
        p = self.config.streamlines
        found = surface.plane_seeds(self.cut, p.ratio, p.seed, p.least_seeds, self.flow.select("case_id", "t").distinct(), self.config.spacing)
        number = (F.col("plane_index").cast("long") * 1_000_000 + F.col("line_id")).alias("line_id")
        return found.select("case_id", "t", number, "x", "y", "z")

    @cached_property
    def plane_streamlines(self) -> DataFrame:
        p = self.config.streamlines
        return self._streamlines("plane_streamlines", self.flow, self.plane_seeds, max_steps=p.max_steps, least_speed=p.least_speed)

    # ------------------------------------------------------------------------------------------------------------- views

    STEPS = ("mask", "prepared", "skeleton", "edges", "raw_paths", "path_info", "forks", "branches", "paths", "planes", "cut", "polygons", "series", "metrics", "qc", "wall", "wss_volume", "tke_time", "tke_peak", "tke_mesh", "seeds", "streamlines", "plane_seeds", "plane_streamlines")

    def step(self, name: str) -> DataFrame:
        if name not in self.STEPS:
            raise ValueError(f"unknown step {name!r}")
        return getattr(self, name)

    def view(self, name: str, t: int | None = None) -> DataFrame:
        """A step's table, at one time if it has times; registered as a temporary view of its name."""
        df = self.step(name)
        if t is not None and "t" in df.columns:
            df = df.where(F.col("t") == t)
        df.createOrReplaceTempView(name)
        return df

    def plane_view(self, t: int | None = None, half: int | None = None) -> DataFrame:
        """Velocity along each plane's normal on its own grid (value, cm/s), and how much of a place is mask (inside, 0 to 1).

        Flow outside of the mask is shown too.  Without t all times of the flow are.
        """
        grid = oblique.oblique_grid(self.planes, self.meta, half, self.config.spacing)
        flow = self.whole_flow if t is None else self.whole_flow.where(F.col("t") == t)
        timed = grid.join(flow.select("case_id", "t").distinct(), "case_id")
        value = oblique.through_plane(timed, flow)
        inside = oblique.oblique_values(grid, self.mask.select("case_id", "i", "j", "k", F.lit(1.0).alias("inside")), ["inside"])
        return value.join(inside.select("case_id", "plane_index", "row", "col", "inside"), ["case_id", "plane_index", "row", "col"])
