"""Command line: run steps over Parquet case tables and write their results."""

from __future__ import annotations

import argparse
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rheolake.config import EngineConfig, PlaneParams, SkeletonParams, StreamlineParams, WallParams


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rheolake", description=__doc__)
    p.add_argument("cases", help="folder with the tables seg, flow and meta, or with HDF5 files")
    p.add_argument("--hdf5", action="store_true", help="read HDF5 files, whose spacing and beat count instead of the options'")
    p.add_argument("--slabs", type=int, default=1, help="tasks that read one HDF5 file, by times")
    p.add_argument("--hdf5-library", default="h5py", help="the module that opens HDF5 files")
    p.add_argument("--output", "--output-dir", default="./results")
    p.add_argument("--steps", default="", help="comma-separated step names, in place of planes, metrics, wall stress and turbulent energy")
    p.add_argument("--reuse-planes", default="", help="saved plane positions, which cases that they name take instead of new planes")
    p.add_argument("--move-planes", default="", help="Parquet table of case_id, plane_index and new cx .. cz, nx .. nz: planes moved after they are placed")
    p.add_argument("--skip-derived", action="store_true", help="no wall stress and turbulent energy")
    p.add_argument("--documents", action="store_true", help="positions and metrics of planes as JSON documents, and counts of each case")
    p.add_argument("--save-pixelwise", action="store_true", help="wall stress and turbulent energy by voxel and time, with spacing and origin")
    p.add_argument("--skip-plane-metrics", action="store_true", help="no metrics of planes")
    p.add_argument("--spacing", type=float, nargs=3, default=(1.0, 1.0, 1.0))
    p.add_argument("--rr", type=float, default=1000.0)
    p.add_argument("--brick", type=int, default=0, help="cut cases into bricks of that side, for masks that no worker can hold")
    p.add_argument("--by-distance", "--plane-by-distance", action="store_true", help="evenly spaced planes instead of one in the middle of each path")
    p.add_argument("--interpolation", type=int, default=10, help="points put between two of a path before it is smoothed")
    p.add_argument("--window", type=int, default=150, help="points of the smoothing window")
    p.add_argument("--order", type=int, default=2, help="order of the smoothing polynomial")
    p.add_argument("--smoothing", type=int, default=200, help="rounds that smooth the wall's surface")
    p.add_argument("--distance", "--cross-section-dist", type=float, default=5.0)
    p.add_argument("--start", "--start-dist", type=float, default=5.0)
    p.add_argument("--end", "--end-dist", type=float, default=0.0)
    p.add_argument("--remove-small", "--remove-small-cc", action="store_true")
    p.add_argument("--min-volume", "--min-cc-volume", type=float, default=50.0)
    p.add_argument("--no-closing", action="store_true")
    p.add_argument("--opening", action="store_true")
    p.add_argument("--no-gaussian", action="store_true")
    p.add_argument("--sigma", type=float, default=0.5)
    p.add_argument("--viscosity", type=float, default=4.0)
    p.add_argument("--inward", type=float, default=0.6)
    p.add_argument("--linear", action="store_true", help="straight instead of parabolic wall profile")
    p.add_argument("--slip", action="store_true", help="no zero velocity at the wall")
    p.add_argument("--seed-ratio", type=float, default=0.02)
    p.add_argument("--least-seeds", type=int, default=50)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--max-steps", type=int, default=2000)
    p.add_argument("--least-speed", type=float, default=0.01)
    return p


def config_of(a: argparse.Namespace) -> EngineConfig:
    return EngineConfig(
        spacing=tuple(a.spacing),
        rr=a.rr,
        brick=a.brick,
        skeleton=SkeletonParams(a.remove_small, a.min_volume, not a.no_closing, a.opening, not a.no_gaussian, a.sigma),
        planes=PlaneParams(not a.by_distance, a.distance, a.start, a.end, a.interpolation, a.window, a.order),
        streamlines=StreamlineParams(a.seed_ratio, a.least_seeds, a.seed, a.max_steps, a.least_speed),
        wall=WallParams(a.viscosity, a.inward, not a.linear, not a.slip, a.smoothing),
    )


def steps_of(a: argparse.Namespace) -> list[str]:
    if a.steps:
        return [name.strip() for name in a.steps.split(",")]
    return ["planes", *([] if a.skip_plane_metrics else ["metrics", "qc"]), *([] if a.skip_derived else ["wall", "tke_peak"])]


def with_notes(status: DataFrame, notes: DataFrame) -> DataFrame:
    """status with the seconds that kernels spent on each case; a case that a kernel failed on is an error, named by step."""
    failed = F.array_join(F.sort_array(F.collect_set(F.when(F.col("error").isNotNull(), F.concat("step", F.lit(": "), "error")))), "; ")
    own = notes.groupBy("case_id").agg(failed.alias("failed"), F.sum("seconds").alias("kernel_seconds"))
    rows = status.join(own, "case_id", "left")
    broken = F.coalesce(F.col("failed") != "", F.lit(False))
    return rows.withColumns({"status": F.when(broken, "error").otherwise(F.col("status")), "error": F.when(broken, F.col("failed")).otherwise(F.col("error"))}).drop("failed")


def load(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """seg, flow, meta, and the status of files that could not be read (None for tables)."""
    if not a.hdf5:
        return *(spark.read.parquet(f"{a.cases}/{name}") for name in ("seg", "flow", "meta")), None
    from rheolake.sources.cases import oriented_case
    from rheolake.sources.hdf5 import read_cases
    from rheolake.storage import materialize

    read = lambda table: read_cases(spark, [a.cases], table, mode="PERMISSIVE", slabs=a.slabs, library=a.hdf5_library)
    tables = [materialize(df, "case") for df in oriented_case(*(materialize(read(t), t) for t in ("raw_signal", "seg", "case_meta")))]
    return *tables, read("status").where("status = 'error'").select("case_id", "status", "error")


def main(argv: list[str] | None = None) -> None:
    from rheolake.documents import write_documents
    from rheolake.engine import Engine
    from rheolake.sinks import case_summary, saved_planes, write_pixelwise, write_positions, write_report
    from rheolake.sources.cases import case_status

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("rheolake").getOrCreate()
    began = time.time()
    seg, flow, meta, unread = load(spark, a)
    status = case_status(seg, flow, meta)
    good = status.where("status = 'ok'").select("case_id")
    config, saved, notes = config_of(a), saved_planes(spark, a.reuse_planes) if a.reuse_planes else None, None
    # an engine has one spacing: cases of equal spacing run together, and there are few of those
    spacings = [tuple(r.spacing) for r in meta.select("spacing").distinct().collect()] if "spacing" in meta.columns else [config.spacing]
    engines: list[Engine] = []
    for n, spacing in enumerate(sorted(spacings)):
        own = good.join(meta.where(F.col("spacing") == F.array(*map(F.lit, spacing))), "case_id", "left_semi") if "spacing" in meta.columns else good
        engine = Engine(*(df.join(own, "case_id", "left_semi") for df in (seg, flow, meta)), replace(config, spacing=spacing), saved)
        engines.append(engine)
        if a.move_planes:
            engine = engine.move_planes(spark.read.parquet(a.move_planes))
        for name in steps_of(a):
            if name.startswith("tke") and "tke" not in engine.flow.columns:
                continue  # no turbulent energy in these cases
            engine.step(name).write.mode("append" if n else "overwrite").parquet(f"{a.output}/{name}")
        if a.documents:
            mode = "append" if n else "overwrite"
            write_positions(engine.planes, f"{a.output}/plane_positions", resolution=spacing, mode=mode)
            case_summary(engine.planes, engine.skeleton, engine.edges, engine.raw_paths, engine.forks).write.mode(mode).json(f"{a.output}/summary")
            if not a.skip_plane_metrics:
                write_documents(engine.documents, f"{a.output}/plane_metrics", mode=mode)
        if a.save_pixelwise and not a.skip_derived:
            tke = engine.tke_time if "tke" in engine.flow.columns else None
            write_pixelwise(engine.wss_volume, tke, engine.meta, f"{a.output}/pixelwise", spacing, mode="append" if n else "overwrite")
        notes = engine.notes if notes is None else notes.unionByName(engine.notes)
    # relational steps run for all cases together, so each has an equal share of the job; kernels are timed case by case
    share = (time.time() - began) / max(1, good.count())
    status = status.withColumn("seconds", F.when(F.col("status") == "ok", share))
    status = with_notes(status, notes) if notes is not None else status
    write_report(status if unread is None else status.unionByName(unread, allowMissingColumns=True), f"{a.output}/report")
    for engine in engines:
        engine.close()


if __name__ == "__main__":
    main()
