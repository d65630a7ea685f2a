import math

import pytest
from pyspark.sql import functions as F

from rheolake import cli, sinks
from rheolake.operators import planes, voxel
from rheolake.sources import cases
from rheolake.streaming import arrivals


def test_discover(spark, tmp_path):
    for name in ("a.h5", "sub/b.HDF5", "c.txt", "sub/d.H5"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = [r.path.rsplit("/", 1)[1] for r in cases.discover(spark, [str(tmp_path), str(tmp_path)]).collect()]
    assert sorted(found) == ["a.h5", "b.HDF5", "d.H5"]


@pytest.mark.parametrize("order", [["LR", "AP", "FH"], ["FH", "AP", "LR"], ["RL", "PA", "FH"], ["AP", "HF", "RL"]])
def test_flow_from_signal(spark, order):
    """Known phases and amplitudes come back as velocities and spreads, in every axis order."""
    meta = spark.createDataFrame([("c", [3, 4, 5], [100.0], order, ["LR", "AP", "FH"])], "case_id string, dims array<int>, venc array<double>, spatial_order array<string>, venc_order array<string>")
    cells = spark.range(60).select(F.lit("c").alias("case_id"), F.floor(F.col("id") / 20).cast("int").alias("i"), (F.floor(F.col("id") / 5) % 4).cast("int").alias("j"), (F.col("id") % 5).cast("int").alias("k"), F.lit(0).alias("t"))
    seg = cells.withColumn("label", F.lit(1))
    raw = None
    for ch, (phase, keep) in enumerate(((0.3, 1.0), (0.8, 0.9), (-2.0, 0.8), (3.0, 1.0))):
        own = cells.withColumns({"ch": F.lit(ch), "re": F.lit(10 * keep * math.cos(phase)), "im": F.lit(10 * keep * math.sin(phase))})
        raw = own if raw is None else raw.unionByName(own)
    flow = cases.flow_from_signal(raw, meta, seg)
    row = flow.first()
    assert flow.count() == 60
    assert row.vx == pytest.approx(0.5 / math.pi * 100) and row.vy == pytest.approx(-2.3 / math.pi * 100) and row.vz == pytest.approx(2.7 / math.pi * 100)
    sx = math.sqrt(2 * math.log(1 / 0.9)) * 100 / math.pi
    sy = math.sqrt(2 * math.log(1 / 0.8)) * 100 / math.pi
    assert row.sx == pytest.approx(sx) and row.sz == 0 and row.tke == pytest.approx(530 * ((sx / 100) ** 2 + (sy / 100) ** 2))
    assert row.mag == pytest.approx(1.0)
    sizes = dict(zip((o if o in ("LR", "AP", "FH") else o[::-1] for o in order), (3, 4, 5), strict=True))
    most = flow.agg(F.max("i"), F.max("j"), F.max("k")).first()
    assert tuple(m + 1 for m in most) == (sizes["LR"], sizes["AP"], sizes["FH"])


def test_unknown_axis_is_an_error(spark):
    from rheolake.functions.axes import axis_of

    with pytest.raises(Exception, match="unknown axis code"):
        spark.createDataFrame([("UP",)], "c string").select(axis_of(F.col("c"))).collect()


def test_masks_without_time_and_empty_ones(spark):
    seg = spark.createDataFrame([("a", 0, 0, 0, 0, 1), ("b", 1, 1, 1, 0, 1), ("b", 1, 1, 1, 2, 1)], "case_id string, i int, j int, k int, t int, label int")
    times = spark.createDataFrame([("a", 3), ("b", 3)], "case_id string, times int")
    got = sorted((r.case_id, r.t) for r in cases.mask_at_times(seg, times).collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 2)]
    meta = spark.createDataFrame([("z", [4, 5, 6])], "case_id string, dims array<int>")
    assert tuple(voxel.mask_bbox(seg.where("false"), meta, 2).first()) == ("z", 0, 0, 0, 3, 4, 5)


def test_no_planes_give_no_metrics(spark):
    samples = spark.createDataFrame([], "case_id int, plane_index int, t int, area double, proj double")
    heads = spark.createDataFrame([], "case_id int, plane_index int, forward_sign int")
    times = spark.createDataFrame([(0, 0)], "case_id int, t int")
    assert planes.cycle_metrics(planes.plane_series(samples, heads, times)).count() == 0


def test_positions_there_and_back(spark, tmp_path):
    rows = [("c", n, 1.0 * n, 2.0, 3.0, 0.0, 0.0, 1.0, 1, 0, 5.0) for n in range(3)]
    df = spark.createDataFrame(rows, "case_id string, plane_index int, cx double, cy double, cz double, nx double, ny double, nz double, label int, path_id int, distance double")
    sinks.write_positions(df, str(tmp_path / "p"))
    back = sinks.read_positions(spark, str(tmp_path / "p")).orderBy("plane_index").collect()
    assert [r.center for r in back] == [[0.0, 2.0, 3.0], [1.0, 2.0, 3.0], [2.0, 2.0, 3.0]]


def test_arriving_files(spark, tmp_path):
    row = lambda t, a, p: (1, 2, t, a, p)
    schema = "case_id long, plane_index long, t int, area double, proj double"
    spark.createDataFrame([row(0, 2.0, 3.0), row(1, 1.0, -1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame([row(0, 1.0, 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    seen = {}
    query = arrivals.series_to(arrivals.arriving_samples(spark, str(tmp_path / "in/*")), lambda df, n: seen.update({r.t: (r.area, r.flow, r.peak) for r in df.collect()}), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert seen == {0: (3.0, 7.0, 3.0), 1: (1.0, -1.0, 1.0)}


def test_options():
    a = cli.parser().parse_args(["in", "--output", "out", "--distance", "7", "--no-gaussian"])
    config = cli.config_of(a)
    assert config.planes.distance == 7 and not config.skeleton.gaussian
    with pytest.raises(ValueError):
        cli.config_of(cli.parser().parse_args(["in", "--output", "out", "--distance", "0"]))


def test_steps_of_options():
    steps = lambda *more: cli.steps_of(cli.parser().parse_args(["in", *more]))
    assert steps() == ["planes", "metrics", "qc", "wall", "tke_peak"]
    assert steps("--skip-derived") == ["planes", "metrics", "qc"]
    assert steps("--skip-derived", "--skip-plane-metrics") == ["planes"]
    assert steps("--steps", "mask, paths", "--skip-derived") == ["mask", "paths"]


def test_saved_planes_as_columns(spark, tmp_path):
    rows = [("c", 0, 4.0, 5.0, 6.0, 0.0, 0.0, 1.0, 1, 0, 5.0)]
    sinks.write_positions(spark.createDataFrame(rows, "case_id string, plane_index int, cx double, cy double, cz double, nx double, ny double, nz double, label int, path_id int, distance double"), str(tmp_path / "p"))
    assert [tuple(r) for r in sinks.saved_planes(spark, str(tmp_path / "p")).collect()] == [("c", 0, 4.0, 5.0, 6.0, 0.0, 0.0, 1.0)]


def test_places_of_saved_planes(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    (tmp_path / "planes.json").write_text("{}")
    assert sinks.find_positions(spark, str(tmp_path), "c1").endswith("/planes.json")
    (tmp_path / "c1/planes.json").write_text("{}")
    assert sinks.find_positions(spark, str(tmp_path), "c1").endswith("c1/planes.json")
    (tmp_path / "c1/plane_positions.json").write_text("{}")
    assert sinks.find_positions(spark, str(tmp_path), "c1").endswith("c1/plane_positions.json")
    assert sinks.find_positions(spark, str(tmp_path / "planes.json"), "c1") == str(tmp_path / "planes.json")
    assert sinks.find_positions(spark, str(tmp_path / "none"), "c1") == str(tmp_path / "none")


def test_snapshot_report_and_frames(spark, tmp_path):
    runs = spark.createDataFrame([("a", "ok", 2.0, None), ("b", "ok", 4.0, None), ("c", "error", 9.0, "x")], "case_id string, status string, seconds double, error string")
    sinks.save_tables({"runs": runs}, str(tmp_path / "s"))
    assert sinks.load_tables(spark, str(tmp_path / "s"), ["runs"])["runs"].count() == 3
    sinks.write_report(runs, str(tmp_path / "r"))
    timing = spark.read.json(str(tmp_path / "r/timing")).first()
    assert (timing.ok, timing.failed, timing["mean"], round(timing.std, 6)) == (2, 1, 3.0, 1.414214)
    frames = sinks.frame_times(spark.range(7).withColumnRenamed("id", "frame"), 2, 3).orderBy("frame")
    assert [r.t for r in frames.collect()] == [0, 0, 1, 1, 2, 2, 0]


def test_indented_documents(spark, tmp_path):
    import json

    plane = {"plane_index": 0, "center": [1.0, 2.0, 3.0], "center_world": [2.0, 3.0, 4.0], "normal": [0.0, 0.0, 1.0], "label": 1, "path_index": 4, "distance": 5.0}
    (tmp_path / "p.json").write_text(json.dumps({"source": "x", "origin": [1, 1, 1], "planes": [plane, plane | {"plane_index": 1}]}, indent=2))
    (tmp_path / "q.json").write_text(json.dumps([plane], indent=2))
    got = sinks.read_positions(spark, str(tmp_path / "p.json")).orderBy("plane_index").collect()
    assert [(r.plane_index, r.path_id, r.center_world) for r in got] == [(0, 4, [2.0, 3.0, 4.0]), (1, 4, [2.0, 3.0, 4.0])]
    assert sinks.read_positions(spark, str(tmp_path / "q.json")).count() == 1


def test_status_of_cases(spark):
    meta = spark.createDataFrame([(c, [4, 4, 4]) for c in ("good", "empty", "wide", "still")] + [("flat", [4, 4]), ("noflow", [4, 4, 4]), ("late", [4, 4, 4])], "case_id string, dims array<int>")
    at = lambda c, i, t, label: (c, i, 0, 0, t, label)
    seg = [at("good", 1, t, 1) for t in (0, 1)] + [at("empty", 1, 0, 0), at("wide", 4, 0, 1), at("still", 1, 0, 1), at("flat", 1, 0, 1), at("noflow", 1, 0, 1), at("alone", 1, 0, 1)] + [at("late", 1, t, 1) for t in (0, 7)]
    flow = [(c, 1, 0, 0, t, 1.0) for c in ("good", "empty", "wide", "still", "flat", "alone", "late") for t in (0, 1)]
    got = cases.case_status(spark.createDataFrame(seg, "case_id string, i int, j int, k int, t int, label int"), spark.createDataFrame(flow, "case_id string, i int, j int, k int, t int, vx double"), meta)
    assert {r.case_id: r.status for r in got.collect()} == {"good": "ok", "still": "ok", "empty": "skipped", "noflow": "skipped", "wide": "error", "flat": "error", "late": "error", "alone": "error"}


def test_saved_planes_of_documents_without_a_case(spark, tmp_path):
    """Indented documents that name no case, bare lists, centres in the world."""
    import json

    plane = {"plane_index": 3, "center": [1.0, 2.0, 3.0], "center_world": [11.0, 2.0, 3.0], "normal": [0, 0, 1], "label": 1, "path_index": 0, "distance": 2.5}
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "plane_positions.json").write_text(json.dumps({"source": "/data/p07.v2.h5", "origin": [10, 0, 0], "planes": [plane, {"center": [4.0, 5.0, 6.0]}, {"label": 2}]}, indent=2))
    (tmp_path / "two" / "planes.json").write_text(json.dumps([plane, plane], indent=1))
    read = lambda *x: sorted(tuple(r) for r in sinks.saved_planes(spark, *x).collect())
    assert read(str(tmp_path / "one")) == [("p07.v2", 1, 4.0, 5.0, 6.0, 1.0, 0.0, 0.0), ("p07.v2", 3, 1.0, 2.0, 3.0, 0.0, 0.0, 1.0)]
    assert [r[:3] for r in read(str(tmp_path / "two"))] == [("two", 3, 11.0)] * 2
    assert {r[0] for r in read(str(tmp_path / "one"), "mine")} == {"mine"}
    assert {r[0] for r in read(str(tmp_path / "*"))} == {"p07.v2", "two"}
    (tmp_path / "bad.json").write_text('{"n": 1}')
    with pytest.raises(ValueError, match="no planes"):
        read(str(tmp_path / "bad.json"))
