"""The data source of case files, with a stand-in for the library that opens them."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rheolake.engine import Engine
from rheolake.sources import cases, hdf5


def write(path, **arrays):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        np.savez(f, **arrays)


def signal(shape, times, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(*shape, times, 4)) + 1j * r.normal(size=(*shape, times, 4))).astype(np.complex64)


@pytest.fixture
def read(spark, tmp_path):
    spark.sparkContext.addPyFile(str(Path(__file__).with_name("standin_hdf5.py")))
    return lambda table, **o: hdf5.read_cases(spark, [str(tmp_path)], table, library="standin_hdf5", **o)


@pytest.mark.parametrize("slabs", [1, 2, 7])
def test_tables_of_files(read, tmp_path, slabs):
    a, b = signal((5, 4, 6), 3), signal((3, 3, 3), 2, 1)
    mask = np.zeros((5, 4, 6), np.uint8)
    mask[2, 1:3, 4] = [1, 2]
    timed = np.zeros((3, 3, 3, 2), np.int32)
    timed[1, 1, 1, 1] = 3
    write(tmp_path / "a.h5", img_complex=a, segmask=mask, VENC=np.array([80.0]), RR=np.array(900.0), SpatialOrder=np.array([b"LR", b"AP", b"FH"]))
    write(tmp_path / "sub/b.HDF5", img_complex=b, segmask=timed, Resolution=np.array([1.0, 2.0, 3.0]))
    meta = {r.case_id: r for r in read("case_meta").collect()}
    assert meta["a"].dims == [5, 4, 6] and meta["a"].venc == [80.0] and meta["a"].rr == 900 and meta["a"].spatial_order == ["LR", "AP", "FH"]
    assert meta["b"].spacing == [1, 2, 3] and meta["b"].rr == 1000 and meta["b"].venc == [150] * 3 and meta["b"].venc_order == ["FH", "AP", "LR"]
    seg = {tuple(r) for r in read("seg", slabs=slabs).collect()}
    assert seg == {("a", 2, 1, 4, 0, 1), ("a", 2, 2, 4, 0, 2), ("b", 1, 1, 1, 1, 3)}
    rows = read("raw_signal", slabs=slabs)
    assert rows.rdd.getNumPartitions() == 2 * slabs
    got = {tuple(r)[:6]: complex(r.re, r.im) for r in rows.collect()}
    box = [(i, j, k) for i in range(0, 5) for j in range(0, 4) for k in range(2, 6)]  # two voxels around the mask
    want = {("a", i, j, k, t, ch): complex(a[i, j, k, t, ch]) for i, j, k in box for t in range(3) for ch in range(4)}
    want |= {("b", i, j, k, t, ch): complex(b[i, j, k, t, ch]) for i in range(3) for j in range(3) for k in range(3) for t in range(2) for ch in range(4)}
    assert got == want
    assert read("raw_signal", pad=-1).where("case_id = 'a'").count() == 5 * 4 * 6 * 3 * 4


def test_bad_files_fail_or_are_reported(read, tmp_path):
    write(tmp_path / "good.h5", img_complex=signal((2, 2, 2), 1), segmask=np.ones((2, 2, 2)))
    write(tmp_path / "bare.h5", img_complex=signal((2, 2, 2), 1))
    write(tmp_path / "times.h5", img_complex=signal((2, 2, 2), 3), segmask=np.ones((2, 2, 2, 2)))
    write(tmp_path / "shape.h5", img_complex=signal((2, 2, 2), 1), segmask=np.ones((2, 2, 3)))
    (tmp_path / "junk.h5").write_bytes(b"no archive")
    with pytest.raises(Exception, match=r"(bare|junk|shape|times).h5: "):
        read("seg").collect()
    assert {r.case_id for r in read("seg", mode="PERMISSIVE").collect()} == {"good"}
    status = {r.case_id: (r.status, r.error) for r in read("status").collect()}
    assert status.pop("good") == ("ok", None)
    assert all(s == "error" and e for s, e in status.values()) and len(status) == 4
    write(tmp_path / "other/good.h5", img_complex=signal((2, 2, 2), 1), segmask=np.ones((2, 2, 2)))
    with pytest.raises(ValueError, match="named good"):
        read("seg")


def test_no_files(read):
    assert read("raw_signal").count() == 0 and read("status").count() == 0


@pytest.mark.parametrize("order", [["LR", "AP", "FH"], ["HF", "RL", "AP"], ["PA", "FH", "LR"]])
def test_files_to_oriented_cases(spark, read, tmp_path, order):
    """Mask and flow of a file land on each other, whatever its axes; a mask without times holds at all times."""
    axis = {"LR": 0, "RL": 0, "AP": 1, "PA": 1, "FH": 2, "HF": 2}
    size = {0: 7, 1: 6, 2: 9}
    shape = tuple(size[axis[o]] for o in order)
    rng = np.random.default_rng(4)
    marks = rng.random((7, 6, 9)) < 0.05
    marks[3, 3, 4] = True
    phase = rng.uniform(-3, 3, (7, 6, 9))

    def stored(x):
        """A volume along the target axes as the file has it."""
        out = np.transpose(x, [axis[o] for o in order])
        return np.flip(out, [n for n, o in enumerate(order) if o in ("RL", "PA", "HF")])

    image = np.ones((*shape, 2, 4), complex)
    image[..., 1] = np.exp(1j * stored(phase))[..., None]
    write(tmp_path / "case.h5", img_complex=image, segmask=stored(marks).astype(np.int16), SpatialOrder=np.array(order), VENCOrder=np.array(["LR", "AP", "FH"]), Resolution=np.array([1.0, 2.0, 3.0]), VENC=np.array([100.0] * 3))
    seg, flow, meta = cases.oriented_case(read("raw_signal", slabs=2), read("seg"), read("case_meta"))
    at = np.argwhere(marks)
    low = np.maximum(at.min(0) - 2, 0)
    assert {(r.i, r.j, r.k, r.t) for r in seg.collect()} == {(*map(int, p - low), t) for p in at for t in range(2)}
    head = meta.first()
    assert head.dims == (np.minimum(at.max(0) + 3, marks.shape) - low).tolist()
    assert head.spacing == [[1.0, 2.0, 3.0][[axis[o] for o in order].index(n)] for n in range(3)]
    for r in flow.where("t = 1").collect():
        assert r.vx == pytest.approx(phase[tuple(np.array([r.i, r.j, r.k]) + low)] / math.pi * 100, abs=1e-3)


def test_static_mask_has_stress_at_all_times(spark):
    from rheolake.sources import phantoms

    flow = phantoms.straight_tube(spark, cases=1, size=8, length=8, radius=3.0, times=3, swing=0.0)
    seg = flow.where("t = 0").select("case_id", "i", "j", "k", "t", F.lit(1).alias("label"))
    wall = Engine(seg, flow, spark.createDataFrame([(0, [8, 8, 8])], "case_id int, dims array<int>")).wall
    found = {r.t: r for r in wall.groupBy("t").agg(F.count("*").alias("n"), F.avg("wss").alias("mean")).collect()}
    assert set(found) == {0, 1, 2} and len({r.n for r in found.values()}) == 1
    assert all(r["mean"] > 0 and r["mean"] == pytest.approx(found[0]["mean"]) for r in found.values())


def test_command_line_over_files(spark, tmp_path):
    """Two tubes of different spacing and beat, and a broken file: planes, metrics and a report of all three."""
    import json

    from rheolake import cli

    spark.sparkContext.addPyFile(str(Path(__file__).with_name("standin_hdf5.py")))
    grid = np.stack(np.meshgrid(*(np.arange(n) + 0.5 for n in (8, 8, 16)), indexing="ij"), -1)
    r2 = (grid[..., 0] - 4) ** 2 + (grid[..., 1] - 4) ** 2
    image = np.ones((8, 8, 16, 2, 4), complex)
    image[..., 3] = np.exp(1j * math.pi * 0.5 * np.clip(1 - r2 / 9, 0, 1))[..., None]
    plain = {"SpatialOrder": np.array(["LR", "AP", "FH"]), "VENCOrder": np.array(["LR", "AP", "FH"]), "VENC": np.array([100.0] * 3)}
    for name, size, beat in (("a", 1.0, 1000.0), ("b", 2.0, 500.0)):
        write(tmp_path / f"in/{name}.h5", img_complex=image, segmask=(r2 <= 9).astype(np.int16), Resolution=np.array([size] * 3), RR=np.array(beat), **plain)
    write(tmp_path / "in/c.h5", img_complex=image)
    out = tmp_path / "out"
    cli.main([str(tmp_path / "in"), "--hdf5", "--hdf5-library", "standin_hdf5", "--output", str(out), "--skip-derived"])
    net = {r.case_id: r.net for r in spark.read.parquet(f"{out}/metrics").collect()}
    assert set(net) == {"a", "b"} and net["b"] == pytest.approx(net["a"] * 4 / 2)  # four times the area, half the beat
    assert net["a"] == pytest.approx(math.pi * 9 * 50 / 2 / 100, rel=0.15)
    report = {r["case_id"]: r for f in (out / "report/cases").glob("*.json") for r in map(json.loads, f.read_text().splitlines())}
    assert {c: r["status"] for c, r in report.items()} == {"a": "ok", "b": "ok", "c": "error"}
    assert "segmask missing" in report["c"]["error"] and report["a"]["kernel_seconds"] > 0
