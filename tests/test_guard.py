"""A case that breaks a kernel is an error in the report; the others' results are what they would be without it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rheolake import cli
from rheolake.config import EngineConfig, PlaneParams
from rheolake.engine import Engine
from rheolake.operators import batches, guard, kernels
from rheolake.sources import phantoms


def test_outside_nothing_changes(spark):
    rows = spark.createDataFrame([(1, 2), (1, 3)], "case_id int, v int")

    def run(pdf):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        guard.apply_groups(rows, ["case_id"], run, "case_id int, v int").collect()


def test_groups_that_raise_are_rows(spark):
    rows = spark.createDataFrame([(c, v) for c in range(6) for v in range(3)], "case_id int, v long")

    def run(pdf):
        if pdf["case_id"].iloc[0] % 3 == 1:
            raise ValueError("case is bad")
        return pdf.assign(v=pdf["v"] * 2)

    with guard.guarded():
        found = guard.apply_groups(rows, ["case_id"], run, rows.schema)
    good, notes = guard.split(found)
    assert sorted(map(tuple, good.collect())) == [(c, 2 * v) for c in (0, 2, 3, 5) for v in range(3)]
    assert {r.case_id: r.error for r in notes.collect()} == {c: "ValueError: case is bad" if c % 3 == 1 else None for c in range(6)}
    assert all(r.seconds >= 0 for r in notes.collect())


def test_batched_groups_are_told_apart(spark):
    rows = spark.createDataFrame([(c, v) for c in range(6) for v in range(3)], "case_id int, v long")

    def work(pdf, starts):
        if (pdf["case_id"] == 4).any():
            raise ValueError("four")
        return pdf

    with guard.guarded():
        found = batches.map_groups(rows, ["case_id"], work, "case_id int, v long")
    good, notes = guard.split(found)
    assert sorted(map(tuple, good.collect())) == [(c, v) for c in (0, 1, 2, 3, 5) for v in range(3)]
    assert sorted((r.case_id, r.error) for r in notes.collect() if r.error) == [(4, "ValueError: four")] and notes.count() == 6


def test_groups_across_batches():
    frame = pd.DataFrame({"case_id": np.repeat(np.arange(10), 7), "v": np.arange(70)})
    parts = [frame.iloc[a : a + 9] for a in range(0, 70, 9)]
    found = list(batches.complete_groups(parts, ["case_id"], rows=20))
    assert pd.concat([p for p, _ in found])["v"].tolist() == list(range(70))
    assert all(set(p["case_id"].to_numpy()[s]) == set(p["case_id"]) and len(s) == p["case_id"].nunique() for p, s in found)
    assert sum(len(s) for _, s in found) == 10


def test_one_bad_case_in_the_engine(spark, monkeypatch):
    flow = phantoms.straight_tube(spark, cases=2, size=8, length=16, radius=3.0, times=1)
    seg = flow.select("case_id", "i", "j", "k", "t", F.lit(1).alias("label"))
    meta = spark.createDataFrame([(c, [8, 8, 16]) for c in range(2)], "case_id int, dims array<int>")
    config = EngineConfig(planes=PlaneParams(interpolation=2, window=5))
    alone = Engine(seg.where("case_id = 0"), flow.where("case_id = 0"), meta.where("case_id = 0"), config)
    want = sorted(map(tuple, alone.paths.collect()))
    plain = kernels.savgol

    def breaks(values, window, order):
        if values[0, 0] > 100:  # the case that is moved there below
            raise FloatingPointError("bad path")
        return plain(values, window, order)

    shifted = seg.withColumn("i", F.col("i") + 200 * F.col("case_id")), flow.withColumn("i", F.col("i") + 200 * F.col("case_id"))
    monkeypatch.setattr(kernels, "savgol", breaks)
    engine = Engine(*shifted, meta.withColumn("dims", F.array(F.lit(400), F.lit(8), F.lit(16))), config)
    assert sorted(map(tuple, engine.paths.collect())) == want
    status = spark.createDataFrame([(0, "ok", None, 1.0), (1, "ok", None, 1.0)], "case_id int, status string, error string, seconds double")
    report = {r.case_id: r for r in cli.with_notes(status, engine.notes).collect()}
    assert report[0].status == "ok" and report[0].error is None and report[0].kernel_seconds > 0
    assert report[1].status == "error" and report[1].error == "paths: FloatingPointError: bad path"
