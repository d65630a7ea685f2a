"""Groups handled together give what each gives alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rheolake.operators import kernels
from rheolake.operators.batches import complete_groups


@pytest.mark.parametrize("far", [1, 10**7])
def test_links_of_groups(far):
    """With far coordinates the groups cannot be laid side by side and are linked one by one."""
    rng = np.random.default_rng(4)
    parts = [np.unique(rng.integers(0, 4, (n, 3)), axis=0) for n in (1, 9, 30, 2)]
    parts = [np.r_[p, p[:1] + far * 10] for p in parts]
    starts = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]]
    a, b = kernels.group_links(np.concatenate(parts), starts, kernels.ALL_STEPS)
    want = set()
    for start, p in zip(starts, parts):
        want |= {(start + x, start + y) for x, y in zip(*kernels.lattice_links(p, kernels.ALL_STEPS))}
    assert len(a) == len(want) and set(zip(a, b)) == want


def test_groups_longer_than_a_batch():
    """Groups are whole, in order, and none is lost, however batches cut them."""
    sizes = [1, 50, 3, 1, 20, 7]
    rows = pd.DataFrame({"g": np.repeat(np.arange(len(sizes)), sizes), "n": np.arange(sum(sizes))})
    for step in (1, 4, 30, 100):
        for least in (1, 5, 40, 1000):
            got = []
            for pdf, starts in complete_groups([rows.iloc[n : n + step] for n in range(0, len(rows), step)], ["g"], least):
                ends = np.r_[starts[1:], len(pdf)]
                got += [pdf.iloc[x:y]["n"].tolist() for x, y in zip(starts, ends)]
            assert got == [rows.loc[rows["g"] == g, "n"].tolist() for g in range(len(sizes))]
    assert list(complete_groups([rows.iloc[:0]], ["g"])) == []


def test_components_of_many_cases_are_those_of_each(spark):
    rng = np.random.default_rng(9)
    cells = [(c, *map(int, p), int(p @ (1, 5, 25))) for c in range(30) for p in np.argwhere(rng.random((5, 5, 5)) < 0.25)]
    df = spark.createDataFrame(cells, "case_id int, i int, j int, k int, voxel long")
    for connectivity in (6, 26):
        got = {(r.case_id, r.voxel): r.component for r in kernels.connected_components(df, connectivity).collect()}
        for c in range(30):
            own = {(i, j, k): v for case, i, j, k, v in cells if case == c}
            reach = {p: {p} for p in own}
            for p in own:
                for q in own:
                    gap = sorted(abs(x - y) for x, y in zip(p, q))
                    if gap == [0, 0, 1] or (connectivity == 26 and gap[2] == 1):
                        both = reach[p] | reach[q]
                        for x in both:
                            reach[x] = both
            for p, v in own.items():
                assert got[c, v] == min(own[x] for x in reach[p])
    assert kernels.connected_components(df.where(F.lit(False))).count() == 0


def many_a_call(df):
    """One kernel call for many groups: no function of Spark's that is called group by group."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInPandas" in plan and "FlatMap" not in plan


def test_smoothed_masks_of_many_components_are_those_of_each(spark):
    rng = np.random.default_rng(10)
    cells = [(c, *map(int, p + c), int(p[0] > 2) + 10) for c in range(40) for p in np.argwhere(rng.random(rng.integers(2, 7, 3)) < 0.6)]
    got = kernels.gaussian_mask(spark.createDataFrame(cells, "case_id int, i int, j int, k int, component long"))
    taps = np.exp(-2.0 * np.arange(-2, 3) ** 2)
    taps /= taps.sum()
    want = []
    for c in range(40):
        for own in (10, 11):
            ijk = np.array([v[1:4] for v in cells if v[0] == c and v[4] == own])
            if not len(ijk):
                continue
            lo, size = ijk.min(0), np.ptp(ijk, axis=0) + 1
            box = np.zeros(size)
            box[tuple((ijk - lo).T)] = 1
            for axis in range(3):
                n = size[axis]
                at = np.arange(n)[:, None] + np.arange(-2, 3)
                at = at % (2 * n)
                at = np.where(at < n, at, 2 * n - 1 - at)  # mirrored
                box = np.moveaxis((np.moveaxis(box, axis, 0)[at] * taps[None, :, None, None]).sum(1), 0, axis)
            want += [(c, *map(int, p)) for p in np.argwhere(box > 0.5) + lo]
    assert sorted((r.case_id, r.i, r.j, r.k) for r in got.collect()) == sorted(want) and want
    assert many_a_call(got)


def test_smoothed_surfaces_of_many_cases_are_those_of_each(spark):
    rng = np.random.default_rng(11)
    sizes = rng.integers(2, 12, 30)
    spots = [(c, 10**17 + 3 * n, *map(float, rng.normal(0, 1, 3))) for c, m in enumerate(sizes) for n in range(m)]  # the same numbers in each
    links = sorted({(c, *sorted(map(int, 10**17 + 3 * rng.choice(m, 2, False)))) for c, m in enumerate(sizes) for _ in range(m)})
    vertices, edges = spark.createDataFrame(spots, "case_id int, vid long, x double, y double, z double"), spark.createDataFrame(links, "case_id int, src long, dst long")
    got = kernels.smooth_surface(vertices, edges, 20, 0.1)
    p = {(c, v): np.array(x) for c, v, *x in spots}
    near = {key: [(c, b if key[1] == a else a) for c, a, b in links if c == key[0] and key[1] in (a, b)] for key in p}
    for _ in range(20):
        p = {key: x + 0.1 * (np.mean([p[q] for q in near[key]], axis=0) - x) if near[key] else x for key, x in p.items()}
    found = {(r.case_id, r.vid): (r.x, r.y, r.z) for r in got.collect()}
    assert found.keys() == p.keys() and all(np.allclose(found[k], p[k], atol=1e-12) for k in p)
    assert many_a_call(got)


def test_lines_of_many_cases_are_those_of_each(spark):
    rng = np.random.default_rng(12)
    flow = [(c, 0, *map(int, p), *map(float, rng.normal(20, 40, 3))) for c in range(12) for p in np.argwhere(rng.random((5, 4, 3)) < 0.9) + c]
    seeds = [(c, n, *map(float, rng.uniform(0, 3, 3) + c)) for c in range(1, 14) for n in range(4)]  # case 0 without seeds, 12 and 13 without flow
    got = kernels.streamlines(
        spark.createDataFrame(flow, "case_id int, t int, i int, j int, k int, vx double, vy double, vz double"),
        spark.createDataFrame(seeds, "case_id int, line_id int, x double, y double, z double"), max_steps=15,
    )
    field = {(c, i, j, k): np.array(v) / 100 for c, _, i, j, k, *v in flow}
    want = {}
    for c, line, *p in seeds:
        at = lambda p: field.get((c, *map(int, np.floor(p))), np.zeros(3))  # noqa: B023, E731
        unit = lambda p, way: way * at(p) / (np.linalg.norm(at(p)) + 1e-12)  # noqa: B023, E731
        if np.linalg.norm(at(p)) < 0.01:
            continue
        want[c, line, 0] = np.array(p)
        for way in (1, -1):
            q = np.array(p)
            for n in range(1, 16):
                a = unit(q, way)
                b = unit(q + 0.25 * a, way)
                d = unit(q + 0.25 * b, way)
                q = q + 0.5 / 6 * (a + 2 * b + 2 * d + unit(q + 0.5 * d, way))
                if np.linalg.norm(at(q)) < 0.01:
                    break
                want[c, line, way * n] = q
    found = {(r.case_id, r.line_id, r.seq): (r.x, r.y, r.z) for r in got.collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k], atol=1e-9) for k in want)
    assert many_a_call(got)
