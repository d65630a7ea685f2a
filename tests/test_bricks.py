"""Rounds over bricks and arcs against the kernels that take a whole case."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rheolake.operators import bricks, graph, kernels, rounds


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def mask(spark):
    """Random dust, a tilted tube and a block, in two cases; places may be negative."""
    r = np.random.default_rng(7)
    cells = set()
    for case, shape in ((0, (14, 12, 10)), (1, (6, 20, 5))):
        cells |= {(case, *map(int, p)) for p in np.argwhere(r.random(shape) < 0.22) - 3}
    grid = np.argwhere(np.ones((14, 14, 24), bool))
    tube = grid[((grid[:, 0] - 4 - grid[:, 2] / 5) ** 2 + (grid[:, 1] - 6) ** 2) < 9]
    cells |= {(2, *map(int, p)) for p in tube} | {(3, i, j, k) for i in range(5) for j in range(5) for k in range(5)}
    rows = [(c, i, j, k, ((i + 50) * 1000 + j + 50) * 1000 + k + 50) for c, i, j, k in cells]
    return spark.createDataFrame(rows, "case_id int, i int, j int, k int, voxel long").persist()


@pytest.mark.parametrize("side,connectivity", [(2, 6), (5, 26), (64, 6)])
def test_components_by_bricks(mask, side, connectivity):
    want = kernels.connected_components(mask, connectivity)
    columns = ["case_id", "i", "j", "k", "voxel", "component"]
    assert rows_of(bricks.connected_components(mask, connectivity, side), *columns) == rows_of(want, *columns)


@pytest.mark.parametrize("side,faces,connectivity", [(3, 1, 26), (7, 2, 6), (4, 6, 26)])
def test_skeleton_by_bricks(mask, side, faces, connectivity):
    parts = kernels.connected_components(mask, connectivity)
    columns = ["case_id", "i", "j", "k", "component"]
    assert rows_of(bricks.skeletonize(parts, side, faces), *columns) == rows_of(kernels.skeletonize(parts), *columns)


def test_empty_masks(mask):
    none = mask.where("false")
    assert bricks.connected_components(none).count() == 0
    assert bricks.skeletonize(kernels.connected_components(none)).count() == 0
    assert kernels.skeletonize(kernels.connected_components(none)).count() == 0


@pytest.mark.parametrize("side,spacing", [(2, (1.0, 1.0, 1.0)), (3, (2.0, 1.0, 0.5))])
def test_streamlines_by_bricks(spark, side, spacing):
    """A swirl through a box: lines cross many bricks, some come back into one they left."""
    grid = spark.range(9 * 8 * 7).select(F.lit("c").alias("case_id"), F.explode(F.array(F.lit(0), F.lit(3))).alias("t"), F.floor(F.col("id") / 56).cast("int").alias("i"), (F.floor(F.col("id") / 7) % 8).cast("int").alias("j"), (F.col("id") % 7).cast("int").alias("k"))
    flow = grid.where("NOT (i = 8 AND j = 7)").select("*", (F.col("j") - 3.5).alias("vx"), (4 - F.col("i") + F.col("t")).alias("vy"), F.lit(0.7).alias("vz"))
    seeds = spark.createDataFrame([("c", n, 0.5 + n % 8, 0.5 + n % 7, 0.5 + n % 5) for n in range(20)] + [("c", 99, 50.0, 50.0, 50.0)], "case_id string, line_id int, x double, y double, z double")
    columns = ["case_id", "t", "line_id", "seq", "x", "y", "z", "speed"]
    want = rows_of(kernels.streamlines(flow, seeds, spacing, max_steps=60), *columns)
    got = rows_of(bricks.streamlines(flow, seeds, spacing, max_steps=60, side=side), *columns)
    assert len(want) > 500 and got == want


def random_edges(seed):
    draw = random.Random(seed)
    edges = set()
    for case in range(6):
        n = draw.choice([3, 12, 40])
        for _ in range(draw.choice([2, n, 2 * n])):
            a, b = draw.randrange(n), draw.randrange(n)
            if a != b:
                edges.add((case, min(a, b), max(a, b)))
    edges |= {(7, i, i + 1) for i in range(100, 400)} | {(7, 100, 400)}  # a ring without a key node
    edges |= {(8, i, i + 1) for i in range(300)} | {(8, 0, 299), (8, 5, 1000)}  # long chains, and a loop at a key node
    edges |= {(9, a, b) for a in range(6) for b in range(a + 1, 6)}  # every triangle of six nodes
    return sorted(edges)


@pytest.mark.parametrize("seed", [1])
def test_chains_by_pointer_doubling(spark, seed):
    edges = spark.createDataFrame(random_edges(seed), "case_id int, src long, dst long")
    columns = ["case_id", "path_id", "seq", "node_id"]
    assert rows_of(rounds.trace_paths(edges), *columns) == rows_of(kernels.trace_paths(edges), *columns)
    none = edges.where("false")
    assert rounds.trace_paths(none).count() == 0


@pytest.mark.parametrize("seed", [2])
def test_pruning_by_spanning_forest_rounds(spark, seed):
    edges = spark.createDataFrame(random_edges(seed), "case_id int, src long, dst long")
    marked = edges.join(graph.triangle_edges(edges).withColumn("in_triangle", F.lit(True)), ["case_id", "src", "dst"], "left").fillna(False, ["in_triangle"])
    columns = ["case_id", "src", "dst"]
    assert rows_of(rounds.prune_triangles(marked), *columns) == rows_of(kernels.prune_triangles(marked), *columns)
    assert rounds.prune_triangles(marked.where("false")).count() == 0


def test_components_of_a_graph(spark):
    draw = random.Random(3)
    pairs = {(0, draw.randrange(300), draw.randrange(300)) for _ in range(200)} | {(1, 0, i) for i in range(1, 200)} | {(1, i, i + 1) for i in range(500, 900)}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for c, a, b in pairs:
        if a != b:
            x, y = find((c, a)), find((c, b))
            root[max(x, y)] = min(x, y)
    edges = spark.createDataFrame(sorted(pairs), "case_id int, a long, b long")
    assert rows_of(rounds.component_of(edges), "case_id", "node", "root") == sorted((c, n, find((c, n))[1]) for c, n in list(root))


def test_engine_by_bricks(spark):
    """The steps of a tube are the same whether a task has a whole case or a brick."""
    from rheolake.config import EngineConfig
    from rheolake.engine import Engine
    from rheolake.sources import phantoms

    flow = phantoms.straight_tube(spark, cases=1, size=8, length=20, radius=3.0, times=1)
    seg = flow.select("case_id", "i", "j", "k", "t", F.lit(1).alias("label"))
    meta = spark.createDataFrame([(0, [8, 8, 20])], "case_id int, dims array<int>")
    whole, cut = (Engine(seg, flow, meta, EngineConfig(brick=n)) for n in (0, 9))
    for step, columns in (("skeleton", ("case_id", "i", "j", "k")), ("edges", ("case_id", "src", "dst")), ("raw_paths", ("case_id", "path_id", "seq", "node_id"))):
        want = rows_of(whole.step(step), *columns)
        assert want and rows_of(cut.step(step), *columns) == want


def test_brick_lines_are_followed_many_a_call(spark, monkeypatch):
    """Bricks are small and many: none has a call of its own."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    flow = spark.createDataFrame([(c, 0, i, j, 0, 60.0, 10.0 * (j + c), 0.0) for c in range(5) for i in range(6) for j in range(5)], "case_id int, t int, i int, j int, k int, vx double, vy double, vz double")
    seeds = spark.createDataFrame([(c, 0, 0.5, 1.5, 0.5) for c in range(5)], "case_id int, line_id int, x double, y double, z double")
    columns = ["case_id", "t", "line_id", "seq", "x", "y", "z", "speed"]
    want = rows_of(kernels.streamlines(flow, seeds, max_steps=40), *columns)
    monkeypatch.setattr(Frame, "groupBy", lambda *_: pytest.fail("a call for each brick"))
    found = bricks.streamlines(flow, seeds, max_steps=40, side=2)
    monkeypatch.undo()
    assert rows_of(found, *columns) == want and len(want) > 20
