"""Nearest things against all of them, and edits that add."""

import numpy as np
import pytest

from rheolake.operators import edit, graph, nearest, polyline

POINTS = "case_id int, path_id int, seq int, x double, y double, z double"
ASKED = "case_id int, query_id int, px double, py double, pz double"


def brute(points, ask):
    out = {}
    for c, q, *p in ask:
        own = [(sum((a - b) ** 2 for a, b in zip(r[3:], p, strict=True)), r[1], r[2]) for r in points if r[0] == c]
        if own:
            out[c, q] = min(own)[1:]
    return out


@pytest.mark.parametrize("kind", ["cloud", "lattice", "line", "one place"])
def test_nearest_vertex(spark, kind):
    rng = np.random.default_rng(5)
    at = {
        "cloud": lambda n: rng.normal(0, 10, (n, 3)), "lattice": lambda n: rng.integers(0, 5, (n, 3)).astype(float),
        "line": lambda n: np.outer(np.arange(n), [1.0, 0.0, 0.0]), "one place": lambda n: np.full((n, 3), 2.0),
    }[kind]
    points = [(c, n // 20, n % 20, *map(float, p)) for c in range(2) for n, p in enumerate(at(400))]
    ask = [(c, q, *map(float, p)) for c in range(3) for q, p in enumerate(np.vstack([at(40), rng.normal(0, 1e4, (10, 3))]))]
    found = polyline.nearest_vertex(spark.createDataFrame(points, POINTS), spark.createDataFrame(ask, ASKED)).collect()
    assert {(r.case_id, r.query_id): (r.path_id, r.seq) for r in found} == brute(points, ask)


def test_no_place_no_neighbour(spark):
    points = spark.createDataFrame([(0, 0, 0, 1.0, 1.0, 1.0), (0, 0, 1, 2.0, 1.0, 1.0)], POINTS)
    ask = spark.createDataFrame([(0, 0, None, 1.0, 1.0), (0, 1, float("nan"), 1.0, 1.0), (0, 2, 1.9, 1.0, 1.0)], ASKED)
    assert [(r.query_id, r.seq) for r in polyline.nearest_vertex(points, ask).collect()] == [(2, 1)]
    assert polyline.nearest_vertex(points.where("false"), ask).count() == 0
    assert polyline.nearest_vertex(points, ask.where("false")).count() == 0


def test_projection_on_a_path_without_length(spark):
    points = spark.createDataFrame([(0, 0, 0, 1.0, 1.0, 1.0), (0, 1, 0, 3.0, 0.0, 0.0), (0, 1, 1, 3.0, 0.0, 0.0)], POINTS)
    ask = spark.createDataFrame([(0, p, p, 1.0, 1.0, 4.0) for p in (0, 1)], "case_id int, path_id int, query_id int, px double, py double, pz double")
    got = {r.query_id: (r.segment, r.distance, r.arc, r.x) for r in polyline.project_points(points, ask).collect()}
    assert got == {0: (0, 3.0, 0.0, 1.0), 1: (0, pytest.approx(21**0.5), 0.0, 3.0)}


def test_labels_far_from_all_paths(spark):
    rng = np.random.default_rng(7)
    points = [(0, n // 10, n % 10, *map(float, p)) for n, p in enumerate(rng.uniform(0, 40, (60, 3)))]
    cells = [(0, *map(int, v)) for v in {tuple(v) for v in rng.integers(0, 60, (200, 3))}]
    got = graph.nearest_path_labels(spark.createDataFrame(cells, "case_id int, i int, j int, k int"), spark.createDataFrame(points, POINTS), bucket=2, rings=1).collect()
    want = brute(points, [(0, v[1:], *v[1:]) for v in cells])
    assert {(r.i, r.j, r.k): r.label for r in got} == {v: p + 1 for (_, v), (p, _) in want.items()}


def test_edits_that_add(spark):
    nodes = spark.createDataFrame([(0, 4, 0.0, 0.0, 0.0)], "case_id int, node_id long, x double, y double, z double")
    more = spark.createDataFrame([(0, 2.0, 0.0, 0.0), (0, 1.0, 0.0, 0.0), (1, 5.0, 0.0, 0.0)], "case_id int, x double, y double, z double")
    assert sorted((r.case_id, r.node_id, r.x) for r in edit.append_nodes(nodes, more).collect()) == [(0, 4, 0.0), (0, 5, 1.0), (0, 6, 2.0), (1, 0, 5.0)]
    schema = "case_id int, plane_index int, cx double, cy double, cz double, nx double, ny double, nz double, label int, path_id int, distance double"
    planes = spark.createDataFrame([(0, n, float(n), 0.0, 0.0, 0.0, 0.0, 1.0, 2, 1, 3.0) for n in range(2)], schema)
    new = planes.where("plane_index = 0").selectExpr("case_id", "plane_index", "9.0D AS cx", "cy", "cz", "nx", "ny", "2.0D AS nz")
    both = edit.add_planes(planes, new).orderBy("plane_index").collect()
    assert [(r.plane_index, r.cx, r.nz, r.label, r.path_id, r.distance) for r in both] == [(0, 0.0, 1.0, 2, 1, 3.0), (1, 1.0, 1.0, 2, 1, 3.0), (2, 9.0, 1.0, 1, 0, 0.0)]
    moved = spark.createDataFrame([(0, 1, 7.0, 4.0), (0, 8, 7.0, 4.0)], "case_id int, plane_index int, cx double, nx double")
    at = edit.update_planes(planes, moved).orderBy("plane_index").collect()
    assert [(r.plane_index, r.cx, round(r.nx, 6), round(r.nz, 6)) for r in at] == [(0, 0.0, 0.0, 1.0), (1, 7.0, round(4 / 17**0.5, 6), round(1 / 17**0.5, 6))]


def test_few_candidates_where_all_is_crowded(spark):
    """Two far points stretch the box, so that a grid over it has all others in one cell."""
    rng = np.random.default_rng(11)
    at = np.vstack([rng.normal(0, 1, (20_000, 3)), [[1e6, 0, 0], [0, -1e6, 0]]])
    things = spark.createDataFrame([(0, n, *map(float, p)) for n, p in enumerate(at)], "case_id int, id int, x double, y double, z double")
    asked = spark.createDataFrame([(0, q, *map(float, p)) for q, p in enumerate(rng.normal(0, 1, (100, 3)))], ASKED)
    found = nearest.may_be_nearest(things.select("case_id", *nearest.point_box(), things["id"].alias("thing")), asked).groupBy("query_id").count().collect()
    assert len(found) == 100 and max(r["count"] for r in found) < 100


def test_long_edges_against_all_of_them(spark):
    rng = np.random.default_rng(12)
    at = rng.normal(0, 1, (600, 3))
    nodes = spark.createDataFrame([(0, n, *map(float, p)) for n, p in enumerate(at)], "case_id int, node_id long, x double, y double, z double")
    ends = np.array([(n, n + 1) for n in range(599)])
    edges = spark.createDataFrame([(0, int(a), int(b)) for a, b in ends], "case_id int, src long, dst long")
    ask = rng.normal(0, 1, (300, 3))
    found = graph.pick_edge_or_node(nodes, edges, spark.createDataFrame([(0, q, *map(float, p)) for q, p in enumerate(ask)], ASKED)).collect()
    a, d = at[ends[:, 0]], at[ends[:, 1]] - at[ends[:, 0]]
    gap = ask[:, None] - a
    off = gap - np.clip((gap * d).sum(2) / (d * d).sum(1), 0, 1)[..., None] * d
    line, spot = np.sqrt((off * off).sum(2)), np.sqrt(((ask[:, None] - at) ** 2).sum(2))
    want = {q: ("edge", line[q].argmin()) if line[q].min() < 0.7 * spot[q].min() else ("node", spot[q].argmin()) for q in range(300)}
    assert {r.query_id: (r.picked, r.src if r.picked == "edge" else r.node_id) for r in found} == want
    assert len({k for k, _ in want.values()}) == 2


def test_samples_of_many_cells_are_not_broadcast(spark):
    points = spark.createDataFrame([(0, 0, n, float(n), 0.0, 0.0) for n in range(5)], POINTS)
    cells = spark.createDataFrame([(0, n, 0, 0) for n in range(5)], "case_id int, i int, j int, k int")
    found = graph.nearest_path_labels(cells, points)
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "bx#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins) and found.count() == 5


def test_pieces_of_edges_are_kept_without_boxes(spark, monkeypatch):
    """A piece is its edge and a number; its box, which would more than double what is shuffled and written, is made when needed."""
    kept, real = {}, nearest.materialize
    monkeypatch.setattr(nearest, "materialize", lambda df, name: kept.setdefault(name, []).append(df.columns) or real(df, name))
    nodes = spark.createDataFrame([(0, n, float(n % 7), float(n % 5), 0.0) for n in range(60)], "case_id int, node_id long, x double, y double, z double")
    edges = spark.createDataFrame([(0, n, n + 1) for n in range(59)], "case_id int, src long, dst long")
    asked = spark.createDataFrame([(0, 0, 0.5, 0.5, 0.0)], ASKED)
    assert [(r.picked, r.src) for r in graph.pick_edge_or_node(nodes, edges, asked).collect()] == [("edge", 0)]
    assert [c for c in kept["things"][-1] if c.startswith(("lo_", "hi_"))] == []


@pytest.mark.parametrize("kind", ["cloud", "lattice", "one place"])
def test_near_edges(spark, kind, monkeypatch):
    monkeypatch.setattr(graph, "AT_ONCE", 500)
    rng = np.random.default_rng(11)
    at = {"cloud": rng.normal(0, 2, (300, 3)), "lattice": rng.permutation(np.argwhere(np.ones((6, 6, 6))) - 3.0), "one place": np.full((60, 3), -2.0)}[kind]
    rows = [(n % 2, 1000 - n, *map(float, p)) for n, p in enumerate(at)]
    odd = [(0, 1, float("inf"), 0.0, 0.0), (0, 2, float("inf"), 0.0, 0.0), (0, 3, float("nan"), 0.0, 0.0), (0, 4, None, 0.0, 0.0), (0, 5, 1e30, 0.0, 0.0), (0, 6, 1e30, 0.5, 0.0)]
    found = graph.near_edges(spark.createDataFrame(rows + odd, "case_id int, node_id long, x double, y double, z double"), 1.0)
    near = {(a[0], *sorted((a[1], b[1]))) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:], strict=True)) <= 1.0}
    assert found.dtypes == [("case_id", "int"), ("src", "bigint"), ("dst", "bigint")]
    assert sorted(map(tuple, found.collect())) == sorted(near | {(0, 5, 6)})


def test_near_edges_shuffle_few_copies(spark):
    points = [(0, n, *map(float, p)) for n, p in enumerate(np.random.default_rng(3).normal(0, 2, (1000, 3)))]
    met = graph.meetings(spark.createDataFrame(points, "case_id int, node_id long, x double, y double, z double"), 1.0)
    assert met.where("at_home").count() == 1000
    assert met.count() < 5 * 1000


def test_near_edges_make_small_files(spark, tmp_path):
    """Ends of pairs repeat each other: a byte a row and less where points are dense, far from the two ids of 8 bytes."""
    points = [(0, 7 * n % 6007, *map(float, p)) for n, p in enumerate(np.random.default_rng(5).random((6000, 3)))]
    found = graph.near_edges(spark.createDataFrame(points, "case_id int, node_id long, x double, y double, z double"), 0.5)
    found.write.parquet(f"file://{tmp_path}/pairs")
    rows, size = found.count(), sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert rows > 4_000_000 and size < rows


def test_near_edges_of_one_number(spark):
    """Two places of one node make no pair with each other, and one each with another node."""
    points = [(0, 5, 0.1, 0.1, 0.1), (0, 5, 0.2, 0.1, 0.1), (0, 5, -0.1, 0.1, 0.1), (0, 3, 0.15, 0.1, 0.1)]
    found = graph.near_edges(spark.createDataFrame(points, "case_id int, node_id long, x double, y double, z double"), 1.0)
    assert sorted(map(tuple, found.collect())) == [(0, 3, 5)] * 3
