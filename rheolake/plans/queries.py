"""Registered queries: an operator over an adapted table, with the same question in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rheolake import documents
from rheolake.functions import axes, signal, text, vectors
from rheolake.operators import bricks, edit, graph, kernels, oblique, planes, polygons, polyline, rounds, surface, voxel
from rheolake.sources import adapters as src
from rheolake.sources.adapters import C_SQL, E_SQL, G_SQL, L_SQL, M_SQL, V_SQL
from rheolake.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero: sums of doubles may differ in their last bits from engine to engine."""
    return F.round(c, 6) + F.lit(0.0)


def s6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# --------------------------------------------------------------------------------------------------------------- signal


@query(f"WITH {C_SQL} SELECT o_orderkey, {s6('sqrt(re0 * re0 + im0 * im0)')} AS magnitude FROM sig")
def signal_magnitude(spark, d):
    return src.signals(spark, d).select("o_orderkey", r6(signal.magnitude(F.col("re0"), F.col("im0"))).alias("magnitude"))


#: Spark takes a negative zero for zero in both arguments.
_PHASE = "atan2(im1 * re0 - re1 * im0 + 0.0, re1 * re0 + im1 * im0 + 0.0)"


def _phase() -> Column:
    return signal.phase_difference(F.col("re1"), F.col("im1"), F.col("re0"), F.col("im0"))


@query(f"WITH {C_SQL} SELECT o_orderkey, {s6(_PHASE)} AS phase FROM sig")
def phase_difference(spark, d):
    return src.signals(spark, d).select("o_orderkey", r6(_phase()).alias("phase"))


@query(f"WITH {C_SQL} SELECT o_orderkey, {s6(f'{_PHASE} / pi() * 150')} AS velocity FROM sig")
def velocity_from_phase(spark, d):
    return src.signals(spark, d).select("o_orderkey", r6(signal.velocity(_phase(), 150.0)).alias("velocity"))


_SIGMA = "sqrt(2 * ln(greatest(sqrt(re0 * re0 + im0 * im0) / greatest(sqrt(re1 * re1 + im1 * im1), 1e-12), 1.0))) * 150 / pi()"


def _sigma() -> Column:
    return signal.intravoxel_sigma(signal.magnitude(F.col("re0"), F.col("im0")), signal.magnitude(F.col("re1"), F.col("im1")), 150.0)


@query(f"WITH {C_SQL} SELECT o_orderkey, {s6(_SIGMA)} AS sigma FROM sig")
def ivsd_sigma(spark, d):
    return src.signals(spark, d).select("o_orderkey", r6(_sigma()).alias("sigma"))


@query(f"WITH {C_SQL}, s AS (SELECT o_orderkey, {_SIGMA} AS g FROM sig) SELECT o_orderkey, round(0.5 * 1060 * 3 * (g / 100) * (g / 100), 4) + 0.0 AS tke FROM s")
def tke(spark, d):
    rows = src.signals(spark, d).withColumn("g", _sigma())
    return rows.select("o_orderkey", (F.round(signal.kinetic_energy(F.col("g"), F.col("g"), F.col("g")), 4) + 0.0).alias("tke"))


_ORDERS = (("LR", "AP", "FH"), ("FH", "AP", "LR"), ("AP", "RL", "HF"), ("RL", "FH", "PA"))


@query(f"""WITH {V_SQL} SELECT case_id, voxel,
  CASE case_id % 4 WHEN 0 THEN i WHEN 1 THEN k WHEN 2 THEN 3 - j ELSE 3 - i END AS x,
  CASE case_id % 4 WHEN 0 THEN j WHEN 1 THEN j WHEN 2 THEN i ELSE 3 - k END AS y,
  CASE case_id % 4 WHEN 0 THEN k WHEN 1 THEN i WHEN 2 THEN 3 - k ELSE j END AS z,
  CASE case_id % 4 WHEN 0 THEN val WHEN 1 THEN 3 * val WHEN 2 THEN -2 * val ELSE -val END AS vx FROM vox""")
def reorient_axes(spark, d):
    order = F.array(*[F.array(*[F.lit(c) for c in o]) for o in _ORDERS])[(F.col("case_id") % 4).cast("int")]
    rows = src.volumes(spark, d).withColumns({"order": order, "dims": F.array(*[F.lit(4)] * 3), "e0": F.col("val"), "e1": 2 * F.col("val"), "e2": 3 * F.col("val")})
    at = [axes.oriented_index(F.col("order"), F.col("dims"), ("i", "j", "k"), t).alias(c) for t, c in zip(axes.TARGET, "xyz", strict=True)]
    return rows.select("case_id", "voxel", *at, axes.oriented_component(F.col("order"), ("e0", "e1", "e2"), "LR").alias("vx"))


# --------------------------------------------------------------------------------------------------------------- voxels

_BOX = """box AS (SELECT case_id, greatest(min(i) - 1, 0) AS lo_i, greatest(min(j) - 1, 0) AS lo_j, greatest(min(k) - 1, 0) AS lo_k,
  least(max(i) + 1, 3) AS hi_i, least(max(j) + 1, 3) AS hi_j, least(max(k) + 1, 3) AS hi_k FROM big GROUP BY case_id)"""


def _big(spark, d) -> DataFrame:
    return src.volumes(spark, d).where("val > 0.2").select("case_id", "i", "j", "k")


def _boxes(spark, d) -> DataFrame:
    return voxel.mask_bbox(_big(spark, d), src.volume_meta(spark, d), pad=1)


@query(f"""WITH {V_SQL}, big AS (SELECT * FROM vox WHERE val > 0.2), {_BOX}
SELECT vec_id AS case_id, coalesce(lo_i, 0) AS lo_i, coalesce(lo_j, 0) AS lo_j, coalesce(lo_k, 0) AS lo_k,
  coalesce(hi_i, 3) AS hi_i, coalesce(hi_j, 3) AS hi_j, coalesce(hi_k, 3) AS hi_k FROM embeddings LEFT JOIN box ON vec_id = case_id""")
def mask_bbox(spark, d):
    return _boxes(spark, d)


@query(f"""WITH {V_SQL}, big AS (SELECT * FROM vox WHERE val > 0.2), {_BOX}
SELECT vox.case_id, CAST(i - coalesce(lo_i, 0) AS INT) AS i, CAST(j - coalesce(lo_j, 0) AS INT) AS j, CAST(k - coalesce(lo_k, 0) AS INT) AS k, val
FROM vox LEFT JOIN box USING (case_id) WHERE i BETWEEN coalesce(lo_i, 0) AND coalesce(hi_i, 3)
  AND j BETWEEN coalesce(lo_j, 0) AND coalesce(hi_j, 3) AND k BETWEEN coalesce(lo_k, 0) AND coalesce(hi_k, 3)""")
def crop_to_bbox(spark, d):
    return voxel.crop(src.volumes(spark, d).drop("voxel"), _boxes(spark, d))


@query(f"WITH {V_SQL} SELECT DISTINCT case_id % 20 AS case_id, i, j, k FROM mask")
def time_merge_mask(spark, d):
    times = src.masks(spark, d).select((F.col("case_id") % 20).alias("case_id"), F.col("case_id").alias("t"), "i", "j", "k")
    return voxel.time_merge(times)


@query(f"""WITH {V_SQL}, n AS (SELECT case_id % 20 AS case_id, i, j, k, count(*) AS n FROM mask GROUP BY ALL),
t AS (SELECT vec_id % 20 AS case_id, count(*) AS times FROM embeddings GROUP BY 1)
SELECT case_id, bool_and(n = times) AS static FROM n JOIN t USING (case_id) GROUP BY case_id""")
def static_mask(spark, d):
    rows = src.masks(spark, d).select((F.col("case_id") % 20).alias("case_id"), F.col("case_id").alias("t"), "i", "j", "k")
    times = src.volume_meta(spark, d).groupBy((F.col("case_id") % 20).alias("case_id")).agg(F.count("*").alias("times"))
    return voxel.is_static(rows, times)


@query("SELECT CAST(label % 7 AS BIGINT) AS case_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS labels FROM (SELECT DISTINCT label FROM embeddings WHERE label <> 0) GROUP BY 1")
def unique_labels(spark, d):
    seg = src.read(spark, d, "embeddings").select((F.col("label") % 7).cast("long").alias("case_id"), "label")
    return voxel.unique_labels(seg).select("case_id", F.array_join("labels", ",").alias("labels"))


def _components(spark, d) -> DataFrame:
    return kernels.connected_components(src.masks(spark, d))


_CC = f"""WITH RECURSIVE {V_SQL}, near AS (
  SELECT a.case_id, a.voxel AS src, b.voxel AS dst FROM mask a JOIN mask b ON a.case_id = b.case_id
    AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
reach(case_id, root, voxel) AS (
  SELECT case_id, voxel, voxel FROM mask UNION
  SELECT r.case_id, r.root, n.dst FROM reach r JOIN near n ON n.case_id = r.case_id AND n.src = r.voxel),
comp AS (SELECT case_id, voxel, min(root) AS component FROM reach GROUP BY ALL),
sizes AS (SELECT case_id, component, count(*) AS n FROM comp GROUP BY ALL)"""


@query(f"{_CC} SELECT case_id, voxel, component FROM comp")
def connected_components(spark, d):
    return _components(spark, d).select("case_id", "voxel", "component")


@query(f"{_CC} SELECT case_id, voxel, component FROM comp")
def connected_components_bricks(spark, d):
    return bricks.connected_components(src.masks(spark, d), side=2).select("case_id", "voxel", "component")


@query(f"{_CC} SELECT case_id, voxel, component FROM comp JOIN sizes USING (case_id, component) WHERE n * 1.5 >= 6.0")
def small_component_filter(spark, d):
    return voxel.drop_small_components(_components(spark, d), 6.0, (1.0, 1.0, 1.5)).select("case_id", "voxel", "component")


@query(f"""{_CC}, best AS (SELECT case_id, component, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, component) AS rn FROM sizes)
SELECT case_id, voxel, component FROM comp JOIN best USING (case_id, component) WHERE rn = 1""")
def largest_component(spark, d):
    return voxel.largest_component(_components(spark, d)).select("case_id", "voxel", "component")


@query(f"""{_CC} SELECT case_id, component, CAST(count(*) AS BIGINT) AS voxels, min(i) AS lo_i, max(i) AS hi_i, min(j) AS lo_j, max(j) AS hi_j,
  min(k) AS lo_k, max(k) AS hi_k, count(*) * 1.5 AS volume FROM comp JOIN mask USING (case_id, voxel) GROUP BY ALL""")
def component_bbox(spark, d):
    return voxel.component_sizes(_components(spark, d), (1.0, 1.0, 1.5))


_DILATED = "dil AS (SELECT DISTINCT case_id, i + di AS i, j + dj AS j, k + dk AS k FROM mask, cross_steps WHERE i + di BETWEEN 0 AND 3 AND j + dj BETWEEN 0 AND 3 AND k + dk BETWEEN 0 AND 3)"
_STEPS = "cross_steps(di, dj, dk) AS (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"


def _whole(spark, d) -> DataFrame:
    return src.volume_meta(spark, d).select("case_id", *[F.lit(0).alias(f"lo_{c}") for c in "ijk"], *[F.lit(3).alias(f"hi_{c}") for c in "ijk"])


@query(f"WITH {V_SQL}, {_STEPS}, {_DILATED} SELECT * FROM dil")
def binary_dilate(spark, d):
    return voxel.dilate(src.masks(spark, d), _whole(spark, d))


@query(f"""WITH {V_SQL}, {_STEPS}, moved AS (SELECT case_id, i + di AS i, j + dj AS j, k + dk AS k FROM mask, cross_steps)
SELECT case_id, i, j, k FROM moved GROUP BY ALL HAVING count(*) = 7""")
def binary_erode(spark, d):
    return voxel.erode(src.masks(spark, d))


@query(f"""WITH {V_SQL}, {_STEPS}, {_DILATED}, moved AS (SELECT case_id, i + di AS i, j + dj AS j, k + dk AS k FROM dil, cross_steps)
SELECT case_id, i, j, k FROM moved GROUP BY ALL HAVING count(*) = 7""")
def binary_close(spark, d):
    return voxel.close_mask(src.masks(spark, d), _whole(spark, d))


_FACES = """faces AS (
  SELECT m.case_id, m.i, m.j, m.k, CAST(axis AS INT) AS axis, CAST(side AS INT) AS side
  FROM mask m, (SELECT axis, side FROM range(3) AS a(axis), (VALUES (-1), (1)) AS s(side)) AS f
  WHERE NOT EXISTS (SELECT 1 FROM mask o WHERE o.case_id = m.case_id AND o.i = m.i + CASE WHEN axis = 0 THEN side ELSE 0 END
    AND o.j = m.j + CASE WHEN axis = 1 THEN side ELSE 0 END AND o.k = m.k + CASE WHEN axis = 2 THEN side ELSE 0 END))"""


@query(f"WITH {V_SQL}, {_FACES} SELECT * FROM faces")
def boundary_faces(spark, d):
    return voxel.boundary_faces(src.masks(spark, d))


@query(f"""WITH {V_SQL}, {_FACES}, corners AS (
  SELECT case_id, axis, side, CASE WHEN axis = 0 THEN i + CASE WHEN side > 0 THEN 1 ELSE 0 END ELSE i + a END AS vi,
    CASE WHEN axis = 1 THEN j + CASE WHEN side > 0 THEN 1 ELSE 0 END WHEN axis = 0 THEN j + a ELSE j + b END AS vj,
    CASE WHEN axis = 2 THEN k + CASE WHEN side > 0 THEN 1 ELSE 0 END ELSE k + b END AS vk
  FROM faces, range(2) AS x(a), range(2) AS y(b)),
total AS (SELECT case_id, vi, vj, vk, sum(CASE WHEN axis = 0 THEN side ELSE 0 END) AS nx, sum(CASE WHEN axis = 1 THEN side ELSE 0 END) AS ny,
  sum(CASE WHEN axis = 2 THEN side ELSE 0 END) AS nz FROM corners GROUP BY ALL),
len AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM total)
SELECT case_id, CAST(vi AS INT) AS vi, CAST(vj AS INT) AS vj, CAST(vk AS INT) AS vk, {s6('CASE WHEN l > 0 THEN -nx / l ELSE 0.0 END')} AS nx,
  {s6('CASE WHEN l > 0 THEN -ny / l ELSE 0.0 END')} AS ny, {s6('CASE WHEN l > 0 THEN -nz / l ELSE 0.0 END')} AS nz FROM len""")
def vertex_normals(spark, d):
    return rounded(voxel.vertex_normals(voxel.boundary_faces(src.masks(spark, d))), "nx", "ny", "nz")


@query(f"WITH {V_SQL} SELECT case_id, i AS row, j AS col, val FROM vox WHERE k = 2")
def slice_axial(spark, d):
    return voxel.slice_at(src.volumes(spark, d).drop("voxel"), "k", 2)


@query(f"WITH {V_SQL} SELECT case_id, i AS row, k AS col, val FROM vox WHERE j = 1")
def slice_coronal(spark, d):
    return voxel.slice_at(src.volumes(spark, d).drop("voxel"), "j", 1)


@query(f"WITH {V_SQL} SELECT case_id, j AS row, k AS col, val FROM vox WHERE i = 3")
def slice_sagittal(spark, d):
    return voxel.slice_at(src.volumes(spark, d).drop("voxel"), "i", 3)


@query(f"WITH {V_SQL} SELECT case_id, i, j, val FROM vox WHERE k = 3")
def time_clamp(spark, d):
    return voxel.at_time(src.volumes(spark, d).select("case_id", "i", "j", F.col("k").alias("t"), "val"), 9, 4).drop("t")


@query(f"WITH {V_SQL} SELECT case_id, greatest(max(abs(val)), 1e-6) AS limit FROM vox GROUP BY case_id".replace("AS limit", 'AS "limit"'))
def color_limits(spark, d):
    return voxel.color_limits(src.volumes(spark, d), "val")


@query(f"""WITH {V_SQL}, pts AS (SELECT vec_id AS case_id, CAST(g AS INT) AS point_id, g * 0.5 AS x, g * 0.25 + 0.125 AS y, 3.25 - g * 0.5 AS z FROM embeddings, range(8) AS r(g)),
near AS (SELECT case_id, point_id, CAST(floor(x) AS INT) + a AS i, CAST(floor(y) AS INT) + b AS j, CAST(floor(z) AS INT) + c AS k,
  CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END
    * CASE WHEN c = 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END AS w FROM pts, range(2) AS ra(a), range(2) AS rb(b), range(2) AS rc(c))
SELECT case_id, point_id, {s6('sum(w * coalesce(val, 0.0))')} AS value FROM near LEFT JOIN vox USING (case_id, i, j, k) GROUP BY case_id, point_id""")
def trilinear_resample(spark, d):
    g = F.col("point_id")
    points = src.volume_meta(spark, d).select("case_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("point_id"))
    points = points.select("case_id", "point_id", (g * 0.5).alias("x"), (g * 0.25 + 0.125).alias("y"), (3.25 - g * 0.5).alias("z"))
    return rounded(voxel.trilinear(src.volumes(spark, d), points), "value")


@query(f"""WITH {L_SQL}, spots AS (SELECT path_id AS case_id, CAST(least(greatest(round_even((x + 0.5) / 0.25, 0), 0), 3) AS INT) AS i,
  CAST(least(greatest(round_even((y + 0.5) / 0.25, 0), 0), 3) AS INT) AS j, CAST(least(greatest(round_even((z + 0.5) / 0.25, 0), 0), 3) AS INT) AS k, x FROM pts)
SELECT case_id, i, j, k, greatest(0.0, max(x)) AS value FROM spots GROUP BY ALL""")
def scatter_max(spark, d):
    rows = src.paths(spark, d).select(F.col("path_id").alias("case_id"), "x", "y", "z", F.col("x").alias("value"))
    return voxel.scatter_max(rows, (-0.5, -0.5, -0.5), (0.25, 0.25, 0.25), (4, 4, 4))


@query(f"""WITH {V_SQL}, v AS (SELECT case_id % 50 AS case_id, i, j, k, max(val) AS p FROM vox GROUP BY ALL),
m AS (SELECT DISTINCT case_id % 50 AS case_id, i, j, k FROM mask) SELECT case_id, i, j, k, coalesce(p, 0.0) AS peak FROM m LEFT JOIN v USING (case_id, i, j, k)""")
def tke_peak(spark, d):
    fold = (F.col("case_id") % 50).alias("case_id")
    values = src.volumes(spark, d).select(fold, F.col("case_id").alias("t"), "i", "j", "k", "val")
    return voxel.peak_over_time(values, src.masks(spark, d).select(fold, "i", "j", "k").distinct(), "val")


@query("SELECT o_orderkey, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x = 0 THEN '' WHEN x > 0 THEN 'LR+' ELSE 'LR-' END WHEN abs(y) >= abs(z) THEN CASE WHEN y >= 0 THEN 'AP+' ELSE 'AP-' END ELSE CASE WHEN z >= 0 THEN 'HF+' ELSE 'HF-' END END AS direction FROM (SELECT o_orderkey, o_custkey % 7 - 3 AS x, o_orderkey % 7 - 3 AS y, (o_orderkey // 7) % 7 - 3 AS z FROM orders)")
def direction_text(spark, d):
    key = F.col("o_orderkey")
    parts = (F.col("o_custkey") % 7 - 3, key % 7 - 3, F.floor(key / 7) % 7 - 3)
    rows = src.read(spark, d, "orders").select("o_orderkey", *[p.cast("double").alias(f"v{c}") for p, c in zip(parts, "xyz", strict=True)])
    return rows.select("o_orderkey", vectors.direction_text(vectors.vec("v")).alias("direction"))


@query("""SELECT event_id, CAST(user_id AS INT) AS n, CASE WHEN event_type = 'view' THEN -1 ELSE CAST(user_id AS INT) END AS plane,
  len(list_filter(string_split(replace(props, ';', ','), ','), lambda t: regexp_full_match(trim(t), '[+-]?[0-9]+'))) AS ints FROM events""")
def indexed_keys(spark, d):
    rows = src.read(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    key = F.concat(F.when(F.col("event_type") == "view", "smooth_path_").otherwise("plane_"), F.col("user_id"))
    both = F.coalesce(text.indexed_key(key, "plane"), text.indexed_key(key, "smooth_path"))
    return rows.select("event_id", both.alias("n"), F.coalesce(text.indexed_key(key, "plane"), F.lit(-1)).alias("plane"), F.size(text.int_list(F.col("props"))).cast("long").alias("ints"))


# ---------------------------------------------------------------------------------------------------------------- graph


@query(f"""WITH {V_SQL} SELECT a.case_id, a.voxel AS src, b.voxel AS dst FROM mask a JOIN mask b ON a.case_id = b.case_id AND a.voxel < b.voxel
  AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1""")
def neighbor_edges_26(spark, d):
    return graph.lattice_edges(src.masks(spark, d), F.col("voxel"))


@query(f"""WITH {L_SQL} SELECT a.case_id, a.path_id * 21 + a.seq AS src, b.path_id * 21 + b.seq AS dst FROM pts a JOIN pts b ON a.case_id = b.case_id
  AND (a.path_id * 21 + a.seq) < (b.path_id * 21 + b.seq)
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.05 * 0.05""")
def neighbor_edges_radius(spark, d):
    nodes = src.paths(spark, d).select("case_id", (F.col("path_id") * 21 + F.col("seq")).alias("node_id"), "x", "y", "z")
    return graph.near_edges(nodes, 0.05)


_TRI = """tri AS (SELECT ab.case_id, ab.src AS a, ab.dst AS b, bc.dst AS c FROM edges ab JOIN edges bc ON bc.case_id = ab.case_id AND bc.src = ab.dst
  JOIN edges ac ON ac.case_id = ab.case_id AND ac.src = ab.src AND ac.dst = bc.dst)"""


@query(f"""WITH {E_SQL}, {_TRI} SELECT case_id, a AS src, b AS dst FROM tri UNION SELECT case_id, b, c FROM tri UNION SELECT case_id, a, c FROM tri""")
def triangle_edges(spark, d):
    return graph.triangle_edges(src.node_edges(spark, d))


_DEG = "deg AS (SELECT case_id, node_id, count(*) AS degree FROM (SELECT case_id, src AS node_id FROM edges UNION ALL SELECT case_id, dst FROM edges) GROUP BY ALL)"


@query(f"WITH {E_SQL}, {_DEG} SELECT * FROM deg")
def node_degree(spark, d):
    return graph.degrees(src.node_edges(spark, d))


@query(f"WITH {E_SQL}, {_DEG} SELECT *, CASE WHEN degree = 1 THEN 'end' ELSE 'branch' END AS kind FROM deg WHERE degree = 1 OR degree >= 3")
def key_nodes(spark, d):
    return graph.key_nodes(src.node_edges(spark, d))


def _lists(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query(f"WITH {G_SQL} SELECT case_id, node, array_to_string(incoming, ',') AS incoming, array_to_string(outgoing, ',') AS outgoing FROM forks")
def fork_detect(spark, d):
    return _lists(graph.forks(src.path_ends(spark, d)), "incoming", "outgoing")


@query(f"""WITH {G_SQL}, member AS (SELECT case_id, node, incoming, outgoing, unnest(list_distinct(list_concat(incoming, outgoing))) AS path_id FROM forks),
info AS (SELECT case_id, path_id, string_agg(node || ':' || CASE WHEN list_contains(incoming, path_id) THEN 'incoming' ELSE 'outgoing' END, ',' ORDER BY node) AS roles,
  list_sort(list_filter(list_distinct(flatten(list(incoming))), lambda p: p <> path_id)) AS before, list_sort(list_filter(list_distinct(flatten(list(outgoing))), lambda p: p <> path_id)) AS behind
  FROM member GROUP BY case_id, path_id)
SELECT case_id, path_id, start_node, end_node, roles, array_to_string(before, ',') AS incoming_paths, array_to_string(behind, ',') AS outgoing_paths FROM ends LEFT JOIN info USING (case_id, path_id)""")
def path_info(spark, d):
    ends = src.path_ends(spark, d)
    rows = graph.path_info(ends, graph.forks(ends), joined=",")
    roles = F.array_join(F.transform("fork_roles", lambda r: F.concat(r["node"].cast("string"), F.lit(":"), r["role"])), ",")
    return rows.withColumn("roles", roles).drop("fork_roles")


@query(f"""WITH {G_SQL}, member AS (SELECT case_id, node, unnest(list_distinct(list_concat(incoming, outgoing))) AS path_id, incoming, outgoing FROM forks)
SELECT case_id, node, list_contains(incoming, path_id) AS is_incoming, len(incoming) AS n_in, len(outgoing) AS n_out FROM member WHERE path_id = 42""")
def fork_context(spark, d):
    rows = graph.forks(src.path_ends(spark, d)).where("array_contains(incoming, 42L) OR array_contains(outgoing, 42L)")
    return rows.select("case_id", "node", F.array_contains("incoming", F.lit(42).cast("long")).alias("is_incoming"), F.size("incoming").cast("long").alias("n_in"), F.size("outgoing").cast("long").alias("n_out"))


@query(f"""WITH {V_SQL}, {L_SQL}, s AS (SELECT path_id AS case_id, seq // 7 AS path_id, seq % 7 AS seq, x * 4 AS x, y * 4 AS y, z * 4 AS z FROM pts),
d AS (SELECT v.case_id, v.i, v.j, v.k, path_id, row_number() OVER (PARTITION BY v.case_id, v.i, v.j, v.k
  ORDER BY (x - i) * (x - i) + (y - j) * (y - j) + (z - k) * (z - k), path_id, seq) AS rn FROM mask v JOIN s ON s.case_id = v.case_id)
SELECT case_id, i, j, k, path_id + 1 AS label FROM d WHERE rn = 1""")
def branch_labels(spark, d):
    at = {"case_id": F.col("path_id"), "path_id": F.floor(F.col("seq") / 7).cast("int"), "seq": F.col("seq") % 7} | {c: F.col(c) * 4 for c in "xyz"}
    return graph.nearest_path_labels(src.masks(spark, d), src.paths(spark, d).withColumns(at), bucket=1, rings=1)


# ------------------------------------------------------------------------------------------------------------ polylines


@query(f"WITH {L_SQL} SELECT path_id, seq, {s6('cum')} AS cum FROM cums")
def path_cumlen(spark, d):
    return rounded(polyline.cumulative_length(src.paths(spark, d)).select("path_id", "seq", "cum"), "cum")


_TARGETS = "want AS (SELECT vec_id AS path_id, CAST(g AS INT) AS target_id, g * 0.75 - 0.5 AS distance FROM embeddings, range(6) AS r(g))"


def _targets(spark, d) -> DataFrame:
    g = F.col("target_id")
    rows = src.read(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("case_id"), F.col("vec_id").alias("path_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("target_id"))
    return rows.withColumn("distance", g * 0.75 - 0.5)


_AT = """held AS (SELECT path_id, target_id, distance, seq, cum, next_cum, x, y, z, qx, qy, qz, least(greatest(distance, 0.0), total) AS d,
  row_number() OVER (PARTITION BY path_id, target_id ORDER BY seq DESC) AS rn
  FROM segs JOIN want USING (path_id) WHERE qx IS NOT NULL AND cum <= least(greatest(distance, 0.0), total)),
at_d AS (SELECT *, CASE WHEN next_cum - cum > 1e-12 THEN least(greatest((d - cum) / (next_cum - cum), 0.0), 1.0) ELSE 0.0 END AS alpha FROM held WHERE rn = 1)"""


@query(f"WITH {L_SQL}, {_TARGETS}, {_AT} SELECT path_id, target_id, {s6('x + alpha * (qx - x)')} AS x, {s6('y + alpha * (qy - y)')} AS y, {s6('z + alpha * (qz - z)')} AS z FROM at_d")
def path_point_at_distance(spark, d):
    return rounded(polyline.points_at_distance(src.paths(spark, d), _targets(spark, d)).select("path_id", "target_id", "x", "y", "z"), "x", "y", "z")


_TAN = """tan AS (SELECT path_id, seq AS segment, hx - lx AS dx, hy - ly AS dy, hz - lz AS dz FROM (
  SELECT a.path_id, a.seq, p.x AS lx, p.y AS ly, p.z AS lz, q.x AS hx, q.y AS hy, q.z AS hz FROM pts a
  JOIN pts p ON p.path_id = a.path_id AND p.seq = greatest(a.seq - 1, 0) JOIN pts q ON q.path_id = a.path_id AND q.seq = least(a.seq + 2, 20) WHERE a.seq < 20)),
units AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS l FROM tan)"""


@query(f"WITH {L_SQL}, {_TAN} SELECT path_id, segment, {s6('dx / l')} AS tx, {s6('dy / l')} AS ty, {s6('dz / l')} AS tz, CASE WHEN segment BETWEEN 1 AND 18 THEN 'local' ELSE 'endpoint' END AS kind FROM units")
def path_tangent(spark, d):
    return rounded(polyline.tangents(src.paths(spark, d)).drop("case_id"), "tx", "ty", "tz")


@query(f"""WITH {L_SQL}, m AS (SELECT path_id, CAST(g AS INT) AS m, least(CAST(floor(g * 20.0 / 62) AS INT), 19) AS s FROM (SELECT DISTINCT path_id FROM pts), range(63) AS r(g))
SELECT path_id, m.m AS seq, {s6('a.x + (m.m * 20.0 / 62 - s) * (b.x - a.x)')} AS x, {s6('a.y + (m.m * 20.0 / 62 - s) * (b.y - a.y)')} AS y
FROM m JOIN pts a USING (path_id) JOIN pts b USING (path_id) WHERE a.seq = s AND b.seq = s + 1""")
def path_interp(spark, d):
    return rounded(polyline.interpolate(src.paths(spark, d), 3).select("path_id", "seq", "x", "y"), "x", "y")


def _queries(spark, d, own: bool) -> DataFrame:
    rows = src.read(spark, d, "embeddings")
    at = [F.get("embedding", n).cast("double").alias(f"p{c}") for n, c in zip((61, 62, 63), "xyz", strict=True)]
    return rows.select((F.col("vec_id") % 10).alias("case_id"), *([F.col("vec_id").alias("path_id")] if own else []), F.col("vec_id").alias("query_id"), *at)


_ASK = "ask AS (SELECT vec_id % 10 AS case_id, vec_id AS query_id, CAST(embedding[62] AS DOUBLE) AS px, CAST(embedding[63] AS DOUBLE) AS py, CAST(embedding[64] AS DOUBLE) AS pz FROM embeddings)"


@query(f"""WITH {L_SQL}, {_ASK}, al AS (SELECT *, least(greatest(((px - x) * (qx - x) + (py - y) * (qy - y) + (pz - z) * (qz - z))
  / ((qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z)), 0.0), 1.0) AS alpha FROM segs JOIN ask ON path_id = query_id WHERE next_cum - cum > 1e-12),
g AS (SELECT *, sqrt((px - x - alpha * (qx - x)) ** 2 + (py - y - alpha * (qy - y)) ** 2 + (pz - z - alpha * (qz - z)) ** 2) AS distance, cum + alpha * (next_cum - cum) AS arc FROM al),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, seq) AS rn FROM g)
SELECT query_id, seq AS segment, {s6('alpha')} AS alpha, {s6('distance')} AS distance, {s6('arc')} AS arc FROM r WHERE rn = 1""")
def path_project_point(spark, d):
    found = polyline.project_points(src.paths(spark, d), _queries(spark, d, True))
    return rounded(found.select("query_id", "segment", "alpha", "distance", "arc"), "alpha", "distance", "arc")


@query(f"""WITH {L_SQL}, {_ASK}, g AS (SELECT c.path_id, c.seq, c.cum, query_id, sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2) AS distance FROM cums c JOIN ask USING (case_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, path_id, seq) AS rn FROM g)
SELECT query_id, path_id, seq, {s6('distance')} AS distance, {s6('cum')} AS arc FROM r WHERE rn = 1""")
def nearest_path(spark, d):
    return rounded(polyline.nearest_vertex(src.paths(spark, d), _queries(spark, d, False)).drop("case_id"), "distance", "arc")


@query(f"""WITH {L_SQL}, {_ASK}, g AS (SELECT c.path_id, c.seq, query_id, sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2) AS distance FROM cums c JOIN ask USING (case_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, path_id, seq) AS rn FROM g)
SELECT query_id, CASE WHEN distance <= 0.1 THEN 'plane' WHEN distance <= 0.2 THEN 'path' END AS picked, CASE WHEN distance <= 0.2 THEN path_id ELSE -1 END AS path_id FROM r WHERE rn = 1""")
def pick_nearest(spark, d):
    near = polyline.nearest_vertex(src.paths(spark, d), _queries(spark, d, False))
    picked = F.when(F.col("distance") <= 0.1, "plane").when(F.col("distance") <= 0.2, "path")
    return near.select("query_id", picked.alias("picked"), F.when(picked.isNotNull(), F.col("path_id")).otherwise(-1).alias("path_id"))


_PLANES = "JOIN units u ON u.path_id = at_d.path_id AND u.segment = at_d.seq"


@query(f"""WITH {L_SQL}, want AS (SELECT path_id, 0 AS target_id, 0.5 * max(cum) AS distance FROM cums GROUP BY path_id), {_AT}, {_TAN}
SELECT at_d.path_id, {s6('x + alpha * (qx - x)')} AS cx, {s6('y + alpha * (qy - y)')} AS cy, {s6('dx / l')} AS nx, {s6('dz / l')} AS nz, {s6('distance')} AS distance FROM at_d {_PLANES}""")
def plane_center(spark, d):
    rows = polyline.centre_planes(src.paths(spark, d)).select("path_id", "cx", "cy", "nx", "nz", "distance")
    return rounded(rows, "cx", "cy", "nx", "nz", "distance")


@query(f"""WITH {L_SQL}, len AS (SELECT case_id, path_id, max(cum) AS total, max(CASE WHEN seq = 10 THEN cum END) AS mid FROM cums GROUP BY ALL),
want AS (SELECT path_id, CAST(g AS INT) AS target_id, CASE WHEN total - 0.5 <= 0.5 THEN mid ELSE 0.5 + g * 0.75 END AS distance FROM len, range(60) AS r(g)
  WHERE CASE WHEN total - 0.5 <= 0.5 THEN g = 0 ELSE g < ceil((total - 0.5 + 1e-8 - 0.5) / 0.75) END), {_AT}, {_TAN},
rows_ AS (SELECT at_d.path_id % 10 AS case_id, at_d.path_id, target_id, distance, x + alpha * (qx - x) AS cx, dy / l AS ny FROM at_d {_PLANES})
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY path_id, target_id) - 1 AS INT) AS plane_index, path_id + 1 AS label, {s6('distance')} AS distance, {s6('cx')} AS cx, {s6('ny')} AS ny FROM rows_""")
def plane_by_distance(spark, d):
    rows = polyline.spaced_planes(src.paths(spark, d), 0.5, 0.5, 0.75)
    return rounded(rows.select("case_id", "plane_index", "label", "distance", "cx", "ny"), "distance", "cx", "ny")


# --------------------------------------------------------------------------------------------------------------- planes


@query(f"""WITH {V_SQL}, pl AS (SELECT vec_id AS case_id, vec_id % 3 AS axis, 1.5 + (vec_id % 4) * 0.25 AS spot FROM embeddings),
cut AS (SELECT mask.case_id, i, j, k FROM mask JOIN pl USING (case_id) WHERE spot >= CASE axis WHEN 0 THEN i WHEN 1 THEN j ELSE k END AND spot < CASE axis WHEN 0 THEN i WHEN 1 THEN j ELSE k END + 1)
SELECT case_id, CAST(count(*) AS BIGINT) AS voxels, {s6('CAST(count(*) AS DOUBLE)')} AS area FROM cut GROUP BY case_id""")
def plane_box_area(spark, d):
    at, axis = 1.5 + (F.col("case_id") % 4) * 0.25, F.col("case_id") % 3
    head = src.volume_meta(spark, d).select(
        "case_id", F.lit(0).alias("plane_index"), *[F.when(axis == n, at).otherwise(1.0).alias(f"c{c}") for n, c in enumerate("xyz")],
        *[F.when(axis == n, 2.0).otherwise(0.0).alias(f"n{c}") for n, c in enumerate("xyz")],
    )
    cut = planes.cut_voxels(head, src.masks(spark, d))
    return cut.groupBy("case_id").agg(F.count("*").alias("voxels"), r6(F.sum("area")).alias("area"))


def _series(spark, d) -> DataFrame:
    heads = src.plane_heads(spark, d)
    return planes.plane_series(src.plane_samples(spark, d), heads.select("case_id", "plane_index", "forward_sign"), src.plane_times(spark, d))


@query(f"WITH {M_SQL} SELECT case_id, plane_index, t, area, flow_signed, flow_forward, flow_reverse, peak, peak_forward, peak_reverse FROM series")
def plane_flow_ts(spark, d):
    return _series(spark, d)


_CYCLE = f"""case_id, plane_index, {s6('area')} AS area, {s6('flow_signed')} AS net_signed, {s6('abs(flow_signed)')} AS net, {s6('flow_forward')} AS net_forward,
  {s6('flow_reverse')} AS net_reverse, peak, peak_forward, peak_reverse, {s6('mean_velocity_signed')} AS mean_velocity_signed,
  {s6('CASE WHEN flow_forward > 1e-12 THEN flow_reverse / flow_forward ELSE 0.0 END')} AS reflux"""


@query(f"WITH {M_SQL} SELECT {_CYCLE} FROM cycle")
def plane_cycle_metrics(spark, d):
    rows = planes.cycle_metrics(_series(spark, d)).drop("times", "flow_signed", "flow_forward", "flow_reverse")
    return rounded(rows, "area", "net_signed", "net", "net_forward", "net_reverse", "mean_velocity_signed", "reflux")


def _metrics(spark, d) -> DataFrame:
    return planes.cycle_metrics(_series(spark, d)).join(src.plane_heads(spark, d).select("case_id", "plane_index", "path_id"), ["case_id", "plane_index"])


_PATH_IC = """dev AS (SELECT case_id, path_id, abs(flow_signed) AS x, avg(abs(flow_signed)) OVER (PARTITION BY case_id, path_id) AS m FROM cycle),
pic AS (SELECT case_id, path_id, count(*) AS planes, any_value(m) AS mean, CASE WHEN count(*) <= 1 THEN 1.0 WHEN any_value(m) <= 1e-12 THEN CASE WHEN max(x) <= 1e-12 THEN 1.0 ELSE 0.0 END
  ELSE least(greatest(1 - avg(abs(x - m)) / any_value(m), 0.0), 1.0) END AS ic FROM dev GROUP BY case_id, path_id)"""


@query(f"WITH {M_SQL}, {_PATH_IC} SELECT case_id, path_id, planes, {s6('mean')} AS mean, {s6('ic')} AS ic FROM pic")
def path_consistency(spark, d):
    return rounded(planes.path_consistency(_metrics(spark, d)), "mean", "ic")


_NET = "net AS (SELECT path_id, start_node AS s, end_node AS e, path_id % 5 AS case_id FROM ends)"


_FORK_IC = f"""{M_SQL}, {_PATH_IC}, {G_SQL}, {_NET},
io AS (SELECT case_id, e AS node, path_id, true AS ends FROM net UNION SELECT case_id, s, path_id, false FROM net),
f AS (SELECT case_id, node FROM io GROUP BY ALL HAVING count(DISTINCT path_id) FILTER (WHERE ends) >= 1 AND (count(DISTINCT path_id) FILTER (WHERE ends) >= 2 OR count(DISTINCT path_id) FILTER (WHERE NOT ends) >= 1)),
fl AS (SELECT io.case_id, io.node, coalesce(sum(CASE WHEN ends THEN mean END), 0.0) AS fi, coalesce(sum(CASE WHEN NOT ends THEN mean END), 0.0) AS fo
  FROM io JOIN f USING (case_id, node) LEFT JOIN pic USING (case_id, path_id) GROUP BY ALL),
fic AS (SELECT case_id, node, fi, fo, CASE WHEN fi + fo <= 1e-12 THEN 1.0 ELSE least(greatest(1 - 2 * abs(fi - fo) / (fi + fo), 0.0), 1.0) END AS ic FROM fl)"""


@query(f"WITH {_FORK_IC} SELECT case_id, node, {s6('fi')} AS flow_in, {s6('fo')} AS flow_out, {s6('ic')} AS ic FROM fic")
def fork_consistency(spark, d):
    net = src.path_ends(spark, d).withColumn("case_id", F.col("path_id") % 5)
    found = planes.fork_consistency(graph.forks(net), planes.path_consistency(_metrics(spark, d)))
    return rounded(found, "flow_in", "flow_out", "ic")


@query(f"WITH {M_SQL} SELECT case_id, plane_index, " + ", ".join(f"max(CASE WHEN t = {t} THEN {v} END) AS {v}_t{t}" for v in ("flow_signed", "area") for t in range(1, 8)) + " FROM series GROUP BY ALL")
def metrics_wide(spark, d):
    return planes.wide_metrics(_series(spark, d), list(range(1, 8)), ["flow_signed", "area"])


@query(f"""WITH {M_SQL}, moved AS (SELECT case_id, plane_index, CASE WHEN plane_index % 10 = 0 THEN -flow_signed ELSE flow_signed END AS f FROM cycle) SELECT case_id, plane_index, {s6('f')} AS net_signed FROM moved""")
def incremental_plane_update(spark, d):
    heads = src.plane_heads(spark, d)
    times, samples = src.plane_times(spark, d), src.plane_samples(spark, d)

    def compute(rows: DataFrame) -> DataFrame:
        return planes.cycle_metrics(planes.plane_series(samples, rows.select("case_id", "plane_index", "forward_sign"), times))

    changed = heads.where("plane_index % 10 = 0").withColumn("forward_sign", -F.col("forward_sign"))
    return rounded(planes.update_plane(heads, changed, compute(heads), compute).select("case_id", "plane_index", "net_signed"), "net_signed")


@query("""SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS ok, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed,
  round(avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'P'), 2) + 0.0 AS mean, round(coalesce(stddev_samp(o_totalprice) FILTER (WHERE o_orderstatus <> 'P'), 0.0), 2) + 0.0 AS std FROM orders""")
def case_timing(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok")
    runs = src.read(spark, d, "orders").select(status.alias("status"), F.col("o_totalprice").alias("seconds"))
    return planes.case_timing(runs).withColumns({c: F.round(c, 2) + 0.0 for c in ("mean", "std")})


@query(f"""WITH {C_SQL}, t AS (SELECT o_orderkey, abs(re0) AS t0, abs(im0) AS t1, abs(re1) AS t2 FROM sig)
SELECT o_orderkey, {s6('(-3 * t0 + 4 * t1 - t2) / 1.2 + (t0 - 2 * t1 + t2) / 0.72 * (1.2 / 14)')} AS parabolic, {s6('(t1 - t0) / 0.6')} AS linear FROM t""")
def wss_gradient(spark, d):
    t0, t1, t2 = (F.abs(F.col(c)) for c in ("re0", "im0", "re1"))
    rows = src.signals(spark, d)
    return rows.select("o_orderkey", r6(surface.wall_gradient(t0, t1, t2, 0.6)).alias("parabolic"), r6(surface.wall_gradient(t0, t1, t2, 0.6, False)).alias("linear"))


@query(f"""WITH {V_SQL}, n AS (SELECT case_id, count(*) AS size FROM mask GROUP BY case_id),
r AS (SELECT case_id, i, j, k, row_number() OVER (PARTITION BY case_id ORDER BY md5('7|' || i || '|' || j || '|' || k), i, j, k) - 1 AS line_id FROM mask)
SELECT case_id, i, j, k, CAST(line_id AS INT) AS line_id FROM r JOIN n USING (case_id) WHERE line_id < least(size, greatest(5, CAST(round_even(size * 0.3, 0) AS BIGINT)))""")
def seed_sample(spark, d):
    return surface.sample_seeds(src.masks(spark, d), 0.3, 7, 5)


# ---------------------------------------------------------------------------------------------------------------- edits


@query(f"""WITH {E_SQL}, ids AS (SELECT DISTINCT case_id, node_id FROM (SELECT case_id, src AS node_id FROM edges UNION SELECT case_id, dst FROM edges)),
kept AS (SELECT case_id, node_id, row_number() OVER (PARTITION BY case_id ORDER BY node_id) - 1 AS new_id FROM ids WHERE node_id % 7 <> 3)
SELECT edges.case_id, a.new_id AS src, b.new_id AS dst FROM edges JOIN kept a ON a.case_id = edges.case_id AND a.node_id = src JOIN kept b ON b.case_id = edges.case_id AND b.node_id = dst""")
def graph_remove_nodes(spark, d):
    edges = src.node_edges(spark, d)
    nodes = graph.degrees(edges).select("case_id", "node_id")
    return edit.remove_nodes(nodes, edges, nodes.where("node_id % 7 = 3"))[1]


@query(f"""WITH {E_SQL}, asked AS (SELECT case_id, least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT case_id, dst AS a, (src + (dst % 2)) % 97 AS b FROM edges) WHERE a <> b),
odd AS (SELECT * FROM asked GROUP BY ALL HAVING count(*) % 2 = 1) (SELECT * FROM edges EXCEPT SELECT * FROM odd) UNION ALL (SELECT * FROM odd EXCEPT SELECT * FROM edges)""")
def toggle_edge(spark, d):
    edges = src.node_edges(spark, d)
    return edit.toggle_edges(edges, edges.select("case_id", F.col("dst").alias("a"), ((F.col("src") + F.col("dst") % 2) % 97).alias("b")))


@query(f"""WITH {L_SQL}, p AS (SELECT case_id, path_id, x, y, z, CASE WHEN path_id % 3 = 0 THEN 0 ELSE 1 END AS on_, sqrt(x * x + y * y + z * z) AS l FROM pts WHERE seq = 0)
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY path_id) - 1 AS INT) AS plane_index, {s6('CASE WHEN on_ = 0 THEN 1.0 ELSE x / l END')} AS nx, {s6('CASE WHEN on_ = 0 THEN 0.0 ELSE y / l END')} AS ny,
  {s6('CASE WHEN on_ = 0 THEN 0.0 ELSE z / l END')} AS nz, CASE WHEN path_id % 2 = 0 THEN 1 ELSE path_id END AS label FROM p""")
def plane_edits(spark, d):
    rows = src.paths(spark, d).where("seq = 0")
    on = F.when(F.col("path_id") % 3 == 0, 0.0).otherwise(1.0)
    table = rows.select("case_id", F.col("path_id").alias("plane_index"), "path_id", *[(F.col(c) * on).alias(f"n{c}") for c in "xyz"], F.lit(0.0).alias("distance"), F.when(F.col("path_id") % 2 == 1, F.col("path_id")).alias("label"))
    return rounded(edit.replace_planes(table).select("case_id", "plane_index", "nx", "ny", "nz", "label"), "nx", "ny", "nz")


@query(f"""WITH {L_SQL}, p AS (SELECT case_id, path_id, x, y, z, sqrt(x * x + y * y + z * z) AS l, path_id % 4 IN (2) AS far, CASE WHEN path_id % 4 = 2 THEN 0.01 ELSE 0.0 END AS up,
  path_id % 3 AS kind, z + 0.5 AS w, sqrt(x * x + y * y + (z + 0.5) * (z + 0.5)) AS m FROM pts WHERE seq = 0 AND abs(x) + abs(y) + abs(z) > 0),
d AS (SELECT *, kind = 1 AND least((x / m - x / l) ** 2 + (y / m - y / l) ** 2 + (w / m - z / l) ** 2, (x / m + x / l) ** 2 + (y / m + y / l) ** 2 + (w / m + z / l) ** 2) > 1e-10 AS turned FROM p)
SELECT case_id, path_id AS plane_index, {s6('z + up')} AS cz, {s6('CASE WHEN turned THEN x / m ELSE x / l END')} AS nx, {s6('CASE WHEN turned THEN y / m ELSE y / l END')} AS ny,
  {s6('CASE WHEN turned THEN w / m ELSE z / l END')} AS nz FROM d WHERE far OR turned""")
def plane_moves(spark, d):
    """Centres that move by half the tolerance or ten times it; normals that turn, flip, or have no length."""
    rows = src.paths(spark, d).where("seq = 0 AND abs(x) + abs(y) + abs(z) > 0")
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    heads = rows.select("case_id", F.col("path_id").alias("plane_index"), *[F.col(c).alias(f"c{c}") for c in "xyz"], *[(F.col(c) / length).alias(f"n{c}") for c in "xyz"])
    up = F.when(F.col("path_id") % 4 == 1, 0.0005).when(F.col("path_id") % 4 == 2, 0.01).when(F.col("path_id") % 4 == 0, 0.0)
    factor = F.when(F.col("path_id") % 3 == 0, -1.0).when(F.col("path_id") % 3 == 1, 1.0).otherwise(0.0)
    more = F.when(F.col("path_id") % 3 == 1, 0.5).otherwise(0.0)
    asked = rows.select("case_id", F.col("path_id").alias("plane_index"), (F.col("z") + up).alias("cz"), (F.col("x") * factor).alias("nx"), (F.col("y") * factor).alias("ny"), (F.col("z") * factor + more).alias("nz"))
    moved = edit.moved_planes(heads, asked)
    return rounded(moved.select("case_id", "plane_index", "cz", "nx", "ny", "nz"), "cz", "nx", "ny", "nz")


# ------------------------------------------------------------------------------------------------------- views and picks


@query(f"WITH {C_SQL} SELECT o_orderkey AS case_id, 0 AS i, 0 AS j, 0 AS k, {s6('sqrt(re0 * re0 + im0 * im0) * sqrt(re0 * re0 + re1 * re1 + im1 * im1)')} AS value FROM sig")
def content_angiogram(spark, d):
    rows = src.signals(spark, d)
    volume = rows.select(F.col("o_orderkey").alias("case_id"), *[F.lit(0).alias(c) for c in "ijk"], signal.magnitude(F.col("re0"), F.col("im0")).alias("mag"), F.col("re0").alias("vx"), F.col("re1").alias("vy"), F.col("im1").alias("vz"))
    return rounded(voxel.content(volume, "angiogram"), "value")


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 3)")
def label_filter(spark, d):
    return voxel.keep_labels(src.read(spark, d, "embeddings").select("vec_id", "label"), [1, 3])


@query(f"""WITH {L_SQL}, {_ASK}, g AS (SELECT c.path_id, c.seq, c.cum, query_id, sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2) AS distance FROM cums c JOIN ask USING (case_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, path_id, seq) AS rn FROM g)
SELECT query_id AS plane_index, path_id, path_id + 1 AS label, {s6('cum')} AS distance FROM r WHERE rn = 1""")
def reproject_planes(spark, d):
    saved = _queries(spark, d, False).select("case_id", F.col("query_id").alias("plane_index"), *[F.col(f"p{c}").alias(f"c{c}") for c in "xyz"], F.lit(0).alias("path_id"))
    return rounded(polyline.reproject_planes(saved, src.paths(spark, d)).select("plane_index", "path_id", "label", "distance"), "distance")


@query(f"""WITH {L_SQL}, {_ASK}, n AS (SELECT query_id, path_id * 21 + seq AS node_id, sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2) AS dn FROM pts JOIN ask USING (case_id)),
bn AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dn, node_id) = 1),
al AS (SELECT *, least(greatest(((px - x) * (qx - x) + (py - y) * (qy - y) + (pz - z) * (qz - z)) / ((qx - x) ** 2 + (qy - y) ** 2 + (qz - z) ** 2), 0.0), 1.0) AS alpha FROM segs JOIN ask USING (case_id) WHERE qx IS NOT NULL),
e AS (SELECT query_id, path_id * 21 + seq AS src, sqrt((px - x - alpha * (qx - x)) ** 2 + (py - y - alpha * (qy - y)) ** 2 + (pz - z - alpha * (qz - z)) ** 2) AS de FROM al),
be AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY de, src) = 1)
SELECT query_id, CASE WHEN de < 0.7 * dn THEN 'edge' ELSE 'node' END AS picked, CASE WHEN de < 0.7 * dn THEN -1 ELSE node_id END AS node_id, CASE WHEN de < 0.7 * dn THEN src ELSE -1 END AS src FROM bn JOIN be USING (query_id)""")
def pick_edge(spark, d):
    points = src.paths(spark, d).withColumn("node_id", F.col("path_id") * 21 + F.col("seq"))
    edges = points.where("seq < 20").select("case_id", F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst"))
    found = graph.pick_edge_or_node(points.select("case_id", "node_id", "x", "y", "z"), edges, _queries(spark, d, False))
    return found.select("query_id", "picked", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("node_id", "src")])


@query(f"""WITH {V_SQL}, r AS (SELECT case_id, i, j, k, count(*) OVER (PARTITION BY case_id) AS n, row_number() OVER (PARTITION BY case_id ORDER BY md5('3|0|' || i || '|' || j || '|' || k), i, j, k) - 1 AS line_id FROM mask WHERE k = 1)
SELECT case_id, CAST(line_id AS INT) AS line_id, i + 0.5 AS x, j + 0.5 AS y, k + 0.5 AS z FROM r WHERE line_id < greatest(2, ceil(n * 0.5))""")
def plane_seeds(spark, d):
    head = src.volume_meta(spark, d).select("case_id", F.lit(0).alias("plane_index"), *[F.lit(v).alias(f"c{c}") for c, v in zip("xyz", (2.0, 2.0, 1.5), strict=True)], F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    cut = planes.cut_voxels(head, src.masks(spark, d).drop("voxel"))
    return surface.plane_seeds(cut, 0.5, 3, 2).drop("plane_index")


# ------------------------------------------------------------------------------------------- iterative kernels, rows only


def _marked(spark, d) -> DataFrame:
    edges = src.node_edges(spark, d)
    return edges.join(graph.triangle_edges(edges).withColumn("in_triangle", F.lit(True)), ["case_id", "src", "dst"], "left").fillna(False, ["in_triangle"])


#: A triangle's edge stays if nothing but it joins its ends among the edges outside of triangles and the later ones.
_PRUNED = f"""WITH RECURSIVE {E_SQL}, {_TRI},
marks AS (SELECT case_id, a AS src, b AS dst FROM tri UNION SELECT case_id, b, c FROM tri UNION SELECT case_id, a, c FROM tri),
free AS (SELECT * FROM edges EXCEPT SELECT * FROM marks),
links AS (
  SELECT case_id, src, dst, src AS a, dst AS b, false AS inside FROM free UNION ALL SELECT case_id, src, dst, dst, src, false FROM free UNION ALL
  SELECT case_id, src, dst, src, dst, true FROM marks UNION ALL SELECT case_id, src, dst, dst, src, true FROM marks),
seen(case_id, src, dst, node) AS (
  SELECT case_id, src, dst, src FROM marks UNION
  SELECT s.case_id, s.src, s.dst, l.b FROM seen s JOIN links l ON l.case_id = s.case_id AND l.a = s.node
    AND (NOT l.inside OR l.src > s.src OR (l.src = s.src AND l.dst > s.dst)))
SELECT * FROM free UNION ALL (SELECT * FROM marks EXCEPT SELECT case_id, src, dst FROM seen WHERE node = dst)"""

#: Each chain walked from both ends; the smaller start, then step, names it.
_CHAINS = f"""WITH RECURSIVE {E_SQL},
arcs AS (SELECT case_id, src AS a, dst AS b FROM edges UNION ALL SELECT case_id, dst, src FROM edges),
deg AS (SELECT case_id, a AS node, count(*) AS n FROM arcs GROUP BY ALL),
walk(case_id, start, step, behind, here, seq) AS (
  SELECT arcs.case_id, a, b, a, b, 1 FROM arcs JOIN deg ON deg.case_id = arcs.case_id AND node = a AND n <> 2 UNION ALL
  SELECT w.case_id, start, step, here, arcs.b, seq + 1 FROM walk w JOIN deg ON deg.case_id = w.case_id AND node = here AND n = 2
    JOIN arcs ON arcs.case_id = w.case_id AND arcs.a = here AND arcs.b <> behind),
kept AS (
  SELECT w.case_id, start, step, row_number() OVER (PARTITION BY w.case_id ORDER BY start, step) - 1 AS path_id
  FROM walk w JOIN deg ON deg.case_id = w.case_id AND node = here AND n <> 2 WHERE start < here OR (start = here AND step <= behind))
SELECT case_id, CAST(path_id AS INT) AS path_id, CAST(seq AS INT) AS seq, node_id FROM (
  SELECT case_id, path_id, 0 AS seq, start AS node_id FROM kept UNION ALL
  SELECT case_id, path_id, seq, here FROM walk JOIN kept USING (case_id, start, step))"""


@query(_PRUNED)
def prune_triangles(spark, d):
    return kernels.prune_triangles(_marked(spark, d))


@query(_PRUNED)
def prune_triangles_rounds(spark, d):
    return rounds.prune_triangles(_marked(spark, d))


@query(_CHAINS)
def trace_paths(spark, d):
    return kernels.trace_paths(src.node_edges(spark, d))


@query(_CHAINS)
def trace_paths_rounds(spark, d):
    return rounds.trace_paths(src.node_edges(spark, d))


#: Published weights of seven points and a cubic: inside, at the second and at the third place; in 42nds.
_INSIDE, _SECOND, _THIRD = (-4, 6, 12, 14, 12, 6, -4), (8, 19, 16, 6, -4, -7, 4), (-4, 16, 19, 12, 2, -4, 1)


def _weights() -> str:
    rows = [(0, 0, 42), (20, 20, 42)] + [(r, r - 3 + m, w) for r in range(3, 18) for m, w in enumerate(_INSIDE)]
    rows += [(r, m, w) for r, ws in ((1, _SECOND), (2, _THIRD)) for m, w in enumerate(ws)] + [(20 - r, 20 - m, w) for r, ws in ((1, _SECOND), (2, _THIRD)) for m, w in enumerate(ws)]
    return "weights(seq, other, w) AS (VALUES " + ", ".join(f"({a}, {b}, {w} / 42.0)" for a, b, w in rows) + ")"


@query(f"""WITH {L_SQL}, {_weights()} SELECT case_id, path_id, CAST(weights.seq AS INT) AS seq, {s6('sum(w * x)')} AS x, {s6('sum(w * y)')} AS y, {s6('sum(w * z)')} AS z
  FROM pts JOIN weights ON pts.seq = weights.other GROUP BY case_id, path_id, weights.seq""")
def savgol_smooth(spark, d):
    return rounded(kernels.smooth_paths(src.paths(spark, d), 7, 3), "x", "y", "z")


def _mirrored(place: str, lo: str, hi: str) -> str:
    """A place outside lo to hi, mirrored at the border (the border's own cell counts twice)."""
    n, t = f"({hi} - {lo} + 1)", f"({place} - {lo})"
    for outside, inside in (("{t} < 0", "-{t} - 1"), ("{t} >= {n}", "2 * {n} - 1 - {t}"), ("{t} < 0", "-{t} - 1")):
        t = f"(CASE WHEN {outside.format(t=t, n=n)} THEN {inside.format(t=t, n=n)} ELSE {t} END)"
    return f"{t} + {lo}"


@query(f"""{_CC}, parts AS (SELECT case_id, component, i, j, k FROM comp JOIN mask USING (case_id, voxel)),
b AS (SELECT case_id, component, min(i) AS li, max(i) AS hi, min(j) AS lj, max(j) AS hj, min(k) AS lk, max(k) AS hk FROM parts GROUP BY ALL),
raw(d, w) AS (VALUES (-2, exp(-8.0)), (-1, exp(-2.0)), (0, 1.0), (1, exp(-2.0)), (2, exp(-8.0))), taps AS (SELECT d, w / (1 + 2 * exp(-2.0) + 2 * exp(-8.0)) AS w FROM raw),
cells AS (SELECT b.*, x.g AS ci, y.g AS cj, z.g AS ck FROM b, range(4) AS x(g), range(4) AS y(g), range(4) AS z(g) WHERE x.g BETWEEN li AND hi AND y.g BETWEEN lj AND hj AND z.g BETWEEN lk AND hk),
around AS (SELECT case_id, component, ci, cj, ck, p.w * q.w * r.w AS w, {_mirrored('(ci + p.d)', 'li', 'hi')} AS i, {_mirrored('(cj + q.d)', 'lj', 'hj')} AS j, {_mirrored('(ck + r.d)', 'lk', 'hk')} AS k
  FROM cells, taps AS p, taps AS q, taps AS r)
SELECT case_id, CAST(ci AS INT) AS i, CAST(cj AS INT) AS j, CAST(ck AS INT) AS k FROM around JOIN parts USING (case_id, component, i, j, k)
  GROUP BY case_id, component, ci, cj, ck HAVING sum(w) > 0.5""")
def gaussian_mask(spark, d):
    return kernels.gaussian_mask(_components(spark, d))


@query()
def skeletonize(spark, d):
    return kernels.skeletonize(_components(spark, d))


@query()
def skeletonize_bricks(spark, d):
    return bricks.skeletonize(_components(spark, d), side=2)


@query()
def laplace_smooth(spark, d):
    loops = voxel.face_loops(voxel.boundary_faces(src.masks(spark, d)), lambda i, j, k: (i * 5 + j) * 5 + k)
    return rounded(kernels.smooth_surface(voxel.loop_vertices(loops), voxel.loop_edges(loops), 50), "x", "y", "z")


@query()
def cut_region(spark, d):
    head = src.volume_meta(spark, d).select("case_id", F.lit(0).alias("plane_index"), *[F.lit(1.7).alias(f"c{c}") for c in "xyz"], F.lit(1.0).alias("nx"), F.lit(0.5).alias("ny"), F.lit(0.25).alias("nz"))
    cut = planes.cut_voxels(head, src.masks(spark, d).drop("voxel"))
    return rounded(kernels.nearest_region(cut).select("case_id", "i", "j", "k", "area"), "area")


def _bent_flow(spark, d) -> tuple[DataFrame, DataFrame]:
    flow = src.masks(spark, d).select("case_id", F.lit(0).alias("t"), "i", "j", "k", F.lit(100.0).alias("vx"), (F.col("j") * 25.0).alias("vy"), F.lit(0.0).alias("vz"))
    seeds = surface.sample_seeds(src.masks(spark, d), 0.1, 0, 3).select("case_id", "line_id", *[(F.col(c) + 0.5).alias(p) for c, p in zip("ijk", "xyz", strict=True)])
    return flow, seeds


@query()
def rk4_streamlines(spark, d):
    return rounded(kernels.streamlines(*_bent_flow(spark, d), max_steps=50), "x", "y", "z", "speed")


@query()
def rk4_streamlines_bricks(spark, d):
    return rounded(bricks.streamlines(*_bent_flow(spark, d), max_steps=50, side=2), "x", "y", "z", "speed")


@query(f"""WITH {L_SQL}, sums AS (SELECT path_id, sum((qx - x) + 0.2 * (qy - y)) AS score, sum(sqrt(1.04) * sqrt((qx - x) ** 2 + (qy - y) ** 2 + (qz - z) ** 2)) AS scale
  FROM segs WHERE qx IS NOT NULL GROUP BY path_id)
SELECT path_id, CAST(CASE WHEN score < 0 THEN 20 - seq ELSE seq END AS INT) AS seq, {s6('x')} AS x, score < 0 AS reversed, {s6('score / scale')} AS confidence FROM pts JOIN sums USING (path_id)""")
def orient_paths(spark, d):
    flow = src.paths(spark, d).select("case_id", "path_id", "seq", F.lit(1.0).alias("vx"), F.lit(0.2).alias("vy"), F.lit(0.0).alias("vz"))
    return rounded(polyline.orient_by_flow(src.paths(spark, d), flow).select("path_id", "seq", "x", "reversed", "confidence"), "x", "confidence")


@query(f"""WITH {L_SQL}, want AS (SELECT path_id, 0 AS target_id, 0.5 * max(cum) AS distance FROM cums GROUP BY path_id), {_AT}, {_TAN},
c AS (SELECT at_d.path_id % 10 AS case_id, at_d.path_id, CASE WHEN at_d.path_id % 3 = 0 THEN dz / l WHEN at_d.path_id % 2 = 1 THEN -1.0 ELSE 1.0 END AS cos FROM at_d {_PLANES})
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY path_id) - 1 AS INT) AS plane_index, CAST(CASE WHEN cos < 0 THEN -1 ELSE 1 END AS INT) AS forward_sign,
  CASE WHEN abs(cos) >= 0.1 THEN 'flow_tangent' ELSE 'geometry_fallback' END AS forward_sign_source, {s6('cos')} AS normal_tangent_cos FROM c""")
def plane_forward_sign(spark, d):
    along = F.col("path_id") % 3 == 0
    turn = F.when(F.col("path_id") % 2 == 1, -1.0).otherwise(1.0)
    heads = polyline.centre_planes(src.paths(spark, d))
    heads = heads.withColumns({f"n{c}": F.when(along, F.lit(1.0 if c == "z" else 0.0)).otherwise(turn * F.col(f"n{c}")) for c in "xyz"})
    return rounded(planes.forward_signs(heads, src.paths(spark, d)).select("case_id", "plane_index", "forward_sign", "forward_sign_source", "normal_tangent_cos"), "normal_tangent_cos")


@query(f"""WITH {V_SQL}, {_STEPS}, kept AS (SELECT case_id, i + di AS i, j + dj AS j, k + dk AS k FROM mask, cross_steps),
core AS (SELECT case_id, i, j, k FROM kept GROUP BY ALL HAVING count(*) = 7)
SELECT DISTINCT case_id, CAST(i + di AS INT) AS i, CAST(j + dj AS INT) AS j, CAST(k + dk AS INT) AS k FROM core, cross_steps
  WHERE i + di BETWEEN 0 AND 3 AND j + dj BETWEEN 0 AND 3 AND k + dk BETWEEN 0 AND 3""")
def binary_open(spark, d):
    return voxel.open_mask(src.masks(spark, d), _whole(spark, d))


@query(f"""WITH {V_SQL}, {L_SQL}, spots AS (SELECT path_id AS case_id, seq, CAST(floor(x * 4) AS INT) AS i, CAST(floor(y * 4) AS INT) AS j, CAST(floor(z * 4) AS INT) AS k FROM pts)
SELECT case_id, seq, coalesce(val, 0.0) AS val FROM spots LEFT JOIN vox USING (case_id, i, j, k)""")
def probe(spark, d):
    points = src.paths(spark, d).select(F.col("path_id").alias("case_id"), "seq", *[(F.col(c) * 4).alias(c) for c in "xyz"])
    return voxel.probe(src.volumes(spark, d), points, ["val"]).select("case_id", "seq", "val")


@query(f"""WITH {_FORK_IC},
member AS (SELECT io.case_id, io.node, io.path_id, bool_or(ends) AS comes FROM io JOIN f USING (case_id, node) GROUP BY ALL),
listed AS (SELECT case_id, path_id, string_agg(node || ':' || CASE WHEN comes THEN 'incoming' ELSE 'outgoing' END || ':' || CAST(round(ic * 10000) AS BIGINT), ',' ORDER BY node) AS forks
  FROM member JOIN fic USING (case_id, node) GROUP BY ALL)
SELECT case_id, plane_index, {s6('coalesce(pic.ic, 1.0)')} AS path_ic, coalesce(forks, '') AS fork_ic
  FROM heads LEFT JOIN pic USING (case_id, path_id) LEFT JOIN listed USING (case_id, path_id)""")
def attach_consistency(spark, d):
    rows = _metrics(spark, d)
    path_ic = planes.path_consistency(rows)
    net = src.path_ends(spark, d).withColumn("case_id", F.col("path_id") % 5)
    forks = graph.forks(net)
    found = planes.attach_consistency(rows, path_ic, forks, planes.fork_consistency(forks, path_ic))
    text = lambda x: F.concat_ws(":", x["node"].cast("string"), x["role"], F.round(x["ic"] * 10000).cast("long").cast("string"))
    return rounded(found.select("case_id", "plane_index", "path_ic", F.array_join(F.transform("fork_ic", text), ",").alias("fork_ic")), "path_ic")


# ------------------------------------------------------------------------------------------- polygons, volumes, oblique views

#: A plane for each volume, by its number: 125 directions through one place.
_TILTED = ("case_id % 5 - 2", "case_id // 5 % 5 - 2", "case_id // 25 % 5 - 2")
_MIDDLE = (2.03, 1.91, 2.17)

#: Areas and first moments as alternating sums over the corners that a plane has passed, without the polygons themselves.
_MOMENTS = f"""raw AS (SELECT vec_id AS case_id FROM embeddings),
tilt AS (SELECT case_id, CASE WHEN l = 0 THEN 1.0 ELSE a / l END AS nx, CASE WHEN l = 0 THEN 0.0 ELSE b / l END AS ny, CASE WHEN l = 0 THEN 0.0 ELSE c / l END AS nz FROM (
  SELECT case_id, a, b, c, sqrt(a * a + b * b + c * c) AS l FROM (SELECT case_id, {_TILTED[0]} AS a, {_TILTED[1]} AS b, {_TILTED[2]} AS c FROM raw))),
met AS (SELECT mask.case_id, i, j, k, nx, ny, nz, abs(nx) AS ax, abs(ny) AS ay, abs(nz) AS az, nx * ({_MIDDLE[0]} - i) + ny * ({_MIDDLE[1]} - j) + nz * ({_MIDDLE[2]} - k)
  + greatest(-nx, 0.0) + greatest(-ny, 0.0) + greatest(-nz, 0.0) AS d, CAST(nx <> 0 AS INT) + CAST(ny <> 0 AS INT) + CAST(nz <> 0 AS INT) AS m FROM mask JOIN tilt USING (case_id)),
passed AS (SELECT *, d - p * ax - q * ay - r * az AS reach, CASE WHEN (p + q + r) % 2 = 1 THEN -1 ELSE 1 END / (CASE WHEN m = 3 THEN 2.0 ELSE 1.0 END
    * CASE WHEN ax > 0 THEN ax ELSE 1.0 END * CASE WHEN ay > 0 THEN ay ELSE 1.0 END * CASE WHEN az > 0 THEN az ELSE 1.0 END) AS w
  FROM met, range(2) AS x(p), range(2) AS y(q), range(2) AS z(r) WHERE (ax > 0 OR p = 0) AND (ay > 0 OR q = 0) AND (az > 0 OR r = 0)),
parts AS (SELECT *, w * pow(reach, m - 1) AS s, CASE WHEN ax > 0 THEN p + reach / (m * ax) ELSE 0.5 END AS ux, CASE WHEN ay > 0 THEN q + reach / (m * ay) ELSE 0.5 END AS uy,
  CASE WHEN az > 0 THEN r + reach / (m * az) ELSE 0.5 END AS uz FROM passed WHERE reach >= 0),
added AS (SELECT case_id, i, j, k, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, sum(s) AS area, sum(s * ux) / sum(s) AS ux, sum(s * uy) / sum(s) AS uy, sum(s * uz) / sum(s) AS uz
  FROM parts GROUP BY case_id, i, j, k HAVING sum(s) > 1e-9),
poly AS (SELECT case_id, i, j, k, area, i + CASE WHEN nx < 0 THEN 1 - ux ELSE ux END AS px, j + CASE WHEN ny < 0 THEN 1 - uy ELSE uy END AS py, k + CASE WHEN nz < 0 THEN 1 - uz ELSE uz END AS pz FROM added)"""


def _tilted(spark, d) -> DataFrame:
    case = F.col("case_id")
    parts = (case % 5 - 2, F.floor(case / 5) % 5 - 2, F.floor(case / 25) % 5 - 2)
    head = src.volume_meta(spark, d).select(
        "case_id", F.lit(0).alias("plane_index"), (case % 7).cast("int").alias("path_id"), *[F.lit(Decimal(str(v))).alias(f"c{c}") for c, v in zip("xyz", _MIDDLE, strict=True)],
        *[v.cast("double").alias(f"n{c}") for c, v in zip("xyz", parts, strict=True)],
    )
    cut = planes.cut_voxels(head, src.masks(spark, d).drop("voxel"), (1, 1, 1), (0, 0, 0)).where("area > 1e-9")
    return polygons.polygons(cut.join(head.select("case_id", "plane_index", "path_id"), ["case_id", "plane_index"]))


@query(f"WITH {V_SQL}, {_MOMENTS} SELECT case_id, i, j, k, {s6('area')} AS area, {s6('px')} AS px, {s6('py')} AS py, {s6('pz')} AS pz FROM poly")
def cut_polygons(spark, d):
    return rounded(_tilted(spark, d).select("case_id", "i", "j", "k", "area", "px", "py", "pz"), "area", "px", "py", "pz")


@query(f"""WITH RECURSIVE {V_SQL}, {_MOMENTS}, numbered AS (SELECT *, (i * 4 + j) * 4 + k AS cell FROM poly),
near AS (SELECT a.case_id, a.cell AS here, b.cell AS there FROM numbered a JOIN numbered b ON a.case_id = b.case_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1),
reach(case_id, root, cell) AS (SELECT case_id, cell, cell FROM numbered UNION SELECT r.case_id, r.root, n.there FROM reach r JOIN near n ON n.case_id = r.case_id AND n.here = r.cell),
comp AS (SELECT case_id, cell, min(root) AS region FROM reach GROUP BY ALL),
ranked AS (SELECT case_id, region, round(min(sqrt((px - {_MIDDLE[0]}) ** 2 + (py - {_MIDDLE[1]}) ** 2 + (pz - {_MIDDLE[2]}) ** 2)), 9) AS gap, round(sum(area), 9) AS size
  FROM comp JOIN numbered USING (case_id, cell) GROUP BY ALL),
best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY gap, size DESC, region) = 1)
SELECT case_id, i, j, k, {s6('area')} AS area FROM numbered JOIN comp USING (case_id, cell) JOIN best USING (case_id, region)""")
def polygon_region(spark, d):
    return rounded(kernels.nearest_region(_tilted(spark, d).drop("corners")).select("case_id", "i", "j", "k", "area"), "area")


@query(f"""WITH {V_SQL}, {_MOMENTS}, r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY md5((5 + 104729 * (case_id % 7) + t) || '|0|' || i || '|' || j || '|' || k), i, j, k) - 1 AS line_id
  FROM poly, range(3) AS times(t) WINDOW w AS (PARTITION BY case_id, t))
SELECT case_id, CAST(t AS INT) AS t, CAST(line_id AS INT) AS line_id, {s6('px')} AS x, {s6('py')} AS y, {s6('pz')} AS z FROM r WHERE line_id < greatest(2, ceil(n * 0.25))""")
def polygon_seeds(spark, d):
    times = src.volume_meta(spark, d).select("case_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t"))
    return rounded(surface.plane_seeds(_tilted(spark, d), 0.25, 5, 2, times).drop("plane_index"), "x", "y", "z")


@query(f"""WITH {L_SQL}, spots AS (SELECT path_id % 10 AS case_id, CAST(path_id % 3 AS INT) AS t, CAST(least(greatest(round_even((x + 0.5) / 0.25, 0), 0), 1 + path_id % 10) AS INT) AS i,
  CAST(least(greatest(round_even((y + 0.5) / 0.25, 0), 0), 2) AS INT) AS j, CAST(least(greatest(round_even((z + 0.5) / 0.25, 0), 0), 3) AS INT) AS k, x * y AS s FROM pts)
SELECT case_id, t, i, j, k, greatest(0.0, max(s)) AS value FROM spots GROUP BY ALL""")
def wss_volume(spark, d):
    rows = src.paths(spark, d).select("case_id", (F.col("path_id") % 3).cast("int").alias("t"), "x", "y", "z", (F.col("x") * F.col("y")).alias("value"))
    dims = rows.select("case_id").distinct().withColumn("dims", F.array(F.col("case_id").cast("int") + 2, F.lit(3), F.lit(4)))
    return voxel.scatter_max(rows, (-0.5, -0.5, -0.5), (0.25, 0.25, 0.25), dims)


@query(f"""WITH {V_SQL}, v AS (SELECT DISTINCT case_id, i + p AS vi, j + q AS vj, k + r AS vk FROM mask, range(2) AS x(p), range(2) AS y(q), range(2) AS z(r))
SELECT v.case_id, CAST(vi AS INT) AS vi, CAST(vj AS INT) AS vj, CAST(vk AS INT) AS vk, coalesce(val, 0.0) AS value FROM v
  LEFT JOIN (SELECT * FROM vox WHERE val > 0) m ON m.case_id = v.case_id AND i = least(vi, 3) AND j = least(vj, 3) AND k = least(vk, 3)""")
def tke_mesh(spark, d):
    return voxel.mesh_values(src.volumes(spark, d).where("val > 0"), src.masks(spark, d), src.volume_meta(spark, d), "val")


#: Each volume on a plane of its own random direction, a frame and a grid of nine by nine, straight from the definitions.
_OBLIQUE = f"""dir AS (SELECT path_id AS case_id, x / (l + 1e-12) AS nx, y / (l + 1e-12) AS ny, z / (l + 1e-12) AS nz, 1.5 + x AS cx, 1.5 + y AS cy, 1.5 + z AS cz
  FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM pts WHERE seq = 0)),
up AS (SELECT *, CASE WHEN abs(nz) > abs(nx) AND abs(nz) > abs(ny) THEN [0.0, 1.0, 0.0] ELSE [0.0, 0.0, 1.0] END AS h FROM dir),
u0 AS (SELECT *, ny * h[3] - nz * h[2] AS a, nz * h[1] - nx * h[3] AS b, nx * h[2] - ny * h[1] AS c FROM up),
u1 AS (SELECT * EXCLUDE (a, b, c), a / (sqrt(a * a + b * b + c * c) + 1e-12) AS ux, b / (sqrt(a * a + b * b + c * c) + 1e-12) AS uy, c / (sqrt(a * a + b * b + c * c) + 1e-12) AS uz FROM u0),
v0 AS (SELECT *, ny * uz - nz * uy AS a, nz * ux - nx * uz AS b, nx * uy - ny * ux AS c FROM u1),
v1 AS (SELECT *, a / (sqrt(a * a + b * b + c * c) + 1e-12) AS wx, b / (sqrt(a * a + b * b + c * c) + 1e-12) AS wy, c / (sqrt(a * a + b * b + c * c) + 1e-12) AS wz FROM v0),
places AS (SELECT case_id, r.g AS row, s.g AS col, nx, ny, nz, cx + (r.g - 4) * ux + (s.g - 4) * wx AS x, cy + (r.g - 4) * uy + (s.g - 4) * wy AS y, cz + (r.g - 4) * uz + (s.g - 4) * wz AS z
  FROM v1, range(9) AS r(g), range(9) AS s(g)),
tent AS (SELECT case_id, row, col, sum(val * greatest(0, 1 - abs(x - i)) * greatest(0, 1 - abs(y - j)) * greatest(0, 1 - abs(z - k))) AS v FROM places JOIN vox USING (case_id)
  WHERE x BETWEEN 0 AND 3 AND y BETWEEN 0 AND 3 AND z BETWEEN 0 AND 3 GROUP BY ALL)"""


def _oblique(spark, d) -> DataFrame:
    first = src.paths(spark, d).where("seq = 0").select(F.col("path_id").alias("case_id"), F.lit(0).alias("plane_index"), *[(F.lit(1.5) + F.col(c)).alias(f"c{c}") for c in "xyz"], *[F.col(c).alias(f"n{c}") for c in "xyz"])
    return oblique.oblique_grid(first, src.volume_meta(spark, d), 4)


@query(f"WITH {V_SQL}, {L_SQL}, {_OBLIQUE} SELECT case_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, {s6('coalesce(v, 0.0)')} AS value FROM places LEFT JOIN tent USING (case_id, row, col)")
def oblique_slice(spark, d):
    found = oblique.oblique_values(_oblique(spark, d), src.volumes(spark, d).select("case_id", "i", "j", "k", F.col("val").alias("value")), ["value"])
    return rounded(found.select("case_id", "row", "col", "value"), "value")


@query(f"""WITH {V_SQL}, {L_SQL}, {_OBLIQUE} SELECT case_id, CAST(t AS INT) AS t, CAST(row AS INT) AS row, CAST(col AS INT) AS col,
  {s6('coalesce(v, 0.0) * (nx * (t + 1) + ny * 2 - nz * t)')} AS value FROM places CROSS JOIN range(2) AS times(t) LEFT JOIN tent USING (case_id, row, col)""")
def through_plane_view(spark, d):
    times = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("t")
    flow = src.volumes(spark, d).select("case_id", "i", "j", "k", "val", times).select("case_id", "i", "j", "k", "t", (F.col("val") * (F.col("t") + 1)).alias("vx"), (F.col("val") * 2).alias("vy"), (-F.col("val") * F.col("t")).alias("vz"))
    grid = _oblique(spark, d).select("*", times)
    return rounded(oblique.through_plane(grid, flow).drop("plane_index"), "value")


_TIMES = ", ".join(f"max(CASE WHEN t = {t + 1} THEN {s6(v)} END) AS {name}_t{t}" for t in range(7) for name, v in (
    ("flowrate", "way * flow_signed / 100.0"), ("meanv_fwd", "CASE WHEN area > 0 THEN flow_forward / area ELSE 0.0 END"), ("area", "CAST(area AS DOUBLE)")))


@query(f"""WITH {_FORK_IC},
member AS (SELECT io.case_id, io.node, io.path_id, bool_or(ends) AS comes FROM io JOIN f USING (case_id, node) GROUP BY ALL),
first_fork AS (SELECT case_id, path_id, node AS fork0_id, CASE WHEN comes THEN 'incoming' ELSE 'outgoing' END AS fork0_role, ic AS fork0_ic
  FROM member JOIN fic USING (case_id, node) QUALIFY row_number() OVER (PARTITION BY case_id, path_id ORDER BY node) = 1),
lists AS (SELECT case_id, plane_index, {_TIMES} FROM (SELECT *, CASE WHEN plane_index % 2 = 0 THEN 1 ELSE -1 END AS way FROM series) GROUP BY ALL)
SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY plane_index) - 1 AS INT) AS plane_index, CAST(path_id AS INT) AS path_index,
  {s6('abs(flow_signed)')} AS netflow_mL_beat, {s6('CASE WHEN plane_index % 2 = 0 THEN mean_velocity_signed ELSE -mean_velocity_signed END')} AS meanv_cm_s,
  {s6('coalesce(pic.ic, 1.0)')} AS path_ic, fork0_id, fork0_role, {s6('fork0_ic')} AS fork0_ic, CAST(plane_index AS DOUBLE) AS center_x, lists.* EXCLUDE (case_id, plane_index)
  FROM cycle JOIN lists USING (case_id, plane_index) LEFT JOIN pic USING (case_id, path_id) LEFT JOIN first_fork USING (case_id, path_id)""")
def metrics_table(spark, d):
    rows, heads = _metrics(spark, d), src.plane_heads(spark, d)
    net = src.path_ends(spark, d).withColumn("case_id", F.col("path_id") % 5)
    forks, path_ic = graph.forks(net), planes.path_consistency(rows)
    qc = planes.fork_consistency(forks, path_ic)
    own = F.col("plane_index").cast("double")
    heads = heads.select("*", F.lit(1).alias("label"), F.lit(0.0).alias("distance"), own.alias("cx"), *[F.lit(0.0).alias(c) for c in ("cy", "cz", "nx", "ny", "nz")])
    made = documents.plane_documents(heads, planes.attach_consistency(rows, path_ic, forks, qc), _series(spark, d), qc, span=1000)
    texts = made.select(F.lit("cases/none.json").alias("file"), F.to_json(F.struct("case_id", "first", "metrics", "qc")).alias("value"))
    found = documents.metrics_table(documents.parse_documents(materialize(texts, "documents"), parts=True))
    lists = [f"{name}_t{t}" for t in range(7) for name in ("flowrate", "meanv_fwd", "area")]
    values = ["netflow_mL_beat", "meanv_cm_s", "path_ic", "fork0_ic", *lists]
    return rounded(found.select("case_id", "plane_index", "path_index", "fork0_id", "fork0_role", "center_x", *values), *values)
