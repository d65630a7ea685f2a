"""Edits of skeletons, graphs and planes: each gives a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rheolake.functions.vectors import dot, minus, norm, unit_or_x, vec


def remove_rows(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def append_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """more(case_id, x, y, z) behind the nodes of its case, numbered on in the order of its places."""
    top = nodes.groupBy("case_id").agg(F.max("node_id").alias("top"))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("x", "y", "z"))
    new = more.select("case_id", "x", "y", "z", number.alias("number")).join(top, "case_id", "left")
    node = (F.coalesce("top", F.lit(-1)) + F.col("number")).cast(nodes.schema["node_id"].dataType)
    return nodes.unionByName(new.select("case_id", node.alias("node_id"), "x", "y", "z"), allowMissingColumns=True)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes gone(case_id, node_id): the others are numbered anew without gaps, edges at gone nodes go."""
    left = remove_rows(nodes, gone, ["case_id", "node_id"])
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("node_id")) - 1
    numbered = left.withColumn("new_id", number.cast(nodes.schema["node_id"].dataType))
    ids = numbered.select("case_id", "node_id", "new_id")
    end = lambda c: ids.select("case_id", F.col("node_id").alias(c), F.col("new_id").alias(f"new_{c}"))
    moved = edges.join(end("src"), ["case_id", "src"]).join(end("dst"), ["case_id", "dst"])
    new_edges = moved.select("case_id", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    return numbered.withColumn("node_id", F.col("new_id")).drop("new_id"), new_edges


def toggle_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted(case_id, a, b) goes if it is there, either way round, and comes if it is not; loops are ignored."""
    asked = wanted.where("a <> b").select("case_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    odd = asked.groupBy("case_id", "src", "dst").count().where("count % 2 = 1").drop("count")
    key = ["case_id", "src", "dst"]
    return edges.join(odd, key, "left_anti").select(*key).unionByName(odd.join(edges, key, "left_anti"))


def add_planes(planes: DataFrame, more: DataFrame) -> DataFrame:
    """more(case_id, plane_index, cx .. nz, ...) behind the planes of its case, in its own order; see replace_planes."""
    both = planes.withColumn("later", F.lit(0)).unionByName(more.withColumn("later", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("case_id").orderBy("later", "plane_index")
    return replace_planes(both.withColumn("plane_index", F.row_number().over(order)).drop("later"))


def update_planes(planes: DataFrame, changed: DataFrame) -> DataFrame:
    """changed(case_id, plane_index, some columns of planes): its values that are not null take the place of the plane's.

    Planes that are not there are not made; normals have length one again.
    """
    key = ["case_id", "plane_index"]
    new = [c for c in changed.columns if c not in key]
    rows = planes.join(changed.select(*key, F.struct(*new).alias("new_values")), key, "left")
    out = rows.select(*[F.coalesce(F.col(f"new_values.{c}"), F.col(c)).alias(c) if c in new else F.col(c) for c in planes.columns])
    return out.withColumns({f"n{c}": v for c, v in zip("xyz", unit_or_x(vec("n")), strict=True)})


def moved_planes(planes: DataFrame, asked: DataFrame, spacing=(1.0, 1.0, 1.0), least_turn: float = 1e-5) -> DataFrame:
    """The planes that asked(case_id, plane_index, some of cx .. cz and nx .. nz) moves, as they are then.

    A centre counts as moved beyond a thousandth of the mean spacing, at least 1e-4, and a normal beyond least_turn
    either way round; what moves less keeps its old value.  A null part is taken as unmoved, a normal without length too,
    and planes that are not there are not made.  Of several requests for a plane all must agree, or the largest counts.
    """
    key = ["case_id", "plane_index"]
    named = [c for c in ("cx", "cy", "cz", "nx", "ny", "nz") if c in asked.columns]
    new = asked.groupBy(*key).agg(F.max(F.struct(*named)).alias("w")).select(*key, *[F.col(f"w.{c}").alias(f"w{c}") for c in named])
    rows = planes.join(new, key)
    want = {c: F.coalesce(F.col(f"w{c}"), F.col(c)) if c in named else F.col(c) for c in ("cx", "cy", "cz", "nx", "ny", "nz")}
    old_c, new_c = vec("c"), tuple(want[f"c{c}"] for c in "xyz")
    asked_n = tuple(want[f"n{c}"] for c in "xyz")
    old_n, new_n = unit_or_x(vec("n")), unit_or_x(asked_n)
    off = minus(new_c, old_c)
    far = F.sqrt(dot(off, off)) > max(1e-4, sum(spacing) / 3 * 1e-3)
    ahead, back = minus(new_n, old_n), tuple(a + b for a, b in zip(new_n, old_n, strict=True))
    turned = (norm(asked_n) > 1e-12) & (F.sqrt(F.least(dot(ahead, ahead), dot(back, back))) > least_turn)
    rows = rows.withColumns({"_far": F.coalesce(far, F.lit(False)), "_turned": F.coalesce(turned, F.lit(False))}).where("_far OR _turned")
    at = {f"c{c}": F.when(F.col("_far"), v).otherwise(F.col(f"c{c}")) for c, v in zip("xyz", new_c, strict=True)}
    along = {f"n{c}": F.when(F.col("_turned"), v).otherwise(F.col(f"n{c}")) for c, v in zip("xyz", new_n, strict=True)}
    return rows.select(*[{**at, **along}.get(c, F.col(c)).alias(c) for c in planes.columns])


def replace_planes(planes: DataFrame) -> DataFrame:
    """Planes with unit normals, defaults for what is missing (label 1, path 0, distance 0), numbered anew by case."""
    n = unit_or_x(vec("n"))
    order = Window.partitionBy("case_id").orderBy("plane_index")
    out = planes.withColumns({f"n{c}": v for c, v in zip("xyz", n, strict=True)})
    out = out.fillna({"label": 1, "path_id": 0, "distance": 0.0})
    return out.withColumn("plane_index", F.row_number().over(order) - 1)
