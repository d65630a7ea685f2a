"""Views of plain tables in the shapes of the imaging tables, so that every operator runs on any data set.

V: 64 numbers of an embedding as a 4 x 4 x 4 volume.  L: 63 of them as a path of 21 points.  M: line items as plane
samples over seven times.  G: orders as paths between nodes.  C: orders as complex signals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), F.posexplode("embedding").alias("voxel", "val"))
    place = [F.floor(F.col("voxel") / 16), F.floor(F.col("voxel") / 4) % 4, F.col("voxel") % 4]
    return rows.select("case_id", *[p.cast("int").alias(c) for p, c in zip(place, "ijk", strict=True)], "voxel", F.col("val").cast("double").alias("val"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes(spark, sf_dir).where("val > 0").select("case_id", "i", "j", "k", "voxel")


def volume_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"))
    return rows.withColumn("dims", F.array(*[F.lit(4)] * 3))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("case_id"), F.col("vec_id").alias("path_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("seq"))
    at = [F.get("embedding", 3 * F.col("seq") + n).cast("double").alias(c) for n, c in enumerate("xyz")]
    return rows.select("case_id", "path_id", "seq", *at)


def plane_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_quantity", "l_discount")
    part = F.col("l_partkey")
    return rows.select(
        (part % 5).alias("case_id"), part.alias("plane_index"), F.col("l_linenumber").alias("t"), F.col("l_quantity").cast("long").alias("area"),
        (F.round(F.col("l_discount") * 100).cast("int") - 5).cast("long").alias("proj"),
    )


def plane_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey")
    return rows.select((part % 5).alias("case_id"), part.alias("plane_index"), (part % 50).alias("path_id"), F.when(part % 2 == 0, 1).otherwise(-1).alias("forward_sign"))


def plane_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(5).select(F.col("id").alias("case_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("t"))


def path_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key = F.col("o_orderkey")
    return rows.select((key % 3).alias("case_id"), key.alias("path_id"), (F.col("o_custkey") % 500).alias("start_node"), (key % 700).alias("end_node"))


def node_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges between different nodes: the customers' graph of orders."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    a, b = F.col("o_custkey") % 97, F.col("o_orderkey") % 101
    edges = rows.select((F.col("o_orderkey") % 40).alias("case_id"), F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    return edges.where("src < dst").distinct()


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    parts = {"re0": cust % 89 - 44, "im0": key % 101 - 50, "re1": key % 97 - 48, "im1": cust % 83 - 41}
    return rows.select("o_orderkey", *[v.cast("double").alias(n) for n, v in parts.items()])


#: The same views as common table expressions for an independent SQL engine.
V_SQL = """vox AS (
  SELECT vec_id AS case_id, CAST(p // 16 AS INT) AS i, CAST((p // 4) % 4 AS INT) AS j, CAST(p % 4 AS INT) AS k,
    CAST(p AS INT) AS voxel, CAST(val AS DOUBLE) AS val
  FROM (SELECT vec_id, unnest(embedding) AS val, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)),
mask AS (SELECT case_id, i, j, k, voxel FROM vox WHERE val > 0)"""
L_SQL = """pts AS (
  SELECT vec_id % 10 AS case_id, vec_id AS path_id, CAST(s AS INT) AS seq, CAST(embedding[3 * s + 1] AS DOUBLE) AS x,
    CAST(embedding[3 * s + 2] AS DOUBLE) AS y, CAST(embedding[3 * s + 3] AS DOUBLE) AS z
  FROM embeddings, range(21) AS r(s)),
steps AS (
  SELECT *, lead(x) OVER w AS qx, lead(y) OVER w AS qy, lead(z) OVER w AS qz,
    coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)
      + (z - lag(z) OVER w) * (z - lag(z) OVER w)), 0.0) AS step
  FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
cums AS (SELECT *, sum(step) OVER (PARTITION BY path_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM steps),
segs AS (
  SELECT *, lead(cum) OVER (PARTITION BY path_id ORDER BY seq) AS next_cum, max(cum) OVER (PARTITION BY path_id) AS total
  FROM cums)"""
M_SQL = """samples AS (
  SELECT l_partkey % 5 AS case_id, l_partkey AS plane_index, l_linenumber AS t, CAST(l_quantity AS BIGINT) AS area,
    CAST(round(l_discount * 100) AS BIGINT) - 5 AS proj FROM lineitem),
heads AS (
  SELECT p_partkey % 5 AS case_id, p_partkey AS plane_index, p_partkey % 50 AS path_id,
    CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS forward_sign FROM part),
own AS (SELECT s.*, proj * forward_sign AS along FROM samples s JOIN heads USING (case_id, plane_index)),
sums AS (
  SELECT case_id, plane_index, t, sum(area) AS area, sum(area * along) AS flow_signed,
    sum(CASE WHEN along > 0 THEN area * along END) AS flow_forward, sum(CASE WHEN along < 0 THEN -area * along END) AS flow_reverse,
    max(abs(proj)) AS peak, max(CASE WHEN along > 0 THEN along END) AS peak_forward, max(CASE WHEN along < 0 THEN -along END) AS peak_reverse
  FROM own GROUP BY ALL),
series AS (
  SELECT h.case_id, h.plane_index, path_id, CAST(r.t AS INT) AS t, CAST(coalesce(area, 0) AS BIGINT) AS area,
    CAST(coalesce(flow_signed, 0) AS BIGINT) AS flow_signed, CAST(coalesce(flow_forward, 0) AS BIGINT) AS flow_forward,
    CAST(coalesce(flow_reverse, 0) AS BIGINT) AS flow_reverse, CAST(coalesce(peak, 0) AS BIGINT) AS peak,
    CAST(coalesce(peak_forward, 0) AS BIGINT) AS peak_forward, CAST(coalesce(peak_reverse, 0) AS BIGINT) AS peak_reverse
  FROM heads h CROSS JOIN range(1, 8) AS r(t) LEFT JOIN sums s ON s.case_id = h.case_id AND s.plane_index = h.plane_index AND s.t = r.t),
cycle AS (
  SELECT case_id, plane_index, any_value(path_id) AS path_id, sum(flow_signed) / 7.0 / 100 AS flow_signed,
    sum(flow_forward) / 7.0 / 100 AS flow_forward, sum(flow_reverse) / 7.0 / 100 AS flow_reverse, sum(area) / 7.0 AS area,
    max(peak) AS peak, max(peak_forward) AS peak_forward, max(peak_reverse) AS peak_reverse,
    avg(CASE WHEN area > 0 THEN flow_signed / area ELSE 0.0 END) AS mean_velocity_signed
  FROM series GROUP BY case_id, plane_index)"""
G_SQL = """ends AS (
  SELECT o_orderkey % 3 AS case_id, o_orderkey AS path_id, o_custkey % 500 AS start_node, o_orderkey % 700 AS end_node FROM orders),
touched AS (
  SELECT case_id, path_id, end_node AS node, true AS ends FROM ends UNION ALL
  SELECT case_id, path_id, start_node, false FROM ends),
sides AS (
  SELECT case_id, node, coalesce(list_sort(list(DISTINCT path_id) FILTER (WHERE ends)), []) AS incoming,
    coalesce(list_sort(list(DISTINCT path_id) FILTER (WHERE NOT ends)), []) AS outgoing FROM touched GROUP BY ALL),
forks AS (SELECT * FROM sides WHERE len(incoming) >= 1 AND (len(incoming) >= 2 OR len(outgoing) >= 1))"""
E_SQL = """edges AS (
  SELECT DISTINCT o_orderkey % 40 AS case_id, least(o_custkey % 97, o_orderkey % 101) AS src, greatest(o_custkey % 97, o_orderkey % 101) AS dst
  FROM orders WHERE o_custkey % 97 <> o_orderkey % 101)"""
C_SQL = """sig AS (
  SELECT o_orderkey, CAST(o_custkey % 89 - 44 AS DOUBLE) AS re0, CAST(o_orderkey % 101 - 50 AS DOUBLE) AS im0,
    CAST(o_orderkey % 97 - 48 AS DOUBLE) AS re1, CAST(o_custkey % 83 - 41 AS DOUBLE) AS im1 FROM orders)"""
