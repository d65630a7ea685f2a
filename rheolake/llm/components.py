"""Connected components of a graph too large for one machine: large-star and small-star rounds until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rheolake.llm.common import discard, materialize


def _attach_least(edges: DataFrame, made: list[str]) -> DataFrame:
    """edges(u, v) with least: the smallest of u and its neighbours.

    The minimum is combined in every task before it is shuffled.  It is written, so that both sides of the join come from
    plain shuffles and Spark can split a hub's edges among tasks at run time.
    """
    least = _written(edges.groupBy("u").agg(F.min("v").alias("least")), "least", made)
    return edges.join(least, "u").withColumn("least", F.least("u", "least"))


def _written(df: DataFrame, label: str, made: list[str]) -> DataFrame:
    found = materialize(df, label)
    made.append(found.shared_folder)
    return found


def connected_components(edges: DataFrame) -> DataFrame:
    """For edges(u long, v long): each node that has an edge to another (node), and the smallest node it reaches (root).

    Each round is written to the shared folder, so a lost executor costs at most one round, and the tables of the round
    before are deleted; a round's edges never outnumber those of the round before, and only their count and checksum
    reach the driver.
    """
    spark, made = edges.sparkSession, []
    now = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", made)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _attach_least(both, made).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = _written(large, "edges", made)
        star = _attach_least(large, made)
        small = star.select("u", F.col("least").alias("v")).unionByName(
            star.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        )
        now = materialize(small.distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(spark, *made)
        made = [now.shared_folder]
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
