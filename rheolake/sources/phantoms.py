"""Analytic test cases, generated in Spark."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def straight_tube(spark: SparkSession, cases: int = 1, size: int = 24, length: int = 60, radius: float = 10.0, peak: float = 100.0, times: int = 4, swing: float = 0.5) -> DataFrame:
    """Flow(case_id, i, j, k, t, vx, vy, vz) in a tube along k: a parabola over the radius, pulsing over the cycle."""
    cells = spark.range(cases * size * size * length).select(
        F.floor(F.col("id") / (size * size * length)).cast("int").alias("case_id"), (F.floor(F.col("id") / (size * length)) % size).cast("int").alias("i"),
        (F.floor(F.col("id") / length) % size).cast("int").alias("j"), (F.col("id") % length).cast("int").alias("k"),
    )
    middle = size / 2
    r2 = (F.col("i") + 0.5 - middle) * (F.col("i") + 0.5 - middle) + (F.col("j") + 0.5 - middle) * (F.col("j") + 0.5 - middle)
    tube = cells.withColumn("r2", r2).where(F.col("r2") <= radius * radius)
    at = tube.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("t"))
    pulse = 1 + swing * F.sin(2 * math.pi * F.col("t") / times)
    return at.select("case_id", "i", "j", "k", "t", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), (peak * (1 - F.col("r2") / (radius * radius)) * pulse).alias("vz"))
