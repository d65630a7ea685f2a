"""Plane samples arriving as files, turned into plane series batch by batch.  An extension: imaging work is batch work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SAMPLES = "case_id long, plane_index long, t int, area double, proj double"


def arriving_samples(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_sums(samples: DataFrame) -> DataFrame:
    """Area and flow per plane and time over all that has arrived; state is one row per plane and time."""
    part = F.col("area") * F.col("proj")
    return samples.groupBy("case_id", "plane_index", "t").agg(F.sum("area").alias("area"), F.sum(part).alias("flow"), F.max(F.abs("proj")).alias("peak"))


def series_to(samples: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Feed each batch's changed sums to sink(df, batch); with an idempotent sink nothing is lost or doubled."""
    return running_sums(samples).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
