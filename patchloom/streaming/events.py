"""The event log as a stream: current state by analysis, and windows with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Files of events as a stream; ts as a timestamp with a zone, which watermarks need."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def current_state(log: DataFrame) -> DataFrame:
    """The latest event of each user; for output mode complete or update."""
    return log.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"))


def hourly(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by hour and type; events later than that behind the newest are dropped by the watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
