"""The test tables as the domain sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, date_time, mac_address, station_name, value, props of the events."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("date_time"),
        F.col("user_id").alias("mac_address"),
        F.col("event_type").alias("station_name"),
        "value",
        "props",
    )
