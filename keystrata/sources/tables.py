"""The driver's tables as inputs of the engine: logs, indexes and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a mutation log: seq, key (user), field (event type), value, props."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "user_id", "event_type", "value", "props"
    )


def customer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as index entries: key, record offset."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("key"), "c_custkey", (F.col("c_custkey") * 64 + 4096).alias("value_offset")
    )
