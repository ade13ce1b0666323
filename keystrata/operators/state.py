"""Record state from the mutation log: last write wins by sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_writes(log: DataFrame, keys: list[str], value: str, seq: str = "seq") -> DataFrame:
    """The value written last per key, and its sequence number; combined map-side, idempotent."""
    return log.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def first_writes(log: DataFrame, keys: list[str], values: list[str], seq: str = "seq") -> DataFrame:
    """The oldest entry per key: the head of a key's queue, read without removing it."""
    return log.groupBy(*keys).agg(F.min(seq).alias(seq), *[F.min_by(v, seq).alias(v) for v in values])


def cas_update(expected: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Compare-and-swap: keys whose sequence number is still the expected one may be swapped."""
    now = current.withColumnRenamed("seq", "current_seq")
    return expected.withColumnRenamed("seq", "expected_seq").join(now, keys).withColumn("swapped", F.col("expected_seq") == F.col("current_seq"))
