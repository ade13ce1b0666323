"""Checkpoint and recovery: snapshot, valid log tail, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.scalars import align8
from keystrata.operators.state import last_writes

# Fixed by the arena's format: where records begin, and the least bump pointer.
LOWEST, LEAST_BUMP = 2052, 2056


def checkpoint(log: DataFrame, keys: list[str], value: str, upto: int) -> DataFrame:
    """State as of a sequence number."""
    return last_writes(log.where(F.col("seq") <= upto), keys, value)


def log_tail(log: DataFrame, after: int) -> DataFrame:
    """What stays of the log once a snapshot covers ``after``; the comparison reaches the scan."""
    return log.where(F.col("seq") > after)


def replay(snapshot: DataFrame, tail: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Snapshot overlaid with the tail; replaying twice gives the same state."""
    columns = [*keys, value, "seq"]
    return last_writes(snapshot.select(columns).unionByName(tail.select(columns)), keys, value)


def before_corruption(entries: DataFrame, bad_sectors: DataFrame) -> DataFrame:
    """Entries that end before the first bad sector; all if none is bad.  One number reaches the driver."""
    bad = bad_sectors.agg(F.min("sector_id")).first()[0]
    return entries if bad is None else entries.where(F.col("last_sector") < bad)


def bounds(entries: DataFrame, arena: int) -> DataFrame:
    """Marks entries that would be written beyond the arena; replay skips them."""
    return entries.withColumn("skipped", F.col("offset") + F.col("size") > arena)


def high_water(entries: DataFrame) -> DataFrame:
    """Highest byte written at or above the record area, and the aligned bump pointer after it."""
    top = F.greatest(F.coalesce(F.max(F.when(F.col("offset") >= LOWEST, F.col("offset") + F.col("size"))), F.lit(LOWEST)), F.lit(LOWEST))
    return entries.agg(top.alias("high_water")).withColumn("bump", align8(F.greatest("high_water", F.lit(LEAST_BUMP))))
