"""String compaction: what is live, where it moves, what that frees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.scalars import utf8_bytes
from keystrata.operators.running import sum_before_descending

# Fixed by the arena's format: where the second bank begins, and bytes that one round moves.
BANK, BUDGET = 31457280, 16384


def relocate(live: DataFrame, key: str, text: str, bank: int = BANK) -> DataFrame:
    """Live strings packed in descending key order: (key, len, new_offset); empty ones stay out."""
    sized = live.select(key, utf8_bytes(F.col(text)).alias("len")).where("len > 0")
    return sum_before_descending(sized, key, "len", "_at").select(key, "len", (F.col("_at") + bank).alias("new_offset"))


def within_budget(moved: DataFrame, bank: int = BANK, budget: int = BUDGET) -> DataFrame:
    """The moves one round makes: ends rise with the order, so all before the first that does not fit."""
    return moved.where(F.col("new_offset") + F.col("len") - bank <= budget)


def stats(written: DataFrame, live: DataFrame, text: str) -> DataFrame:
    """Bytes written, live and reclaimable, in one pass over both."""
    size, none = utf8_bytes(F.col(text)), F.lit(0).cast("bigint")
    both = written.select(size.alias("w"), none.alias("l"), none.alias("k")).unionByName(
        live.select(none.alias("w"), size.alias("l"), F.lit(1).cast("bigint").alias("k"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        total("w").alias("written_bytes"), total("l").alias("live_bytes"), total("k").alias("live_strings"), (total("w") - total("l")).alias("garbage_bytes")
    )
