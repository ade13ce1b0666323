"""The key index: first write wins; lookups give an offset or -1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.operators.running import sum_before_descending

MISS = -1


def put_if_absent(inserts: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Of every key the value inserted first by ``order``; later inserts are ignored."""
    return inserts.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def put_into(index: DataFrame, inserts: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """An index with new inserts: keys it has keep their value; empty keys are not stored."""
    new = put_if_absent(inserts.where(F.octet_length(key) > 0), [key], value, order)
    return index.select(key, value).unionByName(new.join(index, key, "left_anti").select(key, value))


def duplicate_inserts(inserts: DataFrame, keys: list[str]) -> DataFrame:
    return inserts.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") - 1).alias("ignored"))


def multi_get(index: DataFrame, probes: DataFrame, key: str, value: str) -> DataFrame:
    """Every probe with its value, -1 where the key is absent; Catalyst picks the join by size."""
    return probes.join(index.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(MISS)))


def point_get(index: DataFrame, key: str, wanted: str) -> DataFrame:
    """Rows of one key: the equality reaches the scan."""
    return index.where(F.col(key) == wanted)


def prefix_conflicts(keys: DataFrame, key: str) -> DataFrame:
    """Keys that are proper prefixes of other keys, and of how many.

    Each key is exploded into its proper prefixes of lengths that a key has, each cut to a
    length and a 128-bit hash, and these meet the keys in an equi-join, so no pair of keys is
    compared and no long prefix is shuffled.  A key of n characters gives at most as many rows as
    there are lengths of keys below n.
    """
    known = keys.select(F.col(key).alias("prefix")).distinct().withColumn("size", F.length("prefix"))
    # one number for every length that a key has
    sizes = sorted(r["size"] for r in known.where("size > 0").select("size").distinct().collect())
    own = keys.select(F.col(key).alias("_key"))
    shorter = F.filter(F.lit(sizes).cast("array<int>"), lambda n: n < F.length("_key"))
    prefixes = own.select(F.explode(F.transform(shorter, lambda n: F.struct(n.alias("size"), F.md5(F.substring("_key", F.lit(1), n)).alias("h")))).alias("p"))
    counted = prefixes.groupBy("p.size", "p.h").agg(F.count("*").alias("longer_keys"))
    return known.withColumn("h", F.md5("prefix")).join(counted, ["size", "h"]).select("prefix", "longer_keys")


def live_set(index: DataFrame, key: str) -> DataFrame:
    """Keys in descending bytewise order with their place from 0."""
    return sum_before_descending(index.select(key).withColumn("_one", F.lit(1)), key, "_one", "place").drop("_one")
