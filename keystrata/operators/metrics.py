"""Workload and latency measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.functions.scalars import lcg_next
from keystrata.operators.running import celled

#: Fixed by the format of the queue.
SLOTS = 16


def latency_percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Zero-based element floor(n * q) of the sorted values for q = .5, .95, .99, and the maximum.

    Values are counted first (combined map-side); distinct values are cut into range partitions,
    whose counts give the cell that holds each rank, so no group is sorted in one task.
    """
    counts = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    cells = celled(counts, [F.col(group), F.col(value)], "latencies")
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        cells.groupBy(group, "_cell")
        .agg(F.sum("c").alias("own"))
        .select(F.col(group).alias("_group"), "_cell", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"), F.sum("own").over(whole).alias("n"))
    )
    upto = F.sum("c").over(Window.partitionBy(group, "_cell").orderBy(value))
    ranked = cells.join(bases, "_cell").where(F.col(group).eqNullSafe(F.col("_group"))).withColumn("upto", F.col("base") + upto)
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(q)), F.col(value)))
    return ranked.groupBy(group).agg(
        F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(value).alias("max_value")
    )


def workload_mix(rows: DataFrame, number: str) -> DataFrame:
    """Operations of the mixed workload: a fifth reads, two fifths inserts with update, the rest updates."""
    r = lcg_next(F.col(number)) / F.lit(233280.0)
    op = F.when(r < F.lit(0.2), "read").when(r < F.lit(0.6), "insert_update").otherwise("update")
    return rows.groupBy(op.alias("op")).agg(F.count("*").alias("n"))


def backpressure(rows: DataFrame, number: str, burst: int = 40) -> DataFrame:
    """Arrivals per burst against the queue, which takes one less than its slots."""
    arrivals = F.count("*")
    return rows.groupBy(F.expr(f"{number} div {burst}").alias("burst")).agg(
        arrivals.alias("arrivals"),
        F.least(arrivals, F.lit(SLOTS - 1)).alias("accepted"),
        F.greatest(arrivals - (SLOTS - 1), F.lit(0)).alias("dropped"),
    )


def lcg_stream(spark, workers: int = 4, steps: int = 100) -> DataFrame:
    """Random numbers of each worker: (worker, step, state, r)."""
    start = F.array((F.col("id") + 12345).cast("bigint"))
    states = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda acc, _: F.concat(acc, F.array(lcg_next(F.element_at(acc, -1)))))
    return (
        spark.range(workers, numPartitions=workers)
        .select(F.col("id").alias("worker"), F.posexplode(states).alias("step", "state"))
        .where("step > 0")
        .withColumn("r", F.col("state") / F.lit(233280.0))
    )
