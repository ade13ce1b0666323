"""Running sums over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.sources.scratch import saved

SALT = "_salt"


def celled(df: DataFrame, order: list[Column], name: str, salt: Column | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, cut into cells of about equal size that rise with the order.

    Cells (``_cell``) are range partitions, so a far outlier makes no large cell.  Rows that tie
    are told apart by ``_salt``, so that a value that many rows share makes none either: a hash
    of the row, or ``salt``, which must come out the same when a task runs again (row numbers do
    where ``df`` is a scan).  Nulls sort as in an ORDER BY.
    """
    salted = df.withColumn(SALT, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if salt is None else salt)
    return saved(salted.repartitionByRange(*order, F.col(SALT)).withColumn("_cell", F.spark_partition_id()), name)


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add, for every ``value: name`` of ``sums``, the sum of ``value`` over all rows before this one.

    Cells are summed first, combined map-side; their sums run over one row a cell, and rows
    are sorted within their cell only.  Ties are ordered by a hash of the row.  Every row stays,
    those whose order is null too (first, as Spark sorts; last where descending).
    """
    rows = celled(df, order, "ranges")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.groupBy("_cell")
        .agg(*[F.sum(v).alias(f"_sum_{n}") for v, n in sums.items()])
        .select("_cell", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums.values()])
    )
    within = Window.partitionBy("_cell").orderBy(*order, SALT).rowsBetween(Window.unboundedPreceding, -1)
    totals = [
        (F.col(f"_base_{n}") + F.coalesce(F.sum(v).over(within), F.lit(0))).cast("bigint").alias(n) for v, n in sums.items()
    ]
    return rows.join(bases, "_cell").select(*[F.col(f"`{c}`") for c in df.columns], *totals)


def sum_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows of lesser ``order``; see ``sums_before``."""
    return sums_before(df, [F.col(order).asc()], {value: name})


def sum_before_descending(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """As ``sum_before``, greatest first."""
    return sums_before(df, [F.col(order).desc()], {value: name})
