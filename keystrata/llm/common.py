"""What the operators of this package share: the shared folder, seeded keys, and running ranks."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keystrata.operators.running import SALT
from keystrata.sources.scratch import saved, shared_root

__all__ = ["SPACES", "WORD", "bounded_batches", "free_names", "kept", "marked", "ranked_within", "saved", "seeded_key", "shared_root", "ship", "stratum_of", "text_of", "trimmed", "with_made"]

#: Characters of ``[\x20\x09-\x0D]``, the white space of every contract here.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


#: Most bytes of an Arrow batch, so that a Python worker holds few texts at a time however long they are.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's bound on Arrow batches to ``BATCH_BYTES`` where it is higher or unset.

    The queries and the pipeline do so; operators leave the caller's session as it is.
    """
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if limit is None or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package's modules to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="keystrata-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def with_made(rows: DataFrame, column: str, added: T.StructType, make: Callable, *more: str, keeps: object = None) -> DataFrame:
    """``rows`` and the columns ``added``, made from ``column`` (and ``more``) in Arrow batches.

    ``make`` takes the values of up to 512 rows, a list for each column named, and gives an
    Arrow array for each field of ``added``.  Columns named like an added one are replaced.
    What ``make`` has ``kept`` under ``keeps`` stays with the process for its next task.
    """
    ship(rows.sparkSession)
    new = {n.lower() for n in added.names}
    places = [rows.columns.index(c) for c in (column, *more)]
    kept = [i for i, c in enumerate(rows.columns) if c.lower() not in new]
    schema = T.StructType([rows.schema[i] for i in kept] + added.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for start in range(0, max(1, whole.num_rows), 512):
                batch = whole.slice(start, 512)
                made = make(*[batch.column(i).to_pylist() for i in places])
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made], schema.names)

    return rows.mapInArrow(trimmed(run, keeps), schema)


#: What this process keeps from task to task: the model of one operator at most.
_kept: dict = {}


def kept(key, make: Callable):
    """``make()``, called once and kept for later tasks of the process that are ``trimmed`` with this key."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def only(key) -> None:
    """Drop what the process keeps under other keys, and hand the memory back."""
    others = [k for k in _kept if k != key]
    for k in others:
        del _kept[k]
    if others:
        gc.collect()  # models refer to themselves
    trim()


def trim() -> None:
    """Hand a worker's free memory back, as workers live on from stage to stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def trimmed(run: Callable[[Iterator], Iterator], keeps: object = None) -> Callable[[Iterator], Iterator]:
    """``run`` with ``trim`` after each task.  Before it, all that other tasks of the process kept goes
    but what is kept under ``keeps``."""

    def task(batches: Iterator) -> Iterator:
        only(keeps)
        yield from run(batches)
        trim()

    return task


def free_names(df: DataFrame, count: int) -> list[str]:
    """Column names that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    names = (f"_k{i}" for i in range(count + len(taken)))
    return [n for n in names if n not in taken][:count]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def seeded_key(seed: str, column: str = "doc_id") -> Column:
    """Hexadecimal MD5 of seed and id: the seeded shuffle's order, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))))


def stratum_of(column: str = "source") -> Column:
    """A string that sorts by code point with null last, and tells null from any text."""
    return F.coalesce(F.concat(F.lit("a"), F.col(column)), F.lit("b"))


def ranked_within(cells: DataFrame, stratum: str, order: list[str], value: str) -> DataFrame:
    """Rank and running sum of every row within its stratum, without sorting a stratum in one task.

    ``cells`` comes from ``celled`` by stratum and order (or is a part of its rows): cells are
    summed (combined map-side), the sums run over a stratum's cells, and rows are sorted only
    within their cell.  A stratum with a third of all rows is many small sorts, and so are
    rows that share one id.  ``cells`` is read twice.

    Adds ``rank`` (from 1), ``before`` (sum of ``value`` over earlier rows), ``stratum_rows``
    and ``stratum_sum``.
    """
    whole = Window.partitionBy(stratum)
    earlier = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy(stratum, "_cell")
        .agg(F.count("*").alias("cell_rows"), F.sum(value).alias("cell_sum"))
        .select(
            stratum,
            "_cell",
            F.coalesce(F.sum("cell_rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("cell_sum").over(earlier), F.lit(0)).alias("sum_before"),
            F.sum("cell_rows").over(whole).alias("stratum_rows"),
            F.sum("cell_sum").over(whole).alias("stratum_sum"),
        )
    )
    within = Window.partitionBy(stratum, "_cell").orderBy(*order, SALT)
    return (
        cells.join(offsets, [stratum, "_cell"])
        .withColumn("rank", F.col("rows_before") + F.row_number().over(within))
        .withColumn(
            "before",
            F.col("sum_before")
            + F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("rows_before", "sum_before")
    )


#: Bits of the bitmap of ``marked``; its size is fixed whatever the input.
MARK_BITS = 24


def marked(rows: DataFrame, cell: Column, cells: DataFrame, name: str) -> DataFrame:
    """Add ``marked``: whether the 64-bit hash ``cell`` is among the rows of ``cells`` (column cell).

    The answer comes from a bitmap of 2**24 bits, a table of at most 2**18 rows (4 MB) that every
    task gets: some hashes that are not there are marked too, all of them once it is full.
    """
    mask = (1 << MARK_BITS) - 1
    low = F.col("cell").bitwiseAND(mask)
    words = (
        cells.select(low.alias("cell"))
        .groupBy(F.shiftright("cell", 6).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("_bits"))
    )
    at = cell.bitwiseAND(mask)
    bit = F.expr("shiftrightunsigned(_bits, cast(_at & 63 as int)) & 1 = 1")
    placed = rows.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6))
    return placed.join(F.broadcast(saved(words, name)), "_word", "left").withColumn("marked", F.coalesce(bit, F.lit(False))).drop("_at", "_word", "_bits")
