"""Record schemas: four field types, packed layout, typed stores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keystrata.functions.scalars import wrap_uint

#: Bytes a field takes in the packed record; strings take a pointer of offset and length.
SIZES = {"uint8": 1, "uint32": 4, "float64": 8, "string": 8}
SPARK_TYPES = {"uint8": "smallint", "uint32": "bigint", "float64": "double", "string": "string"}


@dataclass(frozen=True)
class RecordSchema:
    """Ordered fields of a collection; fixed once declared."""

    fields: tuple[tuple[str, str], ...]

    def __post_init__(self):
        for name, kind in self.fields:
            if kind not in SIZES:
                raise ValueError(f"unknown type {kind} of field {name}")
            if name.isdigit() or name in ("key", "seq"):
                raise ValueError(f"field name {name} is reserved")

    @property
    def total_size(self) -> int:
        return sum(SIZES[kind] for _, kind in self.fields)

    def struct(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{n}` {SPARK_TYPES[k]}" for n, k in self.fields))

    def layout(self, spark: SparkSession, collection: str) -> DataFrame:
        """One row a field: offsets are the running sum of sizes, without alignment."""
        rows = [(collection, i, n, k, SIZES[k]) for i, (n, k) in enumerate(self.fields)]
        df = spark.createDataFrame(rows, "collection string, ord int, field string, type string, size bigint")
        before = Window.partitionBy("collection").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))

    def store(self, name: str, value: Column) -> Column:
        """A value as its field keeps it: wrapped, and zero or empty where it is missing."""
        kind = dict(self.fields)[name]
        if kind.startswith("uint"):
            return wrap_uint(value, int(kind[4:])).cast(SPARK_TYPES[kind])
        zero = F.lit(0.0) if kind == "float64" else F.lit("")
        return F.coalesce(value.cast(SPARK_TYPES[kind]), zero)

    def records(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows as records: key, then all fields; missing fields are zero, other columns are dropped."""
        have = set(rows.columns)
        return rows.select(
            F.col(key).alias("key"),
            *[self.store(n, F.col(n) if n in have else F.lit(None)).alias(n) for n, _ in self.fields],
        )
