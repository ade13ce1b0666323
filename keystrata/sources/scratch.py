"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
#: Tables made, by application.
_made: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where that is unset; only a local session may leave it so."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="keystrata-")
    return _own_roots[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/keystrata/{app}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(app, []).append(path)
    return path


def tables_made(spark: SparkSession) -> list[str]:
    """Paths of the tables this application has made and not removed, in order."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def remove_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove tables of this application, all unless ``paths`` says which.  Results that still read
    one of them must be written before."""
    own = _made.get(spark.sparkContext.applicationId, [])
    for path in tables_made(spark) if paths is None else paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in own:
            own.remove(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs at most the tasks that were
    running, and later passes read columns of the table, not the plan behind it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
