"""The flusher: a stream of mutations applied as they arrive."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from keystrata.operators.state import last_writes
from keystrata.sources.scratch import fresh_path, saved
from keystrata.sources.store import LOG, Database

#: Kinds of entry in a stream to a store: a change, and a request to checkpoint all before it.
CHANGE, CHECKPOINT = 0, 2
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_log_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Admission of at most ``files_per_batch`` files a batch: a full queue waits, nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _drained(query: StreamingQuery) -> dict:
    """Wait for the end of a stream; gives its cycles: batches, rows, and milliseconds spent."""
    query.awaitTermination()
    cycles = query.recentProgress
    return {
        "cycles": len(cycles),
        "rows": sum(p["numInputRows"] for p in cycles),
        "ms": sum(p["durationMs"].get("triggerExecution", 0) for p in cycles),
    }


def _batches(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What the batches of a stream wrote under ``path``; nothing if none had a row."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return spark.read.schema(T.StructType([f for f in like.schema if f.name != "batch"])).option("recursiveFileLookup", "true").parquet(path)


def apply_stream(log: DataFrame, keys: list[str], value: str, target: str) -> DataFrame:
    """Drain a log stream into ``target`` and give the state.

    Each micro-batch writes its own last writes under its batch number, overwriting what an
    earlier attempt of that batch left; the state is the last write over all batches, so a
    batch that is replayed changes nothing.  An empty stream gives an empty state.
    """
    spark = log.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        last_writes(batch, keys, value).write.mode("overwrite").parquet(f"{target}/applied/batch={number}")

    _drained(log.writeStream.foreachBatch(apply).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start())
    return last_writes(_batches(spark, f"{target}/applied", last_writes(log, keys, value)), keys, value)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stateful_stream(log: DataFrame, keys: list[str], value: str, target: str) -> DataFrame:
    """The same state kept by the stream itself: a stateful aggregation whose updates are appended.

    The state is kept on disk (RocksDB), so it may exceed an executor's memory.
    """
    spark = log.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/updates/batch={number}")

    states = last_writes(log, keys, value)
    updates = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{target}/checkpoint")
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", _ROCKS):
        _drained(updates.trigger(availableNow=True).start())
    return last_writes(_batches(spark, f"{target}/updates", states), keys, value)


def flush_to_store(stream: DataFrame, db: Database, name: str, checkpoint_every: int = 0) -> dict:
    """Drain a stream into the store's log; gives the stream's cycles.

    The stream has kind, order and the columns of the log.  Each micro-batch is one append in
    the order of ``order``, tagged with the stream's name and the batch's number: a batch that
    is replayed after a crash is appended once, and what an earlier attempt left unfinished is
    given up.  An entry of kind ``CHECKPOINT`` asks for a checkpoint of all before it (the last of
    a batch counts); ``checkpoint_every`` makes one after so many batches.  Its progress
    lies in the store, so the flusher resumes where it was stopped.
    """

    def put(rows: DataFrame, tag: str) -> None:
        if db.committed(tag):
            return
        for base, _, own, state in db._statuses():
            if own == tag and state == "pending":
                db.abandon(base)
        db.append(rows.where(F.col("kind") != CHECKPOINT).withColumn("seq", F.col("order")).select(LOG.names), tag)

    def flush(batch: DataFrame, number: int) -> None:
        rows = saved(batch, "flush")
        marker = rows.where(F.col("kind") == CHECKPOINT).agg(F.max("order")).first()[0]
        if marker is not None:
            put(rows.where(F.col("order") < marker), f"{name}-{number}-before")
            db.checkpoint()
            rows = rows.where(F.col("order") > marker)
        put(rows, f"{name}-{number}")
        if checkpoint_every and (number + 1) % checkpoint_every == 0:
            db.checkpoint()

    query = stream.writeStream.foreachBatch(flush).option("checkpointLocation", f"{db.root}/flusher/{name}")
    return _drained(query.trigger(availableNow=True).start())


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a glob, so that one file and a folder of files both serve as a source
    stream = read_log_stream(spark, f"{sf_dir}/events.parque[t]", schema)
    return stream.select(F.col("event_id").alias("seq"), "user_id", "event_type", "value")


def target_path(spark: SparkSession, name: str) -> str:
    return fresh_path(spark, name)
