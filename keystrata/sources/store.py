"""The record store: databases, collections, a durable log, snapshots, recovery and compaction.

All state is under one root that every executor reaches:

    claims/         a file per append, named by its first sequence number: rows and tag; made atomically,
                    so that of two writers one gets the range and the other goes on behind it
    commits/        a file per claim: "ok" once its rows are written, "gone" if it was given up
    log/            (collection, key, field, seq, u_val, f_val, s_val, start), partitioned by batch
    sectors/        CRC-32 of every 4,092 framed bytes of a batch, partitioned by batch
    snapshots/      the last write of every field, partitioned by version and hash of the key
    manifest/       (version, upto_seq, rows, checksum), written last; the newest that holds counts
    trimmed/        a file per compaction: the number up to which the log was removed

The index is derived from the log (a key's first write), so it recovers with it.
"""

from __future__ import annotations

import os
import uuid
import warnings
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.operators.log import HEADER, SECTOR, checksums_of, frame
from keystrata.operators.running import sums_before
from keystrata.operators.schema import RecordSchema
from keystrata.sources.scratch import saved

LOG = (
    T.StructType()
    .add("collection", "string")
    .add("key", "string")
    .add("field", "string")
    .add("seq", "long")
    .add("u_val", "long")
    .add("f_val", "double")
    .add("s_val", "string")
)
STORED = T.StructType([*LOG.fields, T.StructField("start", T.LongType()), T.StructField("batch", T.LongType())])
SECTORS = T.StructType().add("sector_id", "long").add("crc", "long").add("batch", "long")
MANIFEST = (
    T.StructType().add("version", "long").add("upto_seq", "long").add("rows", "long").add("checksum", T.DecimalType(38, 0))
)
#: Parts of a snapshot by hash of the key, so that a lookup reads one; in each, files are sorted by key.
BUCKETS = 8


class StoreError(RuntimeError):
    """The store cannot give a state that it acknowledged, or another writer took precedence."""


def _value_column(kind: str) -> str:
    return {"float64": "f_val", "string": "s_val"}.get(kind, "u_val")


def _bucket(key: Column) -> Column:
    return (F.crc32(key) % BUCKETS).cast("int")


def payload() -> Column:
    """What the log's checksums cover of a change beside its number."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("collection", "key", "field", "u_val", "f_val")]
    return F.concat_ws("\x1f", *parts, F.coalesce(F.concat(F.lit("+"), "s_val"), F.lit("-")))


class Database:
    """A store under ``root``; opening one that exists recovers it.

    Snapshots and log batches never change once written, so each is verified once an instance.
    Recovery keeps the log up to the first sector whose checksum differs (``corrupt`` names it).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._good: dict[int, bool] = {}
        self._checked: set[int] = set()
        # the manifest's files, and its rows as of then
        self._listed: tuple[list[str], list[tuple]] = ([], [])
        self.corrupt: tuple[int, int] | None = None

    def collection(self, name: str, schema: RecordSchema) -> Collection:
        return Collection(self, name, schema)

    # --- files

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, part: str) -> list[str]:
        fs, place = self._fs(f"{self.root}/{part}")
        return sorted(n for x in fs.listStatus(place) if not (n := x.getPath().getName()).startswith(".")) if fs.exists(place) else []

    def _text(self, path: str) -> str:
        fs, place = self._fs(path)
        stream = fs.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Make a small file with its content, unless there is one: of several that try, one succeeds.

        The content is written aside and linked (local folders) or renamed, which a distributed
        file system refuses where the name is taken.
        """
        folder, _, name = path.rpartition("/")
        fs, aside = self._fs(f"{folder}/.{name}.{uuid.uuid4().hex}")
        fs.mkdirs(aside.getParent())
        out = fs.create(aside)
        out.write(bytearray(text.encode()))
        out.close()
        final = self._fs(path)[1]
        if fs.getUri().getScheme() == "file":
            local = lambda p: Path(p.toUri().getPath())
            try:
                os.link(local(aside), local(final))
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(aside, False)
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            return False
        return True

    def _remove(self, path: str) -> None:
        fs, place = self._fs(path)
        fs.delete(place, True)

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        fs, place = self._fs(f"{self.root}/{part}")
        if not fs.exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{part}")

    # --- writers

    def _claims(self) -> list[tuple[int, int, str]]:
        """First number, rows and tag of every append that the log still knows, in order."""
        found = []
        for name in self._names("claims"):
            rows, _, tag = self._text(f"{self.root}/claims/{name}").partition(" ")
            found.append((int(name), int(rows), tag))
        return found

    def _status(self, base: int) -> str:
        name = f"{base:019d}"
        return self._text(f"{self.root}/commits/{name}") if name in set(self._names("commits")) else "pending"

    def _statuses(self) -> list[tuple[int, int, str, str]]:
        done = set(self._names("commits"))
        state = lambda base: self._text(f"{self.root}/commits/{base:019d}") if f"{base:019d}" in done else "pending"
        return [(base, rows, tag, state(base)) for base, rows, tag in self._claims()]

    def next_seq(self) -> int:
        """The number that the next append begins with."""
        claims = self._names("claims")
        behind = int(claims[-1]) + int(self._text(f"{self.root}/claims/{claims[-1]}").partition(" ")[0]) if claims else 0
        return max([behind, 0, *(int(n) + 1 for n in self._names("trimmed"))])

    def last_seq(self) -> int:
        return self.next_seq() - 1

    def _claim(self, rows: int, tag: str, expected: int | None = None) -> int:
        """Take the next range of sequence numbers; with ``expected`` only if it begins there (else -1)."""
        while True:
            base = self.next_seq()
            if expected is not None and base != expected:
                return -1
            if self._create(f"{self.root}/claims/{base:019d}", f"{rows} {tag}"):
                return base

    def abandon(self, base: int) -> bool:
        """Give up an append whose writer died; false if it was committed after all."""
        return self._create(f"{self.root}/commits/{base:019d}", "gone") or self._status(base) == "gone"

    def pending(self) -> list[int]:
        """Appends that were begun and neither committed nor abandoned."""
        return [base for base, _, _, state in self._statuses() if state == "pending"]

    def committed(self, tag: str) -> bool:
        return any(own == tag and state == "ok" for _, _, own, state in self._statuses())

    def append(self, changes: DataFrame, tag: str = "", expected: int | None = None) -> int:
        """Append changes (collection, key, field, seq, values) behind the log in the order of ``seq``, which may
        be of any type that sorts; gives their first number.

        The range of numbers is claimed first, then rows and sector checksums are written, then
        the commit, which alone makes them visible.  Any number of writers may append at once.
        With ``expected`` nothing is appended (-1) unless the range begins there.
        """
        if self._verified() is not None:
            self.repair()
        size = F.octet_length(payload()).cast("bigint") + HEADER
        sized = changes.select(LOG.names).withColumn("_size", size).withColumn("_one", F.lit(1))
        placed = sums_before(sized, [F.col("seq")], {"_size": "start", "_one": "_at"})
        placed = saved(placed.drop("_size", "_one").withColumn("seq", F.col("_at")).drop("_at").select(*LOG.names, "start"), "append")
        rows = placed.count()
        if not rows:
            return self.next_seq()
        base = self._claim(rows, tag, expected)
        if base < 0:
            return base
        numbered = placed.withColumn("seq", F.col("seq") + base)
        numbered.write.parquet(f"{self.root}/log/batch={base}")
        checksums_of(numbered, [], "start", frame(F.col("seq"), payload())).write.parquet(f"{self.root}/sectors/batch={base}")
        if not self._create(f"{self.root}/commits/{base:019d}", "ok"):
            raise StoreError(f"the append at {base} was given up by another process")
        return base

    # --- readers

    def _stored(self, batches: list[int]) -> DataFrame:
        """Rows of some batches as they are on disk; those of unreadable files are missing."""
        paths = [f"{self.root}/log/batch={b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).option("basePath", f"{self.root}/log").option("ignoreCorruptFiles", "true").parquet(*paths)

    def _visible(self) -> list[int]:
        return [base for base, _, _, state in self._statuses() if state == "ok"]

    def _verified(self) -> tuple[int, int] | None:
        """Batch and sector of the first checksum that differs in the log behind the snapshot, if any."""
        behind = self.newest_snapshot()[1]
        fresh = [base for base, rows, _, state in self._statuses() if state == "ok" and base + rows - 1 > behind and base not in self._checked]
        if self.corrupt is not None and self.corrupt[0] + dict((b, r) for b, r, _ in self._claims()).get(self.corrupt[0], 0) - 1 <= behind:
            self.corrupt = None
        if fresh:
            found = checksums_of(self._stored(fresh), ["batch"], "start", frame(F.col("seq"), payload()))
            sectors = self._read("sectors", SECTORS).where(F.col("batch").isin(fresh))
            both = found.withColumnRenamed("crc", "now").join(sectors, ["batch", "sector_id"], "full")
            bad = both.where(~F.col("crc").eqNullSafe(F.col("now"))).agg(F.min(F.struct("batch", "sector_id"))).first()[0]
            self._checked.update(fresh)
            if bad is not None:
                self.corrupt = min(filter(None, [self.corrupt, (bad.batch, bad.sector_id)]))
                warnings.warn(f"log sector {bad.sector_id} of the append at {bad.batch} does not hold; replay stops there", stacklevel=3)
        return self.corrupt

    def log(self) -> DataFrame:
        """Committed entries with their batch, up to the first sector that does not hold."""
        bad = self._verified()
        rows = self._stored([b for b in self._visible() if bad is None or b <= bad[0]])
        if bad is not None:
            end = F.col("start") + F.octet_length(payload()) + HEADER
            rows = rows.where((F.col("batch") < bad[0]) | (end <= bad[1] * SECTOR))
        return rows.drop("start")

    def manifest(self) -> DataFrame:
        return self._read("manifest", MANIFEST)

    def _snapshots(self) -> list[tuple[int, int]]:
        """Version and last number of the snapshots that hold, newest first."""
        names, out = self._names("manifest"), []
        if names != self._listed[0]:
            self._listed = names, sorted(map(tuple, self.manifest().collect()), reverse=True)
        for row in (Row(*MANIFEST.names)(*x) for x in self._listed[1]):
            if row.version not in self._good:
                found = self.snapshot(row.version).agg(F.count("*"), _checksum()).first()
                self._good[row.version] = tuple(found) == (row.rows, row.checksum)
            if self._good[row.version]:
                out.append((row.version, row.upto_seq))
        return out

    def newest_snapshot(self) -> tuple[int, int]:
        """Version and last sequence number of the newest snapshot that holds; (0, -1) without one.

        Raises where the log that remains does not reach back to it: acknowledged changes would be
        missing.
        """
        trimmed = max([-1, *(int(n) for n in self._names("trimmed"))])
        version, upto = next(iter(self._snapshots()), (0, -1))
        if upto < trimmed:
            raise StoreError(f"no snapshot that holds reaches {trimmed}, up to which the log was removed")
        return version, upto

    def snapshot(self, version: int, key: str | None = None) -> DataFrame:
        """A snapshot's rows; with ``key`` only the part that may hold it."""
        whole = self._read("snapshots", T.StructType([*LOG.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())]))
        own = whole.where(F.col("version") == version)
        return (own if key is None else own.where((F.col("bucket") == _bucket(F.lit(key))) & (F.col("key") == key))).drop("version", "bucket")

    def entries(self, key: str | None = None) -> DataFrame:
        """Snapshot and log tail: all that recovery replays; with ``key`` what it says of one."""
        version, upto = self.newest_snapshot()
        tail = self.log().where(F.col("seq") > upto).drop("batch")
        return self.snapshot(version, key).unionByName(tail if key is None else tail.where(F.col("key") == key))

    # --- snapshots and compaction

    def checkpoint(self, upto: int | None = None) -> int:
        """Write the state as a new snapshot version, then the manifest; a crash in between changes nothing.

        It covers the log up to the first append that is still pending (or ``upto``).
        """
        pending = self.pending()
        last = min([self.last_seq() if upto is None else upto, *(base - 1 for base in pending[:1])])
        names = [int(n) for n in self._names("snapshots") for n in [n.partition("=")[2]] if n.isdecimal()]
        version = max([0, *names, *(v for v, _ in self._snapshots())]) + 1
        newest = _last_writes(self.entries().where(F.col("seq") <= last))
        placed = newest.withColumn("bucket", _bucket(F.col("key"))).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
        placed.write.partitionBy("bucket").parquet(f"{self.root}/snapshots/version={version}")
        rows, total = self.snapshot(version).agg(F.count("*"), _checksum()).first()
        self.spark.createDataFrame([(version, last, rows, total)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def repair(self) -> int:
        """After a corrupt sector: put what holds into a snapshot that covers the log's bad end, so
        that later appends are replayed."""
        version = self.checkpoint()
        if self._verified() is not None:
            raise StoreError("a pending append stands before the corrupt sector; abandon it first")
        return version

    def compact(self) -> dict:
        """Drop overwritten values: a checkpoint, and log batches go that the last two snapshots that hold cover.

        The log back to the older of them stays, so that either one may fail; recovery never
        falls back further than the log reaches.
        """
        size = F.coalesce(F.sum(F.octet_length("s_val")), F.lit(0))
        before = self.log().agg(size).first()[0]
        version = self.checkpoint()
        good = self._snapshots()
        covered = good[1][1] if len(good) > 1 else -1
        gone = [(base, rows) for base, rows, _, state in self._statuses() if state != "pending" and base + rows - 1 <= covered]
        if gone:
            self._create(f"{self.root}/trimmed/{max(b + r for b, r in gone) - 1:019d}", "")
        for base, _ in gone:
            for path in (f"log/batch={base}", f"sectors/batch={base}", f"claims/{base:019d}", f"commits/{base:019d}"):
                self._remove(f"{self.root}/{path}")
        for old, _ in good[2:]:
            self._remove(f"{self.root}/snapshots/version={old}")
            self._good[old] = False
        live = self.snapshot(version).agg(size).first()[0]
        return {"version": version, "log_string_bytes": before, "live_string_bytes": live, "batches_removed": len(gone)}


class Collection:
    """Typed records by string key, in a namespace of their own."""

    def __init__(self, db: Database, name: str, schema: RecordSchema):
        self.db, self.name, self.schema = db, name, schema

    def _changes(self, rows: DataFrame, key: str) -> DataFrame:
        given = [(n, k) for n, k in self.schema.fields if n in rows.columns]
        null = {"u_val": "bigint", "f_val": "double", "s_val": "string"}

        def change(name: str, kind: str):
            own = _value_column(kind)
            stored = self.schema.store(name, F.col(f"`{name}`"))
            values = [(stored if c == own else F.lit(None)).cast(t).alias(c) for c, t in null.items()]
            return F.when(F.col(f"`{name}`").isNotNull(), F.struct(F.lit(name).alias("field"), *values))

        changes = F.filter(F.array(*[change(n, k) for n, k in given]), lambda c: c.isNotNull())
        flat = (
            rows.where(F.octet_length(key) > 0)
            .select(F.lit(self.name).alias("collection"), F.col(key).alias("key"), F.posexplode(changes).alias("_n", "_c"))
            .select("collection", "key", "_c.*", F.struct("key", "_n", F.monotonically_increasing_id().alias("_i")).alias("seq"))
        )
        return flat

    def insert(self, rows: DataFrame, key: str = "key", tag: str = "") -> None:
        """Set the given fields of new or known keys; empty keys are refused silently, columns outside the schema are dropped.

        A field that is null in a row is not set.  Within one call rows of a key are ordered
        by key and then as they come; use separate calls where the order of writes matters.
        """
        self.db.append(self._changes(rows, key), tag)

    def compare_and_set(self, rows: DataFrame, key: str = "key", tries: int = 5) -> DataFrame:
        """Set fields of keys whose last write still has the number in column ``expected_seq`` (-1: no such key).

        Gives (key, swapped).  The comparison and the append are one step: the append takes place
        only if it follows the log that was compared directly, else both are done anew.
        """
        for _ in range(tries):
            begin = self.db.next_seq()
            if self.db.pending():
                raise StoreError("another append is pending")
            now = self._own().groupBy("key").agg(F.max("seq").alias("_now"))
            known = rows.withColumn("key", F.col(key)).join(now, "key", "left")
            told = saved(known.withColumn("_same", F.col("expected_seq") == F.coalesce("_now", F.lit(-1))), "swaps")
            if self.db.append(self._changes(told.where("_same").drop("_now", "_same"), "key"), expected=begin) == begin:
                return told.select("key", F.col("_same").alias("swapped"))
        raise StoreError(f"other writers came first {tries} times")

    def _own(self, key: str | None = None) -> DataFrame:
        return self.db.entries(key).where(F.col("collection") == self.name)

    def _records(self, entries: DataFrame) -> DataFrame:
        newest = _last_writes(entries)
        fields = [F.max(F.when(F.col("field") == n, F.col(_value_column(k)))).alias(n) for n, k in self.schema.fields]
        wide = newest.groupBy("key").agg(*fields)
        return wide.select("key", *[self.schema.store(n, F.col(f"`{n}`")).alias(n) for n, _ in self.schema.fields])

    def state(self) -> DataFrame:
        """All records: key, every field (zero or empty where never set)."""
        return self._records(self._own())

    def find(self, key: str) -> DataFrame:
        """The record of one key; no row where it is absent.  It reads one part of the snapshot, and the
        key reaches the scans."""
        return self._records(self._own(key))

    get = find

    def multi_get(self, probes: DataFrame, key: str = "key") -> DataFrame:
        return probes.join(self.state().withColumnRenamed("key", key), key, "left")

    def index(self) -> DataFrame:
        """Keys with the sequence number of their first write that is still known."""
        return self._own().groupBy("key").agg(F.min("seq").alias("seq"))


def _last_writes(entries: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("u_val", "f_val", "s_val"), "seq")
    return (
        entries.groupBy("collection", "key", "field")
        .agg(F.max("seq").alias("seq"), newest.alias("v"))
        .select("collection", "key", "field", "seq", "v.u_val", "v.f_val", "v.s_val")
    )


def _checksum():
    own = F.crc32(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in LOG.names]))
    return F.coalesce(F.sum(own.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
