"""Unit tests of the keyed-record engine."""

import math
import zlib
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keystrata.functions.scalars import align8, checksum, padded_key, wrap_uint
from keystrata.operators import compaction, index, log, metrics, recovery, state
from keystrata.operators.running import celled, sum_before, sum_before_descending
from keystrata.operators.schema import RecordSchema
from keystrata.sources.scratch import remove_tables, saved, tables_made
from keystrata.sources.store import Database, StoreError
from keystrata.sources.tables import event_log
from keystrata.streaming import flusher

USER = RecordSchema((("id", "uint32"), ("role", "uint8"), ("score", "uint32"), ("username", "string")))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_layout_has_no_padding(spark):
    made = USER.layout(spark, "users").orderBy("ord").collect()
    assert [r.offset for r in made] == [0, 4, 5, 9]
    assert USER.total_size == 17


@pytest.mark.parametrize("fields", [(("a", "int64"),), (("7", "uint8"),)])
def test_bad_schemas_raise(fields):
    with pytest.raises(ValueError):
        RecordSchema(fields)


@pytest.mark.parametrize(
    ("value", "bits", "want"),
    [(300.0, 8, 44), (-1.0, 32, 4294967295), (-1.5, 32, 4294967295), (math.nan, 8, 0), (math.inf, 32, 0), (None, 8, 0), (255.9, 8, 255)],
)
def test_wraps(spark, value, bits, want):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(wrap_uint(F.col("v"), bits)).first()[0] == want


def test_scalars(spark):
    df = spark.createDataFrame([(123456, "HealthyData"), (7, "é")], "n bigint, s string")
    out = df.select(align8(F.col("n")), padded_key("ID-", F.col("n")), checksum(F.col("s"))).collect()
    assert tuple(out[0]) == (123456, "ID-123456", 3629768337)
    assert tuple(out[1]) == (8, "ID-00007", 235179326)


def test_first_write_wins_and_misses(spark):
    inserts = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("", 3, 3), ("b", 4, 4)], "key string, off bigint, seq bigint")
    empty = spark.createDataFrame([], "key string, off bigint")
    made = index.put_into(empty, inserts, "key", "off", "seq")
    assert rows(made) == [("a", 2), ("b", 4)]
    assert rows(index.put_into(made, inserts.withColumn("off", F.lit(9).cast("bigint")), "key", "off", "seq")) == [("a", 2), ("b", 4)]
    probes = spark.createDataFrame([("a",), ("x",)], "key string")
    assert rows(index.multi_get(made, probes, "key", "off")) == [("a", 2), ("x", -1)]


def test_prefix_conflicts(spark):
    keys = spark.createDataFrame([("user:1",), ("user:10",), ("user:100",), ("b",)], "key string")
    assert rows(index.prefix_conflicts(keys, "key")) == [("user:1", 2), ("user:10", 1)]


def test_running_sums(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    want, total = {}, 0
    for k in range(1000):
        want[k] = total
        total += k % 7
    assert {r.k: r.s for r in sum_before(df, "k", "v", "s").collect()} == want
    down = {r.k: r.s for r in sum_before_descending(df, "k", "v", "s").collect()}
    assert all(down[k] == total - want[k] - k % 7 for k in range(1000))


def test_running_sum_of_nothing(spark):
    assert sum_before(spark.createDataFrame([], "k bigint, v bigint"), "k", "v", "s").count() == 0


def test_running_sums_keep_null_orders_and_split_outliers(spark):
    df = spark.createDataFrame([(None, 5), (1, 7), (3, 9)], "k bigint, v bigint")
    assert sorted((r.k or 0, r.s) for r in sum_before(df, "k", "v", "s").collect()) == [(0, 0), (1, 5), (3, 12)]
    far = spark.range(100000).select(F.when(F.col("id") == 0, 1 << 62).otherwise(F.col("id")).alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for order in (F.col("k"), F.lit(1)):
            assert celled(far, [order], "cells").groupBy("_cell").count().agg(F.max("count")).first()[0] < 60000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = sum_before(far, "k", "v", "s")
    assert made.where("s = if(k = 1L << 62, 99999, k - 1)").count() == 100000


@pytest.mark.parametrize("n", [0, 1, 8, (1 << 60) + 9, (1 << 62) - 7])
def test_alignment_is_exact(spark, n):
    assert spark.range(1).select(align8(F.lit(n))).first()[0] == (n + 7) // 8 * 8


def test_last_write_and_replay_twice(spark):
    entries = spark.createDataFrame([(i, "user:1", f"Generation_X_{i}") for i in range(200)], "seq bigint, key string, v string")
    snapshot = recovery.checkpoint(entries, ["key"], "v", 100)
    tail = recovery.log_tail(entries, 100)
    once = recovery.replay(snapshot, tail, ["key"], "v")
    assert rows(once) == [("user:1", "Generation_X_199", 199)]
    assert rows(recovery.replay(once, tail, ["key"], "v")) == rows(once)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_the_whole_log_is_replayed_at_every_size(spark, sf):
    path = f"/root/testdata/sf{sf}"
    if not Path(path).exists():
        pytest.skip("no test tables")
    entries, keys = event_log(spark, path), ["user_id", "event_type"]
    cut = entries.agg(F.max("seq")).first()[0] // 2
    tail = recovery.log_tail(entries, cut)
    assert 0 < tail.count() < entries.count()
    got = recovery.replay(recovery.checkpoint(entries, keys, "value", cut), tail, keys, "value")
    want = {}
    for r in entries.orderBy("seq").collect():
        want[r.user_id, r.event_type] = (r.value, r.seq)
    assert {(r.user_id, r.event_type): (r.value, r.seq) for r in got.collect()} == want


@pytest.mark.parametrize("bad", [0, 2, None])
def test_recovery_stops_at_the_first_bad_sector(spark, bad):
    entries = spark.createDataFrame([(i, "x" * 1000) for i in range(20)], "seq bigint, p string")
    placed = log.framed(entries, "seq", "p")
    sectors = spark.createDataFrame([(bad,), (4,)] if bad is not None else [], "sector_id bigint")
    kept = {r.seq for r in recovery.before_corruption(placed, sectors).collect()}
    limit = 20 if bad is None else sum((i + 1) * 1006 <= bad * 4092 for i in range(20))
    assert kept == set(range(limit))


def test_sector_checksums(spark):
    entries = spark.createDataFrame([(i, "é" * 700) for i in range(10)] + [(70000, None), (1 << 33, "x" * 9000)], "seq bigint, p string")
    got = {r.sector_id: r.crc for r in log.sector_checksums(entries, "seq", "p").collect()}
    stream = b""
    for seq, text in [(i, "é" * 700) for i in range(10)] + [(70000, ""), (1 << 33, "x" * 9000)]:
        body = text.encode()
        stream += (seq % (1 << 32)).to_bytes(4, "little") + (len(body) % 65536).to_bytes(2, "little") + body
    cut = [stream[i : i + 4092].ljust(4092, b"\0") for i in range(0, len(stream), 4092)]
    assert got == {i: zlib.crc32(x) for i, x in enumerate(cut)}


def test_bounds_and_high_water(spark):
    entries = spark.createDataFrame([(3000, 10), (100, 5000), (5000, 4)], "offset bigint, size bigint")
    assert tuple(recovery.high_water(recovery.bounds(entries, 5100).where("not skipped")).first()) == (5004, 5008)
    assert tuple(recovery.high_water(entries.where("offset < 0")).first()) == (2052, 2056)


def test_compaction(spark):
    live = spark.createDataFrame([("a", "xx"), ("c", ""), ("b", "yyy"), ("d", None)], "key string, s string")
    moved = compaction.relocate(live, "key", "s")
    assert rows(moved) == [("a", 2, 31457283), ("b", 3, 31457280)]
    assert rows(compaction.within_budget(moved, budget=3)) == [("b", 3, 31457280)]
    assert tuple(compaction.stats(live, live.where("key = 'a'"), "s").first()) == (5, 2, 1, 3)


def test_compare_and_swap(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, seq bigint")
    new = spark.createDataFrame([("a", 1), ("b", 3)], "key string, seq bigint")
    assert rows(state.cas_update(old, new, ["key"]).select("key", "swapped")) == [("a", True), ("b", False)]


@pytest.mark.parametrize(("n", "want"), [(15, (15, 0)), (16, (15, 1))])
def test_queue_holds_one_less_than_its_slots(spark, n, want):
    assert tuple(metrics.backpressure(spark.range(n), "id", 40).select("accepted", "dropped").first()) == want


def test_percentiles_are_floor_ranked(spark):
    df = spark.createDataFrame([("x", float(i)) for i in range(10)], "g string, v double")
    assert tuple(metrics.latency_percentiles(df, "g", "v").first()) == ("x", 10, 5.0, 9.0, 9.0, 9.0)


def test_store_survives_reopening(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    users = Database(spark, root).collection("users", USER)
    users.insert(spark.createDataFrame([("u1", 300, "Ann"), ("u2", -1, "Bob"), ("", 1, "no")], "key string, role bigint, username string"))
    users.insert(spark.createDataFrame([("u1", "Eve", "dropped")], "key string, username string, other string"))
    other = Database(spark, root).collection("others", USER)
    other.insert(spark.createDataFrame([("u1", 5)], "key string, id bigint"))
    want = [("u1", 0, 44, 0, "Eve"), ("u2", 0, 255, 0, "Bob")]
    again = Database(spark, root).collection("users", USER)
    assert rows(again.state()) == want
    assert rows(again.find("u1")) == want[:1]
    assert again.get("nobody").count() == 0
    db = Database(spark, root)
    assert db.checkpoint() == 1
    again.insert(spark.createDataFrame([("u2", 7)], "key string, score bigint"))
    assert rows(again.state())[1] == ("u2", 0, 255, 7, "Bob")
    report = db.compact()
    assert report["live_string_bytes"] < report["log_string_bytes"] + 100
    assert rows(again.state())[1] == ("u2", 0, 255, 7, "Bob")
    assert rows(Database(spark, root).collection("others", USER).state()) == [("u1", 5, 0, 0, "")]
    assert [r.key for r in again.index().orderBy("key").collect()] == ["u1", "u2"]


def test_a_bad_snapshot_is_passed_over(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    users = db.collection("users", USER)
    users.insert(spark.createDataFrame([("u1", 1)], "key string, id bigint"))
    db.checkpoint()
    users.insert(spark.createDataFrame([("u1", 2)], "key string, id bigint"))
    spark.createDataFrame([(2, 99, 1, None)], "version bigint, upto_seq bigint, rows bigint, checksum decimal(38,0)").write.mode("append").parquet(f"{db.root}/manifest")
    assert db.newest_snapshot()[0] == 1
    assert rows(users.state()) == [("u1", 2, 0, 0, "")]


def damage(folder, into=b"damaged "):
    """Overwrite bytes in the middle of every data file below a folder."""
    for path in Path(folder).rglob("*.parquet"):
        data = bytearray(path.read_bytes())
        data[len(data) // 3 : len(data) // 3 + len(into)] = into
        path.write_bytes(data)
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


def records(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, id bigint")


def test_compaction_loses_nothing_if_a_snapshot_fails(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    users = db.collection("users", USER)
    users.insert(records(spark, ("a", 1)))
    db.checkpoint()
    users.insert(records(spark, ("b", 2)))
    assert db.compact()["batches_removed"] == 1
    users.insert(records(spark, ("c", 3)))
    want = [("a", 1), ("b", 2), ("c", 3)]
    read = lambda: rows(Database(spark, db.root).collection("users", USER).state().select("key", "id"))
    assert read() == want
    damage(tmp_path / "db/snapshots/version=2")
    fresh = Database(spark, db.root)
    try:
        assert fresh.newest_snapshot()[0] == 1 and read() == want
    except Exception as e:  # a file that cannot be read at all
        assert not isinstance(e, AssertionError)
    damage(tmp_path / "db/snapshots/version=1")
    with pytest.raises(Exception):  # noqa: B017
        read()


def test_recovery_does_not_fall_below_the_log(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    users = db.collection("users", USER)
    for i, key in enumerate("abc"):
        users.insert(records(spark, (key, i)))
        db.compact()
    for version in (2, 3):
        for path in (tmp_path / f"db/snapshots/version={version}").rglob("*.parquet"):
            path.unlink()
    with pytest.raises(StoreError, match="up to which the log was removed"):
        Database(spark, db.root).entries()


@pytest.mark.parametrize("missing", [False, True])
def test_replay_stops_at_an_altered_sector(spark, tmp_path, missing):
    db = Database(spark, f"file://{tmp_path}/db")
    users = db.collection("users", USER)
    users.insert(records(spark, ("a", 1)))
    long = spark.createDataFrame([(f"k{i:03d}", "v" * 400) for i in range(60)], "key string, username string")
    users.insert(long.coalesce(1))
    users.insert(records(spark, ("z", 9)))
    bases = [b for b, _, _ in db._claims()]
    folder = tmp_path / f"db/log/batch={bases[1]}"
    stored = spark.read.parquet(f"file://{folder}")
    altered = stored.where("key <> 'k030'") if missing else stored.withColumn("s_val", F.expr("if(key = 'k030', concat('w', substr(s_val, 2)), s_val)"))
    altered = spark.createDataFrame(altered.collect(), stored.schema)
    altered.write.mode("overwrite").parquet(f"file://{folder}")
    again = Database(spark, db.root)
    with pytest.warns(UserWarning, match="does not hold"):
        kept = [r.key for r in again.collection("users", USER).state().select("key").collect()]
    assert again.corrupt[0] == bases[1]
    keys = sorted(kept)
    # all before the sector, nothing behind it
    assert keys[0] == "a" and "z" not in keys and "k030" not in keys
    assert keys[1:] == [f"k{i:03d}" for i in range(len(keys) - 1)] and 20 <= len(keys) - 1 <= 30
    again.collection("users", USER).insert(records(spark, ("y", 8)))
    assert again.corrupt is None
    assert rows(Database(spark, db.root).collection("users", USER).state().select("key"))[-1] == ("y",)


def test_unreadable_log_files_count_as_corrupt(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    users = db.collection("users", USER)
    users.insert(records(spark, ("a", 1)))
    users.insert(records(spark, ("b", 2)))
    last = db._claims()[-1][0]
    for path in (tmp_path / f"db/log/batch={last}").glob("*.parquet"):
        path.write_bytes(b"no parquet at all")
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    with pytest.warns(UserWarning):
        assert rows(Database(spark, db.root).collection("users", USER).state().select("key", "id")) == [("a", 1)]


def test_writers_at_once_get_ranges_of_their_own(spark, tmp_path):
    root = f"file://{tmp_path}/db"

    def write(worker):
        keys = spark.range(25).select(F.concat(F.lit(f"ID-{worker}-"), F.col("id")).alias("key"), F.col("id"))
        Database(spark, root).collection("users", USER).insert(keys)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    db = Database(spark, root)
    seqs = [r.seq for r in db.log().select("seq").collect()]
    assert sorted(seqs) == list(range(150))
    assert db.collection("users", USER).state().count() == 150


def test_a_writer_that_died_is_given_up(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    users = db.collection("users", USER)
    users.insert(records(spark, ("a", 1)))
    dead = db._claim(10, "")
    users.insert(records(spark, ("b", 2)))
    assert db.pending() == [dead] and users.state().count() == 2
    # a snapshot does not cover what may still come
    db.checkpoint()
    assert db.newest_snapshot()[1] == dead - 1 and users.state().count() == 2
    assert db.abandon(dead) and not db.pending()
    assert not db._create(f"{db.root}/commits/{dead:019d}", "ok")
    db.checkpoint()
    assert db.newest_snapshot()[1] == db.last_seq() == dead + 10


def test_compare_and_set_swaps(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    users = db.collection("users", USER)
    users.insert(records(spark, ("a", 1), ("b", 2)))
    seq = {r.key: r.seq for r in users.index().collect()}
    users.insert(records(spark, ("b", 3)))
    tried = spark.createDataFrame([("a", 10, seq["a"]), ("b", 20, seq["b"]), ("c", 30, -1)], "key string, id bigint, expected_seq bigint")
    assert rows(users.compare_and_set(tried)) == [("a", True), ("b", False), ("c", True)]
    assert rows(users.state().select("key", "id")) == [("a", 10), ("b", 3), ("c", 30)]
    assert rows(users.find("c").select("id")) == [(30,)]


def test_a_stream_is_flushed_into_the_store(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    schema = "kind int, `order` bigint, collection string, key string, field string, u_val bigint, f_val double, s_val string"
    change = lambda n, key, v: (flusher.CHANGE, n, "users", key, "id", v, None, None)
    files = [[change(1, "a", 1), change(2, "b", 1)], [change(3, "a", 2), (flusher.CHECKPOINT, 4, *[None] * 6), change(5, "c", 3)], [change(6, "a", 4)]]
    source = f"file://{tmp_path}/in"
    stream = lambda: flusher.read_log_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
    spark.createDataFrame(files[0], schema).coalesce(1).write.mode("append").parquet(source)
    assert flusher.flush_to_store(stream(), db, "f")["rows"] == 2
    # a batch that a killed flusher began
    dead = db._claim(3, "f-1")
    for part in files[1:]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        flusher.flush_to_store(stream(), db, "f", checkpoint_every=3)
    users = Database(spark, db.root).collection("users", USER)
    assert rows(users.state().select("key", "id")) == [("a", 4), ("b", 1), ("c", 3)]
    assert dead not in db.pending() and len(db._snapshots()) == 2
    flusher.flush_to_store(stream(), db, "f")
    assert db.log().where("seq >= 0").count() == 5


def test_empty_streams_give_empty_states(spark, tmp_path):
    schema = spark.createDataFrame([], "seq bigint, k string, v string").schema
    (tmp_path / "in").mkdir()
    for n, run in enumerate((flusher.apply_stream, flusher.stateful_stream)):
        stream = flusher.read_log_stream(spark, f"file://{tmp_path}/in", schema)
        assert run(stream, ["k"], "v", f"file://{tmp_path}/out{n}").count() == 0


def test_tables_are_removed(spark):
    made = saved(spark.range(3), "gone")
    path = tables_made(spark)[-1]
    assert made.count() == 3 and "gone" in path
    remove_tables(spark, [path])
    assert path not in tables_made(spark) and not Path(path.removeprefix("file://")).exists()


def test_prefixes_of_long_keys(spark):
    keys = spark.createDataFrame([("a" * 100000,), ("a" * 99999,), ("a",), ("",), ("é",), ("éa",)], "key string")
    assert rows(index.prefix_conflicts(keys, "key")) == [("a", 2), ("a" * 99999, 1), ("é", 1)]


def test_twenty_thousand_overwrites(spark):
    writes = spark.range(20000).select(F.col("id").alias("seq"), F.lit("user:1").alias("key"), F.concat(F.lit("Generation_X_"), F.col("id")).alias("username"))
    newest = state.last_writes(writes, ["key"], "username")
    assert rows(newest) == [("user:1", "Generation_X_19999", 19999)]
    assert tuple(compaction.stats(writes, newest, "username").first()) == (348890, 18, 1, 348872)


def test_an_entry_may_cross_sectors(spark):
    entries = spark.createDataFrame([(0, "x" * 4086), (1, "y" * 9000), (2, "z" * 70000)], "seq bigint, p string")
    assert [(r.first_sector, r.last_sector) for r in log.framed(entries, "seq", "p").orderBy("seq").collect()] == [(0, 0), (1, 3), (3, 20)]
    assert rows(log.oversize_entries(entries, "seq", "p")) == [(1, 9000, False), (2, 70000, True)]


def test_generator_follows_its_rule(spark):
    state_, want = 12347, []
    for _ in range(5):
        state_ = (state_ * 9301 + 49297) % 233280
        want.append(state_)
    got = metrics.lcg_stream(spark, steps=5).where("worker = 2").orderBy("step").collect()
    assert [r.state for r in got] == want


@pytest.mark.parametrize("n", [0, 7, 100])
def test_parallel_inserts_are_all_found(spark, n):
    keys = spark.range(n, numPartitions=4).select(padded_key("SNAP-", F.col("id")).alias("key"), (F.col("id") * 64 + 4096).alias("off"), F.col("id").alias("seq"))
    made = index.put_into(spark.createDataFrame([], "key string, off bigint"), keys, "key", "off", "seq")
    assert index.multi_get(made, keys.select("key"), "key", "off").where(F.col("off") == index.MISS).count() == 0
    assert made.count() == n
    assert [r.key for r in index.live_set(made, "key").orderBy("place").limit(1).collect()] == ([f"SNAP-{n - 1:05d}"] if n else [])
