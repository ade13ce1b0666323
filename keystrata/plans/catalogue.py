"""Named queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.scalars import align8, checksum, padded_key, utf8_bytes, wrap_uint
from keystrata.operators import compaction, index, log, metrics, recovery, state
from keystrata.operators.schema import RecordSchema
from keystrata.sources.scratch import fresh_path, saved
from keystrata.sources.store import Database
from keystrata.sources.tables import customer_index, event_log, table
from keystrata.streaming import flusher

USER = RecordSchema((("id", "uint32"), ("role", "uint8"), ("score", "float64"), ("username", "string")))
#: Where a log is cut, in SQL: at half of its numbers, and at three quarters.
HALF = "(SELECT max(event_id) // 2 FROM events)"
LATER = "(SELECT max(event_id) * 3 // 4 FROM events)"
KEYS = ["user_id", "event_type"]
ARENA = 11_000_000

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


# --- index ---------------------------------------------------------------------------------


@query("SELECT c_name AS key, c_custkey * 64 + 4096 AS value_offset FROM customer WHERE c_name = 'Customer#000000042'")
def point_get(spark: SparkSession, sf: str) -> DataFrame:
    return index.point_get(customer_index(spark, sf), "key", "Customer#000000042").select("key", "value_offset")


@query("""SELECT k AS key, CAST(coalesce(c_custkey * 64 + 4096, -1) AS BIGINT) AS value_offset
FROM (VALUES ('Customer#000000007'), ('Customer#7'), ('')) p(k) LEFT JOIN customer ON c_name = k""")
def point_miss(spark: SparkSession, sf: str) -> DataFrame:
    probes = spark.createDataFrame([("Customer#000000007",), ("Customer#7",), ("",)], "key string")
    return index.multi_get(customer_index(spark, sf), probes, "key", "value_offset").select("key", "value_offset")


@query("""SELECT o_orderkey, o_custkey * 3 AS c_custkey, CAST(coalesce(c_custkey * 64 + 4096, -1) AS BIGINT) AS value_offset
FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 3""")
def multi_get(spark: SparkSession, sf: str) -> DataFrame:
    probes = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 3).alias("c_custkey"))
    return index.multi_get(customer_index(spark, sf), probes, "c_custkey", "value_offset")


@query("""SELECT i // 2500 AS worker, count(*) AS probes, count(*) FILTER (c_custkey IS NULL) AS missing
FROM range(0, 10000) r(i) LEFT JOIN customer ON c_name = printf('Customer#%09d', i) GROUP BY 1""")
def verify_keys(spark: SparkSession, sf: str) -> DataFrame:
    probes = spark.range(10000, numPartitions=4).select((F.expr("id div 2500")).alias("worker"), padded_key("Customer#", F.col("id"), 9).alias("key"))
    found = index.multi_get(customer_index(spark, sf), probes, "key", "value_offset")
    return found.groupBy("worker").agg(F.count("*").alias("probes"), F.count_if(F.col("value_offset") == index.MISS).alias("missing"))


@query("SELECT printf('ID-%05d', i) AS key, 4096 + 64 * i AS value_offset, i // 2500 AS worker FROM range(0, 10000) r(i)")
def parallel_insert(spark: SparkSession, sf: str) -> DataFrame:
    ids = spark.range(10000, numPartitions=4)
    return ids.select(padded_key("ID-", F.col("id")).alias("key"), (F.col("id") * 64 + 4096).alias("value_offset"), F.expr("id div 2500").alias("worker"))


@query("""SELECT l_orderkey, l_linenumber, min_by(l_partkey, strftime(l_shipdate, '%Y-%m-%d') || printf('|%020d|%020d', l_suppkey, l_partkey)) AS l_partkey
FROM lineitem GROUP BY 1, 2""")
def put_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    # inserts arrive by day, then by supplier
    inserts = table(spark, sf, "lineitem").withColumn("arrival", F.struct(F.to_date("l_shipdate"), "l_suppkey", "l_partkey"))
    return index.put_if_absent(inserts, ["l_orderkey", "l_linenumber"], "l_partkey", "arrival")


@query("""SELECT key, value_offset FROM (
  SELECT c_name AS key, c_custkey * 64 + 4096 AS value_offset FROM customer WHERE c_custkey < 100
  UNION ALL SELECT c_name, c_custkey AS value_offset FROM customer WHERE c_custkey >= 100)""")
def put_into_index(spark: SparkSession, sf: str) -> DataFrame:
    known = customer_index(spark, sf).where("c_custkey < 100")
    again = table(spark, sf, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value_offset"), F.col("c_custkey").alias("seq"))
    return index.put_into(known, again, "key", "value_offset", "seq")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) - 1 AS ignored FROM lineitem GROUP BY 1, 2")
def duplicate_inserts(spark: SparkSession, sf: str) -> DataFrame:
    return index.duplicate_inserts(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH k AS (SELECT 'user:' || c_custkey AS key FROM customer)
SELECT a.key AS prefix, count(*) AS longer_keys FROM k a JOIN k b ON starts_with(b.key, a.key) AND b.key <> a.key GROUP BY 1""")
def prefix_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return index.prefix_conflicts(keys, "key")


@query("SELECT c_name AS key, row_number() OVER (ORDER BY c_name DESC) - 1 AS place FROM customer")
def live_set(spark: SparkSession, sf: str) -> DataFrame:
    return index.live_set(customer_index(spark, sf), "key")


# --- schema and records --------------------------------------------------------------------


@query("""SELECT 'users' AS collection, CAST(ord AS INTEGER) AS ord, field, type, CAST(size AS BIGINT) AS size,
  CAST(coalesce(sum(size) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM (VALUES (0, 'id', 'uint32', 4), (1, 'role', 'uint8', 1), (2, 'score', 'float64', 8), (3, 'username', 'string', 8)) v(ord, field, type, size)""")
def layout(spark: SparkSession, sf: str) -> DataFrame:
    return USER.layout(spark, "users")


@query("""SELECT c_name AS key, (c_custkey * 1000000) % 4294967296 AS id, CAST(c_nationkey % 256 AS SMALLINT) AS role,
  c_acctbal AS score, c_mktsegment AS username FROM customer""")
def insert_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        "c_name", (F.col("c_custkey") * 1000000).alias("id"), F.col("c_nationkey").alias("role"), F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("username")
    )
    return USER.records(rows, "c_name")


@query("""SELECT c_custkey, ((CAST(trunc(c_acctbal) AS BIGINT) % 256) + 256) % 256 AS u8,
  ((CAST(trunc(-c_acctbal) AS BIGINT) % 4294967296) + 4294967296) % 4294967296 AS u32 FROM customer""")
def uint_wrap(spark: SparkSession, sf: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", wrap_uint(balance, 8).alias("u8"), wrap_uint(-balance, 32).alias("u32"))


@query("SELECT p_partkey, CAST(p_size % 256 AS SMALLINT) AS p_size FROM part")
def field_read(spark: SparkSession, sf: str) -> DataFrame:
    # one field of all records: the scan reads two columns
    kind = RecordSchema((("p_size", "uint8"),))
    return table(spark, sf, "part").select("p_partkey", kind.store("p_size", F.col("p_size")).alias("p_size"))


@query("""SELECT c_custkey, 4096 + 21 * (row_number() OVER (ORDER BY c_custkey) - 1) AS "offset",
  4096 + 21 * row_number() OVER (ORDER BY c_custkey) > 32768 AS overflow FROM customer""")
def record_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return log.record_offsets(table(spark, sf, "customer"), "c_custkey", USER.total_size)


@query("SELECT o_orderkey, (o_orderkey + 7) // 8 * 8 AS aligned FROM orders")
def align8_(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", align8(F.col("o_orderkey")).alias("aligned"))


# --- log -----------------------------------------------------------------------------------

_OFFSETS = """s AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS str_len,
         CAST(10485764 + coalesce(sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS str_offset,
         4096 + 8 * (row_number() OVER (ORDER BY doc_id) - 1) AS rec
  FROM documents
)"""


@query(f"WITH {_OFFSETS} SELECT doc_id, str_offset, str_len FROM s")
def string_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return log.string_offsets(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""WITH {_OFFSETS}
SELECT doc_id * 2 AS seq, CAST(1 AS INTEGER) AS kind, str_offset AS "offset", str_len AS size FROM s
UNION ALL SELECT doc_id * 2 + 1, CAST(0 AS INTEGER), rec, CAST(8 AS BIGINT) FROM s""")
def delta_log(spark: SparkSession, sf: str) -> DataFrame:
    return log.delta_log(table(spark, sf, "documents"), "doc_id", "text")


_FRAMED = """f AS (
  SELECT event_id AS seq, CAST(6 + strlen(props) AS BIGINT) AS entry_bytes,
         CAST(coalesce(sum(6 + strlen(props)) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         user_id, event_type, value, props
  FROM events
), e AS (SELECT *, start // 4092 AS first_sector, (start + entry_bytes - 1) // 4092 AS last_sector FROM f)"""


@query(f"WITH {_FRAMED} SELECT seq, entry_bytes, start, first_sector, last_sector FROM e")
def log_sectors(spark: SparkSession, sf: str) -> DataFrame:
    return log.framed(event_log(spark, sf), "seq", "props")


@query(f"""WITH {_FRAMED}
SELECT first_sector AS sector_id, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(entry_bytes) AS BIGINT) AS entry_bytes,
  CAST(greatest(0, (first_sector + 1) * 4092 - max(start + entry_bytes)) AS BIGINT) AS pad_bytes FROM e GROUP BY first_sector""")
def sector_fill(spark: SparkSession, sf: str) -> DataFrame:
    return log.sector_fill(log.framed(event_log(spark, sf), "seq", "props"), "seq")


_CRC = """4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
   [('0x' || substr(hex(encode({t})), CAST(2 * i - 1 AS INT), 2))::BIGINT FOR i IN range(1, strlen({t}) + 1)]),
 lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR j IN range(0, 8)]),
   lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""


_LITTLE = "substr(printf('%08x', {n}), 7, 2) || substr(printf('%08x', {n}), 5, 2)"


@query(f"""WITH b AS (
  SELECT event_id, upper({_LITTLE.format(n='event_id')} || substr(printf('%08x', event_id), 3, 2) || substr(printf('%08x', event_id), 1, 2)
         || {_LITTLE.format(n='strlen(props)')}) || hex(encode(props)) AS h
  FROM events
), s AS (SELECT string_agg(h, '' ORDER BY event_id) AS stream FROM b
), p AS (
  SELECT i AS sector_id, rpad(substr(stream, CAST(i * 8184 + 1 AS INT), 8184), 8184, '0') AS h
  FROM s, (SELECT unnest(range(0, (SELECT (length(stream) + 8183) // 8184 FROM s))) AS i) r
)
SELECT sector_id, 4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
   [('0x' || substr(h, CAST(2 * i - 1 AS INT), 2))::BIGINT FOR i IN range(1, 4093)]),
 lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR j IN range(0, 8)]),
   lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc FROM p""")
def sector_checksums(spark: SparkSession, sf: str) -> DataFrame:
    return log.sector_checksums(event_log(spark, sf), "seq", "props")


@query(f"SELECT event_id AS seq, {_CRC.format(t='props')} AS crc FROM events")
def entry_crc(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).select("seq", checksum(F.col("props")).alias("crc"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, strlen(text) > 65535 AS beyond_u16 FROM documents WHERE strlen(text) > 8184")
def oversize_entries(spark: SparkSession, sf: str) -> DataFrame:
    return log.oversize_entries(table(spark, sf, "documents"), "doc_id", "text")


@query("""SELECT user_id, min(event_id) AS seq, min_by(event_type, event_id) AS event_type, min_by(value, event_id) AS value FROM events GROUP BY 1""")
def log_head(spark: SparkSession, sf: str) -> DataFrame:
    return state.first_writes(event_log(spark, sf), ["user_id"], ["event_type", "value"])


# --- state, checkpoint, recovery -----------------------------------------------------------

_LWW = "SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS seq FROM events {where} GROUP BY 1, 2"


@query(_LWW.format(where=""))
def field_lww(spark: SparkSession, sf: str) -> DataFrame:
    return state.last_writes(event_log(spark, sf), KEYS, "value")


def _cut(entries: DataFrame, num: int = 1, den: int = 2) -> int:
    """A checkpoint's last number: a share of the log's numbers."""
    return (entries.agg(F.max("seq")).first()[0] or 0) * num // den


@query(_LWW.format(where=f"WHERE event_id <= {HALF}"))
def checkpoint_state(spark: SparkSession, sf: str) -> DataFrame:
    entries = event_log(spark, sf)
    return recovery.checkpoint(entries, KEYS, "value", _cut(entries))


@query(f"SELECT event_id AS seq, user_id, event_type, value FROM events WHERE event_id > {HALF}")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    entries = event_log(spark, sf)
    return recovery.log_tail(entries, _cut(entries)).select("seq", "user_id", "event_type", "value")


@query(_LWW.format(where=""))
def recover(spark: SparkSession, sf: str) -> DataFrame:
    entries = event_log(spark, sf)
    snapshot = recovery.checkpoint(entries, KEYS, "value", _cut(entries))
    return recovery.replay(snapshot, recovery.log_tail(entries, _cut(entries)), KEYS, "value")


@query(f"""WITH {_FRAMED}, bad AS (SELECT max(last_sector) * 9 // 10 AS b FROM e)
SELECT user_id, event_type, max_by(value, seq) AS value, max(seq) AS seq FROM e, bad WHERE last_sector < b GROUP BY 1, 2""")
def recover_truncated(spark: SparkSession, sf: str) -> DataFrame:
    # the sector nine tenths into the log is bad
    entries = event_log(spark, sf)
    placed = log.framed(entries, "seq", "props")
    bad = placed.agg(F.expr("max(last_sector) * 9 div 10").alias("sector_id"))
    valid = recovery.before_corruption(placed, bad).select("seq")
    return state.last_writes(entries.join(valid, "seq"), KEYS, "value")


@query(f"""WITH {_OFFSETS} SELECT doc_id, str_offset AS "offset", str_len AS size, str_offset + str_len > {ARENA} AS skipped FROM s""")
def bounds_skip(spark: SparkSession, sf: str) -> DataFrame:
    placed = log.string_offsets(table(spark, sf, "documents"), "doc_id", "text")
    return recovery.bounds(placed.select("doc_id", F.col("str_offset").alias("offset"), F.col("str_len").alias("size")), ARENA)


@query(f"""WITH {_OFFSETS}, h AS (SELECT greatest(max(str_offset + str_len), 2052) AS high_water FROM s WHERE str_offset + str_len <= {ARENA})
SELECT CAST(coalesce(high_water, 2052) AS BIGINT) AS high_water, CAST((greatest(coalesce(high_water, 2052), 2056) + 7) // 8 * 8 AS BIGINT) AS bump FROM h""")
def high_water(spark: SparkSession, sf: str) -> DataFrame:
    return recovery.high_water(bounds_skip(spark, sf).where("NOT skipped"))


# --- the store -----------------------------------------------------------------------------


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of a collection: one string field a kind of event."""
    return event_log(spark, sf).select(
        "seq",
        F.lit("events").alias("collection"),
        F.col("user_id").cast("string").alias("key"),
        F.col("event_type").alias("field"),
        F.lit(None).cast("bigint").alias("u_val"),
        F.lit(None).cast("double").alias("f_val"),
        F.col("props").alias("s_val"),
    )


def _store_state(db: Database) -> DataFrame:
    newest = state.last_writes(db.entries(), ["key", "field"], "s_val")
    return newest.select(F.col("key").alias("user"), F.col("field").alias("event_type"), F.col("s_val").alias("props"))


_STORED = "SELECT CAST(user_id AS VARCHAR) AS \"user\", event_type, max_by(props, event_id) AS props FROM {source} GROUP BY 1, 2"


@query(_STORED.format(source="events"))
def store_recover(spark: SparkSession, sf: str) -> DataFrame:
    # half of the log, a checkpoint, the other half; then a process that knows nothing but the folder
    changes = _changes(spark, sf)
    cut = _cut(changes)
    db = Database(spark, fresh_path(spark, "store-recover"))
    db.append(changes.where(F.col("seq") <= cut))
    db.checkpoint()
    db.append(changes.where(F.col("seq") > cut))
    return _store_state(Database(spark, db.root))


@query(_STORED.format(source="events"))
def store_compact(spark: SparkSession, sf: str) -> DataFrame:
    # three compactions: the third removes what the second checkpoint covers
    changes = _changes(spark, sf)
    thirds = [-1, _cut(changes, 1, 3), _cut(changes, 2, 3), _cut(changes, 1, 1)]
    db = Database(spark, fresh_path(spark, "store-compact"))
    for low, high in zip(thirds, thirds[1:], strict=False):
        db.append(changes.where((F.col("seq") > low) & (F.col("seq") <= high)))
        db.compact()
    return _store_state(Database(spark, db.root))


_TAIL = f"""t AS (
  SELECT user_id, event_type, event_id, props, row_number() OVER (ORDER BY event_id) - 1 AS i,
         6 + strlen('events' || CAST(user_id AS VARCHAR) || event_type || props) + 8 AS n
  FROM events WHERE event_id > {HALF}
), u AS (
  SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ FROM t
), bad AS (SELECT min(start_) // 4092 AS b FROM u WHERE i = (SELECT max(i) // 2 FROM u)
), v AS (
  SELECT user_id, event_type, event_id, props FROM events WHERE event_id <= {HALF}
  UNION ALL SELECT user_id, event_type, event_id, props FROM u, bad WHERE start_ + n <= b * 4092
)"""


@query(f"WITH {_TAIL} " + _STORED.format(source="v"))
def store_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    # one value in the middle of the second append is altered on disk; replay keeps what ends before its sector
    changes = _changes(spark, sf)
    cut = _cut(changes)
    db = Database(spark, fresh_path(spark, "store-corrupt"))
    db.append(changes.where(F.col("seq") <= cut))
    base = db.append(changes.where(F.col("seq") > cut))
    batch = f"{db.root}/log/batch={base}"
    rows = spark.read.parquet(batch)
    middle = base + (db.last_seq() - base) // 2
    altered = F.when(F.col("seq") == middle, F.concat(F.lit("#"), F.substring("s_val", 2, 1 << 30))).otherwise(F.col("s_val"))
    saved(rows.withColumn("s_val", altered), "altered").write.mode("overwrite").parquet(batch)
    return _store_state(Database(spark, db.root))


# --- compaction ----------------------------------------------------------------------------

_LIVE = "v AS (SELECT user_id, max_by(props, event_id) AS props FROM events GROUP BY 1)"


def _live_props(spark: SparkSession, sf: str) -> DataFrame:
    return state.last_writes(event_log(spark, sf), ["user_id"], "props")


@query(f"""WITH {_LIVE} SELECT printf('%05d', user_id) AS key, CAST(strlen(props) AS BIGINT) AS len,
  CAST(31457280 + coalesce(sum(strlen(props)) OVER (ORDER BY user_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset
FROM v WHERE strlen(props) > 0""")
def vacuum_relocate(spark: SparkSession, sf: str) -> DataFrame:
    live = _live_props(spark, sf).select(padded_key("", F.col("user_id")).alias("key"), "props")
    return compaction.relocate(live, "key", "props")


@query("""WITH d AS (SELECT doc_id, strlen(text) AS len, sum(strlen(text)) OVER (ORDER BY doc_id DESC) AS upto FROM documents WHERE strlen(text) > 0)
SELECT doc_id, CAST(len AS BIGINT) AS len, CAST(31457280 + upto - len AS BIGINT) AS new_offset FROM d WHERE upto <= 16384""")
def vacuum_budget(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.within_budget(compaction.relocate(table(spark, sf, "documents"), "doc_id", "text"))


@query(f"""WITH {_LIVE}, w AS (SELECT CAST(sum(strlen(props)) AS BIGINT) AS written_bytes FROM events),
  l AS (SELECT CAST(sum(strlen(props)) AS BIGINT) AS live_bytes, count(*) AS live_strings FROM v)
SELECT *, written_bytes - live_bytes AS garbage_bytes FROM w, l""")
def vacuum_stats(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.stats(event_log(spark, sf), _live_props(spark, sf), "props")


@query(f"""WITH x AS (SELECT user_id, max(event_id) AS expected_seq FROM events WHERE event_id <= {HALF} GROUP BY 1),
  c AS (SELECT user_id, max(event_id) AS current_seq FROM events WHERE event_id <= {LATER} GROUP BY 1)
SELECT user_id, expected_seq, current_seq, expected_seq = current_seq AS swapped FROM x JOIN c USING (user_id)""")
def cas_update(spark: SparkSession, sf: str) -> DataFrame:
    entries = event_log(spark, sf)
    newest = lambda upto: recovery.checkpoint(entries, ["user_id"], "value", upto).select("user_id", "seq")
    return state.cas_update(newest(_cut(entries)), newest(_cut(entries, 3, 4)), ["user_id"])


# --- measures ------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(value) FILTER (i = floor(n * 0.5::DOUBLE)) AS p50, max(value) FILTER (i = floor(n * 0.95::DOUBLE)) AS p95,
  max(value) FILTER (i = floor(n * 0.99::DOUBLE)) AS p99, max(value) AS max_value FROM r GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latency_percentiles(event_log(spark, sf), "event_type", "value")


@query("""SELECT CASE WHEN r < 0.2 THEN 'read' WHEN r < 0.6 THEN 'insert_update' ELSE 'update' END AS op, count(*) AS n
FROM (SELECT ((event_id * 9301 + 49297) % 233280) / 233280.0::DOUBLE AS r FROM events) GROUP BY 1""")
def workload_mix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.workload_mix(event_log(spark, sf), "seq")


@query("""SELECT event_id // 40 AS burst, count(*) AS arrivals, least(count(*), 15) AS accepted, greatest(count(*) - 15, 0) AS dropped FROM events GROUP BY 1""")
def backpressure(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.backpressure(event_log(spark, sf), "seq")


@query("""WITH RECURSIVE g AS (SELECT w AS worker, 0 AS step, 12345 + w AS state FROM range(0, 4) r(w)
  UNION ALL SELECT worker, step + 1, (state * 9301 + 49297) % 233280 FROM g WHERE step < 100)
SELECT worker, CAST(step AS INTEGER) AS step, CAST(state AS BIGINT) AS state, state / 233280.0::DOUBLE AS r FROM g WHERE step > 0""")
def lcg_stream(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.lcg_stream(spark)


# --- streaming -----------------------------------------------------------------------------


@query(_LWW.format(where=""))
def stream_apply(spark: SparkSession, sf: str) -> DataFrame:
    return flusher.apply_stream(flusher.events_stream(spark, sf), KEYS, "value", flusher.target_path(spark, "stream"))


@query(_LWW.format(where=""))
def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    return flusher.stateful_stream(flusher.events_stream(spark, sf), KEYS, "value", flusher.target_path(spark, "stream-state"))


for _names in (QUERIES, ORACLES):
    _names["align8"] = _names.pop("align8_")
