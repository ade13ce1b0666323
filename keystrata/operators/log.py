"""The mutation log: deltas, framing into sectors, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.scalars import utf8_bytes
from keystrata.operators.running import sum_before

# Fixed by the log's format: bytes of an entry's header and of a sector before its checksum, arena bounds, kinds of entry.
HEADER, SECTOR = 6, 4092
STRING_BASE, RECORD_BASE, RECORD_END = 10485764, 4096, 32768
INLINE, BY_REFERENCE = 0, 1


def string_offsets(rows: DataFrame, order: str, text: str) -> DataFrame:
    """Where the string arena keeps every text: (order, str_offset, str_len)."""
    sized = rows.select(order, utf8_bytes(F.col(text)).alias("str_len"))
    return sum_before(sized, order, "str_len", "_at").select(order, (F.col("_at") + STRING_BASE).alias("str_offset"), "str_len")


def record_offsets(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Bump allocation of records, and whether one does not fit the record arena."""
    at = sum_before(rows.select(order, F.lit(size).alias("_size")), order, "_size", "_at")
    offset = F.col("_at") + RECORD_BASE
    return at.select(order, offset.alias("offset"), (offset + size > RECORD_END).alias("overflow"))


def delta_log(rows: DataFrame, order: str, text: str, record_size: int = 8) -> DataFrame:
    """Two deltas a string set: its bytes by reference, then its pointer inline."""
    sets = string_offsets(rows, order, text).join(record_offsets(rows, order, record_size), order)
    pair = F.array(
        F.struct((F.col(order) * 2).alias("seq"), F.lit(BY_REFERENCE).alias("kind"), F.col("str_offset").alias("offset"), F.col("str_len").alias("size")),
        F.struct((F.col(order) * 2 + 1).alias("seq"), F.lit(INLINE).alias("kind"), F.col("offset"), F.lit(8).cast("bigint").alias("size")),
    )
    return sets.select(F.inline(pair))


def framed(log: DataFrame, seq: str, payload: str) -> DataFrame:
    """Entries with their place in the byte stream: (seq, entry_bytes, start, first_sector, last_sector)."""
    sized = log.select(seq, (utf8_bytes(F.col(payload)) + HEADER).alias("entry_bytes"))
    return sum_before(sized, seq, "entry_bytes", "start").select(
        seq,
        "entry_bytes",
        "start",
        F.expr(f"start div {SECTOR}").alias("first_sector"),
        F.expr(f"(start + entry_bytes - 1) div {SECTOR}").alias("last_sector"),
    )


def sector_fill(entries: DataFrame, seq: str) -> DataFrame:
    """Per sector in which an entry begins: first and last entry, bytes that begin there, and padding of the last one."""
    ends = F.max(F.col("start") + F.col("entry_bytes"))
    return entries.groupBy(F.col("first_sector").alias("sector_id")).agg(
        F.min(seq).alias("first_seq"),
        F.max(seq).alias("last_seq"),
        F.sum("entry_bytes").alias("entry_bytes"),
        F.greatest(F.lit(0), (F.col("sector_id") + 1) * SECTOR - ends).alias("pad_bytes"),
    )


def frame(seq: Column, payload: Column) -> Column:
    """An entry's bytes in hexadecimal: 32 low bits of its number and 16 of its length, little-endian, and the payload."""
    body = F.coalesce(payload, F.lit(""))
    little = lambda n, digits: F.array_join(
        F.reverse(F.transform(F.sequence(F.lit(1), F.lit(digits), F.lit(2)), lambda i: F.substr(F.lpad(F.hex(n), digits, "0"), i, F.lit(2)))), ""
    )
    low = seq.bitwiseAND(F.lit((1 << 32) - 1))
    return F.concat(little(low, 8), little(F.octet_length(body).bitwiseAND(F.lit(65535)).cast("bigint"), 4), F.hex(F.encode(body, "utf-8")))


def checksums_of(rows: DataFrame, batch: list[str], start: str, framed_bytes: Column) -> DataFrame:
    """CRC-32 per sector over its 4,092 bytes, those behind the last entry zero: (batch, sector_id, crc).

    ``start`` is an entry's place in its batch's byte stream.  An entry that crosses sectors gives
    each its part, so a sector is checked whole; it holds at most 682 parts.
    """
    first, last = F.expr(f"{start} div {SECTOR}"), F.expr(f"({start} + _size - 1) div {SECTOR}")
    parts = (
        rows.select(*batch, F.col(start), framed_bytes.alias("_hex"))
        .withColumn("_size", F.length("_hex") / 2)
        .withColumn("_size", F.col("_size").cast("bigint"))
        .withColumn("sector_id", F.explode(F.sequence(first, last)))
        .withColumn("_from", F.greatest(F.col(start), F.col("sector_id") * SECTOR))
        .withColumn("_upto", F.least(F.col(start) + F.col("_size"), (F.col("sector_id") + 1) * SECTOR))
        .select(
            *batch,
            "sector_id",
            F.struct(
                F.col("_from"),
                F.substr("_hex", ((F.col("_from") - F.col(start)) * 2 + 1).cast("int"), ((F.col("_upto") - F.col("_from")) * 2).cast("int")).alias("p"),
            ).alias("_part"),
        )
    )
    stream = F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda e: e["p"]), "")
    return parts.groupBy(*batch, "sector_id").agg(F.crc32(F.unhex(F.rpad(stream, 2 * SECTOR, "0"))).alias("crc"))


def sector_checksums(log: DataFrame, seq: str, payload: str) -> DataFrame:
    """CRC-32 per sector of the log: framed entries in order, zeros behind the last one."""
    own = log.select(F.col(seq).cast("bigint").alias("_seq"), F.col(payload).alias("_payload"))
    sized = own.withColumn("_bytes", utf8_bytes(F.col("_payload")) + HEADER)
    return checksums_of(sum_before(sized, "_seq", "_bytes", "_start"), [], "_start", frame(F.col("_seq"), F.col("_payload")))


def oversize_entries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Entries that do not fit two sectors, and those beyond a 16-bit length."""
    size = utf8_bytes(F.col(text))
    return rows.where(size > 2 * SECTOR).select(key, size.alias("size"), (size > 65535).alias("beyond_u16"))
