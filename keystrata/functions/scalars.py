"""Scalar rules of the record format, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_uint(value: Column, bits: int) -> Column:
    """Unsigned store of ``bits`` bits: truncated toward zero, wrapped, NaN and infinities as 0."""
    return F.coalesce(F.pmod(value.try_cast("bigint"), F.lit(1 << bits)), F.lit(0)).cast("bigint")


def align8(n: Column) -> Column:
    whole = n.cast("bigint") + 7
    return whole - F.pmod(whole, F.lit(8))


def padded_key(prefix: str, n: Column, width: int = 5) -> Column:
    """``prefix`` and the number padded with zeros; longer numbers are kept whole."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{width}d", n))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def checksum(text: Column) -> Column:
    """CRC-32 (IEEE) of the UTF-8 bytes."""
    return F.crc32(F.coalesce(text, F.lit("")))


def lcg_next(seed: Column) -> Column:
    """Next state of the workload's linear congruential generator."""
    return (seed * 9301 + 49297) % 233280
