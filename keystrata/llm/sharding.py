"""Shards that each match the mixture: proportional stratified interleaving (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import ranked_within, saved, seeded_key, stratum_of, text_of
from keystrata.operators.running import celled, sums_before


def interleave(docs: DataFrame, *, shards: int = 40, seed: str = "shard") -> DataFrame:
    """Cut all rows into ``shards`` shards whose row counts differ by one at most (law ``rows``).

    Rows are ranked in a seeded shuffle within their source; a row's fractional rank is
    (rank - 1/2) / rows of its source.  Sorted by fractional rank, every stretch of the order
    holds the sources in proportion, and the order is cut at multiples of rows / shards.

    Neither step sorts a source or the table in one task: ranks and positions come from range
    partitions of the whole order, with ties told apart, so that many sources of one row (whose
    fractional ranks are all 1/2) or many rows of one id are cut like all others.  Only id,
    source, size and checksum are shuffled.

    Null text has no bytes; null source is a source of its own; null doc_id sorts by an empty
    id.  Repeated rows each take a slot.  The law leaves no room for keeping equal texts in one
    shard (a group may exceed a shard), so groups are spread like other rows.  With fewer rows
    than shards, some shards are empty.  Other columns are ignored.  An empty table gives an
    empty result.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (always null).
    """
    # texts are read once: cutting the rows into ranges reads them twice
    thin = saved(
        docs.select(
            "doc_id",
            stratum_of().alias("stratum"),
            seeded_key(seed).alias("key"),
            (F.octet_length(text_of()) + 16).cast("bigint").alias("size"),
            F.crc32(text_of()).alias("text_crc32"),
        ),
        "shard-sizes",
    )
    ties = ["doc_id", "size", "text_crc32"]
    order = ["key", *ties]
    cells = celled(thin, [F.col(c) for c in ("stratum", *order)], "shard-rows", F.monotonically_increasing_id())
    ranked = ranked_within(cells, "stratum", order, "size").select(
        *ties, "stratum", "key", ((F.col("rank") - F.lit(0.5)) / F.col("stratum_rows")).alias("fraction"), F.lit(1).alias("one")
    )
    placed = sums_before(ranked, [F.col(c) for c in ("fraction", "stratum", *order)], {"one": "at"})
    rows = thin.count()
    return placed.withColumn("shard", F.expr(f"at * {shards} div {max(1, rows)}").cast("int")).select(
        *ties,
        F.lit("rows").alias("law"),
        "shard",
        (F.col("at") - F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
