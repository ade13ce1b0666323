"""Exact dedup through an extendible-hash index kept on shared files (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystrata.llm.common import SPACES, marked, saved, text_of

#: Doublings beyond those that even buckets ask for; what is still overfull then relies on its chains.
SPARE_BITS = 4


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("bigint")


def directory(hashes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Grow an extendible-hash directory (slot, bucket, depth) for distinct hashes ``h``; also gives its depth.

    It starts with one bucket of depth 0.  A bucket of more than ``capacity`` hashes splits on its
    next bit, and the directory, which has a slot for every prefix of its depth, doubles as
    often as the deepest bucket asks for.  How deep it may get follows from the number of
    hashes.  All splits are found at once: hashes are counted by their prefix at the greatest
    depth, prefixes are summed up to every lesser one, and a bucket is a prefix that fits while
    the one above it does not.

    A bucket is named by its first slot, so that buckets rise with the hash and each is a
    range of it.  Slots of buckets without a hash are left out.  The directory is a table in
    the shared folder; its rows follow the number of buckets.
    """
    count = hashes.count()
    deepest = min(62, math.ceil(math.log2(max(1.0, count / capacity))) + SPARE_BITS) if count > capacity else 0
    cells = hashes.groupBy(_slot(deepest).alias("slot")).agg(F.count("*").alias("keys"))
    node = F.explode(F.transform(F.sequence(F.lit(0), F.lit(deepest)), lambda d: F.struct(d.alias("depth"), F.call_function("shiftright", F.col("slot"), F.lit(deepest) - d).alias("prefix"))))
    nodes = saved(
        cells.select(node.alias("node"), "keys").groupBy("node.depth", "node.prefix").agg(F.sum("keys").alias("keys")), "dedup-prefixes"
    )
    above = nodes.where(F.col("keys") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    fits = (F.col("keys") <= capacity) | (F.col("depth") == deepest)
    split = nodes.withColumn("above", F.shiftright("prefix", 1)).join(above, ["depth", "above"], "left_semi").where(fits)
    buckets = saved(nodes.where("depth = 0").where(fits).select("depth", "prefix").unionByName(split.select("depth", "prefix")), "dedup-buckets")
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    slots = F.explode(F.sequence(first, F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1")))
    return saved(buckets.select(slots.alias("slot"), first.alias("bucket"), "depth"), "dedup-directory"), depth


def _whole(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(38,0)")


def exact_dedup(docs: DataFrame, *, capacity: int = 4096, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Group documents whose texts are identical once white space is deleted.

    1. One pass writes an entry per row (hash, digest, length; no text) to the shared folder.
    2. The directory grows over the distinct hashes (``directory``): buckets of at most
       ``capacity`` of them, each a range of hashes.
    3. Texts whose hash occurs more than once (and few others, by a bitmap) are combined by
       their bytes, map-side first, so a text held by a third of all rows leaves a map task as one
       row.  Other texts are alone and need no comparison.
    4. The directory routes every distinct text to its bucket, and a bucket to its owner task.
       The owner chains the texts of one hash, compares the bytes of neighbours, and writes its
       part of the index (bucket, hash, chain, digest, keeper, size) to the shared folder.
    5. Every entry probes the directory for its bucket, and the bucket's chain for its group.

    Null text counts as empty, and empty texts form one group.  The row with most code points
    in its original text stays, then the smallest doc_id; a null doc_id comes last.  Rows that
    repeat one doc_id and text are the same document and agree in every column.  Other
    columns are ignored.  An empty table gives an empty result.  ``hash_of`` may be any
    64-bit hash: one with collisions makes longer chains, and buckets that cannot split.  Two
    texts of one hash, length and SHA-256 but different bytes end the job.

    Returns doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.
    """
    norm = F.translate(text_of(), SPACES, "")
    base, top = _whole(10**20), _whole(1 << 63)  # base is above any 64-bit id
    preference = F.length(text_of()).cast("decimal(38,0)") * base + F.coalesce(top - F.col("doc_id").cast("decimal(38,0)"), _whole(0))
    rows = docs.select("doc_id", preference.cast("decimal(38,0)").alias("best"), norm.alias("norm")).withColumn("h", hash_of(F.col("norm")).cast("bigint"))
    mark = {"sha": F.unhex(F.sha2("norm", 256)), "n_bytes": F.octet_length("norm")}
    entries = saved(rows.withColumns(mark).drop("norm"), "dedup-entries")
    hashes = saved(entries.groupBy("h").agg(F.count("*").alias("n")), "dedup-hashes")
    slots, depth = directory(hashes, capacity)
    repeated = hashes.where("n > 1").select(F.col("h").alias("cell"))
    sizes = [F.count("*").alias("group_size"), F.max("best").alias("best")]
    copies = marked(rows, F.col("h"), repeated, "dedup-bits").where("marked").groupBy("h", "norm").agg(*sizes)
    single = marked(entries, F.col("h"), repeated, "dedup-bits").where("NOT marked")
    none = F.lit(None).cast("string")
    texts = copies.withColumns(mark).unionByName(single.select("h", none.alias("norm"), F.lit(1).cast("bigint").alias("group_size"), "best", "sha", "n_bytes"))
    owned = texts.withColumn("slot", _slot(depth)).join(slots, "slot").repartition("bucket")
    chain = Window.partitionBy("bucket", "h").orderBy("n_bytes", "sha", "norm")
    same = F.col("before") == F.struct("n_bytes", "sha")
    left = F.col("best") % base
    index = saved(
        owned.withColumn("chain", F.row_number().over(chain))
        .withColumn("before", F.struct(F.lag("n_bytes").over(chain), F.lag("sha").over(chain)))
        .withColumn("chain", F.when(same, F.raise_error(F.lit("two different texts share hash, length and digest")).cast("int")).otherwise(F.col("chain")))
        .select("bucket", "h", "chain", "n_bytes", "sha", "group_size", F.when(left != 0, (top - left).cast("bigint")).alias("keep_id")),
        "dedup-index",
    )
    probes = entries.drop("best").withColumn("slot", _slot(depth)).join(slots, "slot")
    return probes.join(index, ["bucket", "h", "n_bytes", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "chain",
    )
