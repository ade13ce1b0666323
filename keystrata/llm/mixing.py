"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import WORD, ranked_within, saved, seeded_key, stratum_of, text_of
from keystrata.operators.running import SALT, celled, sums_before


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("bigint")


def water_fill(sources: DataFrame, *, half_shares: int = 3, max_epochs: int = 2) -> DataFrame:
    """Targets that share ``half_shares / 2`` of all sizes by weight, none above ``max_epochs`` times its source.

    Clamping goes source by source in order of size / weight: that is the order in which
    rounds of clamping and proportional redistribution fill sources up, so after the first k
    are clamped the rest share what is left by weight, and the rounds end at the first k for
    which the next source is not above its cap.  Sums are whole numbers; the one division
    comes last.  Running sums are cut into ranges of sources, so that any number of sources
    will do; totals and the level, one row, reach the driver.

    Takes stratum, size, weight; adds target (double).
    """
    kept = sources.columns
    totals = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    cap = (F.col("size") * max_epochs).cast("bigint")
    order = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("stratum"))
    filled = sums_before(sources.withColumn("cap", cap).withColumn("order", order), [F.col("order")], {"cap": "clamped", "weight": "passed"})
    wide = lambda c: c.cast("decimal(38,0)")
    rest = saved(
        filled.withColumn("left2", wide(F.lit(half_shares * totals[0])) - 2 * wide(F.col("clamped")))
        .withColumn("weights", F.lit(totals[1]) - F.col("passed"))
        # is this source, first of those not yet clamped, above its cap?
        .withColumn("over", F.col("weight") * F.col("left2") > 2 * wide(F.col("cap")) * F.col("weights")),
        "mix-sources",
    )
    level = rest.where("NOT over").agg(F.min(F.struct("order", "left2", "weights"))).first()[0]
    open_ = F.lit(level is not None)
    share = F.col("weight").cast("double") * F.lit(float(level.left2 if level else 0)) / F.lit(float(2 * level.weights if level else 1))
    return rest.select(*kept, F.when(F.col("over") | ~open_, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _filled_round(cells: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass of the fill over rows left: those no larger than their source's gap, up to the first that does not fit.

    Gives the rows of the pass with ``fits``, and the gaps (stratum, open) after it.
    """
    small = cells.join(gaps, "stratum").where(F.col("size").cast("double") <= F.col("open"))
    upto = (F.col("before") + F.col("size")).cast("double")
    ranked = ranked_within(small, "stratum", ["key", "doc_id", "size"], "size").withColumn("fits", upto <= F.col("open"))
    made = saved(ranked.select(*cells.columns, "fits"), "mix-fill")
    added = made.where("fits").groupBy("stratum").agg(F.sum("size").alias("added"))
    left = F.col("open") - F.coalesce("added", F.lit(0)).cast("double")
    return made, saved(gaps.join(added, "stratum", "left").select("stratum", left.alias("open")), "mix-gaps")


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    half_shares: int = 3,
    max_epochs: int = 2,
    seed: str = "mix",
    refill: bool = False,
    rounds: int | None = None,
) -> DataFrame:
    """How many words of every document the mixture takes.

    Sources in code-point order (null last) weigh ``weights``, repeating.  Every document is
    taken ``floor(target / source size)`` times whole.  The fraction left is filled once more
    with whole documents in a seeded order of the source, up to the first that does not fit;
    of the rest, the document whose size comes nearest to what is still open is taken too if
    that brings the source nearer to its target.  Running sums are cut into range partitions
    of the whole order, so that a source with a third of all rows is no single task.

    With ``refill`` a document that does not fit does not end the fill: it goes on with the later
    ones that do, in as many passes as it takes or at most ``rounds``, and the one that comes
    nearest follows.

    Null text has size 0 and takes nothing; a source of size 0 has target 0.  Repeated rows
    count and are taken each by itself.  Null source is one source.  An empty table gives an
    empty result.  Other columns are ignored.  The order depends on seed and ids alone, so
    reruns agree.

    Returns doc_id, size, source_size, target, taken, repeats.
    """
    # texts are read once: cutting the rows into ranges reads them twice
    thin = docs.select("doc_id", stratum_of().alias("stratum"), seeded_key(seed).alias("key"), word_count().alias("size"))
    thin = saved(thin, "mix-sizes")
    order = ["key", "doc_id", "size"]
    # rows that tie in all of the order are the same to the mixture; their number in the scan tells them apart
    rows = celled(thin, [F.col(c) for c in ("stratum", *order)], "mix-rows", F.monotonically_increasing_id())
    totals = saved(rows.groupBy("stratum").agg(F.sum("size").alias("size")).withColumn("one", F.lit(1)), "mix-sizes")
    step = (F.col("place") % len(weights)).cast("int")
    sources = sums_before(totals, [F.col("stratum")], {"one": "place"}).select(
        "stratum", "size", F.get(F.lit(list(weights)), step).cast("bigint").alias("weight")
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = saved(
        water_fill(sources, half_shares=half_shares, max_epochs=max_epochs)
        .select("stratum", F.col("size").alias("source_size"), "target")
        .withColumn("whole", whole.cast("bigint")),
        "mix-targets",
    )
    extra = F.col("target") - F.col("whole") * F.col("source_size")
    upto = (F.col("before") + F.col("size")).cast("double")
    first = saved(
        ranked_within(rows, "stratum", order, "size")
        .join(targets.select("stratum", extra.alias("extra")), "stratum")
        .select(*rows.columns, "extra", ((F.col("size") > 0) & (upto <= F.col("extra"))).alias("fits")),
        "mix-fill",
    )
    filled = F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).cast("double")
    gaps = saved(first.groupBy("stratum").agg((F.max("extra") - filled).alias("open")), "mix-gaps")
    passes = [first.select(*rows.columns, "fits")]
    left = passes[0].where("NOT fits AND size > 0")
    while refill and (rounds is None or len(passes) <= rounds):
        made, gaps = _filled_round(left.select(rows.columns), gaps)
        if made.isEmpty():
            break
        passes.append(made)
        left = made.where("NOT fits")
    taken = passes[0].where("fits")
    for made in passes[1:]:
        taken = taken.unionByName(made.where("fits"))
    # a row is named by its cell and salt
    name = ["stratum", "_cell", SALT]
    rest = first.where("NOT fits AND size > 0").select(rows.columns).join(taken.select(name), name, "left_anti") if len(passes) > 1 else left
    miss = F.abs(F.col("size").cast("double") - F.col("open"))
    last = saved(
        rest.join(gaps, "stratum")
        .withColumn("miss", miss)
        .where("miss < open")
        .groupBy("stratum")
        .agg(F.min(F.struct("miss", *order, "_cell", SALT)).alias("last"))
        .select("stratum", "last._cell", f"last.{SALT}"),
        "mix-last",
    )
    once = taken.select(name).unionByName(last.select(name)).withColumn("again", F.lit(1).cast("bigint"))
    return (
        rows.join(targets, "stratum")
        .join(once, name, "left")
        .withColumn("repeats", F.col("whole") + F.coalesce("again", F.lit(0)))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")
    )
