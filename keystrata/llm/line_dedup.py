"""Line dedup over overlapping three-line windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import free_names, saved, with_made

#: Lines a window has.
WINDOW = 3


def merge_cover(starts: Iterable[int], width: int = WINDOW) -> list[list[int]]:
    """Half-open stretches of lines that windows beginning at ``starts`` (ascending) cover."""
    out: list[list[int]] = []
    for start in starts:
        if out and start <= out[-1][1]:
            out[-1][1] = start + width
        else:
            out.append([start, start + width])
    return out


def cut_lines(text: str, spans: list[list[int]]) -> str:
    lines, kept, at = text.split("\n"), [], 0
    for start, end in spans:
        kept += lines[at:start]
        at = end
    return "\n".join(kept + lines[at:])


def _cut_texts(texts: list[str | None], starts: list[list[int] | None]) -> list:
    import pyarrow as pa

    spans = [merge_cover(at or []) for at in starts]
    return [
        pa.array([t if t is None or not s else cut_lines(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()),
        pa.array([0 if t is None else t.count("\n") + 1 for t in texts], pa.int32()),
        pa.array([sum(end - start for start, end in s) for s in spans], pa.int32()),
        pa.array(spans, pa.list_(pa.list_(pa.int32()))),
    ]


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Remove every later occurrence of a three-line window that repeats anywhere in the corpus.

    A window is three consecutive lines (cut at ``\\n``, compared as they are) of which one at
    least has a character beside white space.  Of equal windows the first by (doc_id, MD5 of
    the text, position) stays; the lines that later ones cover are merged and removed.  Windows
    overlap, so a repeated passage of n >= 3 lines goes as one stretch.  Texts of fewer lines
    have no window and stay.  A text whose lines all go becomes empty, its row stays.

    Windows are 128-bit hashes in a table of the shared folder; counts and first occurrences
    are combined map-side, and windows that occur once drop out before the second join.
    A window that a third of all documents hold is one row of the small side, and its
    occurrences are split by adaptive skew joins.

    Null text stays null (and null ids come first, as one id).  Rows that repeat one doc_id and
    text are the same document and agree.  All columns are kept; n_lines, removed_lines and
    spans are added (and replace columns so named).  An empty table gives an empty result.
    """
    added = ("n_lines", "removed_lines", "spans")
    kept = [c for c in docs.columns if c.lower() not in added]
    own, doc, text, at = free_names(docs, 4)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.unhex(F.md5("text")).alias(own))
    count = F.size("lines") - WINDOW + 1
    window = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.array_join(F.slice("lines", i + 1, F.lit(WINDOW)), "\n"),
    )
    windows = saved(
        rows.select("doc_id", F.col(own).alias("_id"), F.split("text", "\n").alias("lines"))
        .where(count > 0)
        .select("doc_id", "_id", F.posexplode(window).alias("pos", "window"))
        .where(F.col("window").rlike(r"[^\x20\x09-\x0D]"))
        .select("doc_id", "_id", "pos", F.unhex(F.md5("window")).alias("h")),
        "line-windows",
    )
    place = F.struct("doc_id", "_id", "pos")
    first = windows.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    covered = (
        windows.join(first, "h")
        .where(~place.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "_id")
        .agg(F.sort_array(F.collect_set("pos")).alias("_starts"))
    )
    c = covered.select(F.col("doc_id").alias(doc), F.col("_id").alias(text), F.col("_starts").alias(at))
    joined = rows.join(c, rows["doc_id"].eqNullSafe(c[doc]) & (rows[own] == c[text]), "left")
    made = T.StructType().add("text", "string").add("n_lines", "integer").add("removed_lines", "integer")
    made = made.add("spans", T.ArrayType(T.ArrayType(T.IntegerType())))
    return with_made(joined.select(*[F.col(f"`{x}`") for x in kept], at), "text", made, _cut_texts, at).select(
        *[f"`{x}`" for x in kept], "n_lines", "removed_lines", "spans"
    )
