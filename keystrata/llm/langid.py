"""Language identification by compression against per-language dictionaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import saved, with_made

UNKNOWN = "und"


def training_samples(
    labelled: DataFrame, *, docs_per_lang: int = 256, chars_per_doc: int = 1024, max_langs: int = 256
) -> dict[str, str]:
    """Bounded sample of labelled text: at most ``docs_per_lang`` documents a language, evenly spread
    by a hash of their ids, and a stretch of at most ``chars_per_doc`` characters of each, whose
    place the hash chooses.

    Ids of rows with a label and a text are hashed into ``docs_per_lang`` cells a language and
    the least hash of each cell is kept, combined map-side; a second scan takes their texts.
    Languages come in order of their labelled documents, most first, and the model has the first
    ``max_langs`` of them: the sample, which reaches the driver, has a bound of its own.
    """
    h = F.xxhash64("doc_id", F.lit(7))
    keyed = labelled.select("lang", "text", h.alias("h")).where("lang is not null and text is not null")
    cells = saved(
        keyed.groupBy("lang", F.pmod("h", F.lit(docs_per_lang)).alias("cell")).agg(F.min("h").alias("h"), F.count("*").alias("n")),
        "language-cells",
    )
    largest = cells.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_langs)
    counts = {r["lang"]: r["n"] for r in largest.collect()}
    # at most docs_per_lang rows a language
    chosen = cells.where(F.col("lang").isin(*counts)).select("lang", "h")
    start = F.pmod("h", F.greatest(F.length("text") - chars_per_doc, F.lit(0)) + 1).cast("int") + 1
    rows = (
        keyed.join(F.broadcast(chosen), ["lang", "h"])
        .groupBy("lang", "h")
        .agg(F.min(F.substring("text", start, F.lit(chars_per_doc))).alias("text"))
        .orderBy("lang", "h")
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for row in rows:
        samples.setdefault(row["lang"], []).append(row["text"])
    return {lang: "\n".join(samples[lang]) for lang in sorted(samples, key=lambda x: (-counts[x], x))}


_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words of letters only, one space between: what the encoders see of a text."""
    return " ".join(_LETTERS.findall(text.lower()))


class Compressors:
    """One zstandard compressor a language, primed with its sample as raw dictionary content.

    ``samples`` is in order of preference: of equal encodings the first language wins.
    """

    def __init__(self, samples: dict[str, bytes], level: int = 3, piece: int = 4096):
        import zstandard

        self.langs = list(samples)
        self.piece = piece

        def primed(packing: int) -> list:
            out = []
            for lang in self.langs:
                # zstandard wants eight bytes of dictionary at least
                data = zstandard.ZstdCompressionDict(samples[lang].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(packing)
                out.append(zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))
            return out

        self.fast, self.fine = primed(level), primed(19)

    def sizes(self, packers: list, text: str) -> list[int]:
        """Compressed bytes of the whole text under each language, piece by piece so that the
        dictionary, not the text's own past, explains every piece."""
        data = text.encode("utf-8", "surrogatepass")
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        return [sum(len(p.compress(x)) for x in pieces) for p in packers]

    @staticmethod
    def narrowest(sizes: list[int]) -> tuple[int, float]:
        """Place of the smallest size and its margin: by which part the next one exceeds it."""
        at = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:at] + sizes[at + 1 :]
        return at, (min(others) - sizes[at]) / min(others) if others else 1.0

    def best(self, text: str, narrow: float = 0.03) -> tuple[str, float, float]:
        """Language of the smallest encoding, its score and its margin.

        Below a margin of ``narrow`` the whole text is encoded once more at the finest level, so
        that no coarse match decides."""
        words = letters(text)
        at, margin = self.narrowest(self.sizes(self.fast, words))
        if margin < narrow:
            at, margin = self.narrowest(self.sizes(self.fine, words))
        return self.langs[at], 0.5 + 0.5 * margin, margin


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, docs_per_lang: int = 256, chars_per_doc: int = 1024, min_margin: float = 0.0) -> DataFrame:
    """Add lang_pred, score, margin and accepted to every document.

    Learns from rows that are not held out and whose lang is not null, at most
    ``docs_per_lang`` documents of ``chars_per_doc`` characters a language; every text is then
    compressed whole under every language's dictionary.  ``accepted`` is false for texts
    without a letter (null and empty ones too), which are ``und``, and where the margin is
    below ``min_margin``.  Equal texts have equal results.  Without a labelled row all texts
    are ``und``.  Columns named like the added ones are replaced; all others are kept.  An empty
    table gives an empty result.
    """
    samples = training_samples(docs.where(~held_out()), docs_per_lang=docs_per_lang, chars_per_doc=chars_per_doc)
    primers = {lang: letters(text).encode("utf-8", "surrogatepass") for lang, text in samples.items()}
    added = (
        T.StructType().add("lang_pred", "string").add("score", "double").add("margin", "double").add("accepted", "boolean")
    )
    model = None

    def make(texts: list[str | None]) -> list:
        import pyarrow as pa

        from keystrata.llm.langid import UNKNOWN, Compressors

        nonlocal model
        if model is None and primers:
            model = Compressors(primers)
        made = [model.best(t) if primers and t is not None and any(map(str.isalpha, t)) else (UNKNOWN, 0.0, 0.0) for t in texts]
        langs, scores, margins = zip(*made, strict=True) if made else ((), (), ())
        accepted = [lang != UNKNOWN and margin >= min_margin for lang, margin in zip(langs, margins, strict=True)]
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(accepted, pa.bool_())]

    return with_made(docs, "text", added, make)
