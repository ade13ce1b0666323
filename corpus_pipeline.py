"""A training corpus from ``documents``: language ID, line dedup, near-duplicate join, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import bounded_batches, saved
from keystrata.llm.langid import identify
from keystrata.llm.line_dedup import dedup_lines
from keystrata.llm.mixing import mix
from keystrata.llm.ngram_join import jaccard_classes, row_key
from keystrata.llm.sentencepiece_fst import encode_texts
from keystrata.sources.scratch import remove_tables, tables_made

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this margin two languages encode a text equally well and it is rejected.
MIN_MARGIN = 0.005
#: Passes in which the mixture goes on past documents that do not fit.
REFILLS = 4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without letters, null ones and ties go."""
    return identify(docs.select(COLUMNS), min_margin=MIN_MARGIN).where("accepted").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three-line windows; n_chars follows the text."""
    made = dedup_lines(docs.select(COLUMNS))
    return made.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, 0.8) stays: that of the least
    doc_id, null last; of rows that share it, that of the least text hash.

    Empty texts are no duplicates and stay.  Of rows that repeat an id and its text one stays.
    """
    docs = docs.select(COLUMNS)
    stay = jaccard_classes(docs, k=5, num=80, den=100).where("stays").groupBy("key").agg(F.count("*").alias("rows"))
    kept = docs.withColumn("key", row_key()).join(stay, "key")
    # both parts read one shuffle of the texts
    twice = kept.where("rows > 1").dropDuplicates(["doc_id", "text"])
    return kept.where("rows = 1").select(COLUMNS).unionByName(twice.select(COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; those not taken go."""
    taken = mix(docs, refill=True, rounds=REFILLS).where("repeats > 0").groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("repeats").alias("repeats"))
    return (
        docs.join(taken, docs["doc_id"].eqNullSafe(taken["taken_id"]))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
        .select(COLUMNS)
    )


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their piece ids, whose decoding is compared with the text."""
    return encode_texts(docs.select(COLUMNS))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoding),
]

#: Language identification is a learned model, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result but the last written to the shared folder and reread.

    Once a stage's result is written, the tables it was made from are removed: of the shared
    folder the pipeline holds one stage's tables at a time.
    """
    others = set(tables_made(spark))
    docs = bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = saved(docs, f"stage{number}")
            *done, _ = [path for path in tables_made(spark) if path not in others]
            remove_tables(spark, done)
    return docs
