"""Queries op1, op2, op3, op6, op7 and op9, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import bounded_batches
from keystrata.llm.langid import held_out, identify
from keystrata.llm.line_dedup import dedup_lines
from keystrata.llm.media import text_as_media
from keystrata.llm.ngram_join import jaccard_classes
from keystrata.llm.sentencepiece_fst import encode_texts
from keystrata.llm.warc import read_warc_files, with_revisits, write_warc_files
from keystrata.sources.scratch import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_as_media(_table(spark, sf_dir, "documents")).drop("tile")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed_lines", "text")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, text, md5(text) AS u, string_split(text, chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, u, i AS pos, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS w
  FROM (SELECT doc_id, u, lines, unnest(range(0, len(lines) - 2)) AS i FROM d WHERE len(lines) > 2) x
), k AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, u, pos) AS rn FROM w WHERE regexp_matches(w, '[^\x20\x09-\x0D]')
), c AS (
  SELECT DISTINCT doc_id, u, unnest([pos, pos + 1, pos + 2]) AS p FROM k WHERE rn > 1
), l AS (
  SELECT doc_id, u, unnest(lines) AS line, unnest(range(0, len(lines))) AS p FROM d WHERE text IS NOT NULL
), o AS (
  SELECT l.doc_id, l.u, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(c.p) AS INTEGER) AS removed_lines,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (c.p IS NULL), '') AS text
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.u = c.u AND l.p = c.p GROUP BY 1, 2
)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.removed_lines, 0) AS removed_lines, o.text
FROM d LEFT JOIN o ON d.doc_id = o.doc_id AND d.u = o.u
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_tokens", "decodes", "ids")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_revisits(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    files = write_warc_files(pages, fresh_path(spark, "archives"))
    return read_warc_files(files, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, lower(sha1(coalesce(html, ''))) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best
  FROM pages
), b AS (
  SELECT *, list_aggregate([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
                            [instr('0123456789abcdef', substr(hex, CAST(i AS INT), 1))] FOR i IN range(1, 41)], 'string_agg', '') AS bits
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
          1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
            + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT)
            + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1) FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b
"""


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = identify(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = jaccard_classes(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return made.select("doc_id", "n_shingles", "component_id", "n_links")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [w[CAST(i + 1 AS INT)] || ' ' || w[CAST(i + 2 AS INT)] || ' ' || w[CAST(i + 3 AS INT)] || ' ' || w[CAST(i + 4 AS INT)] FOR i IN range(0, len(w) - 3)] END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1
), l AS (SELECT x, count(*) AS n_links FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(l.n_links, 0) AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id LEFT JOIN l ON l.x = d.doc_id
"""


QUERIES = {"op1_media": op1_media, "op2_line_dedup": op2_line_dedup, "op3_sentencepiece": op3_sentencepiece, "op6_warc": op6_warc, "op7_langid": op7_langid, "op9_ngram_jaccard": op9_ngram_jaccard}
ORACLES = {"op9_ngram_jaccard": OP9_SQL, "op2_line_dedup": OP2_SQL, "op6_warc": OP6_SQL}
