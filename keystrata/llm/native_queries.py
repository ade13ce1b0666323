"""Queries op4, op5, op8 and op10 with the SQL of their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.chat import format_chats, loss_text, parse_turns
from keystrata.llm.exact_dedup import exact_dedup
from keystrata.llm.mixing import mix
from keystrata.llm.sharding import interleave

PROBE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    made = format_chats(chats.unionByName(probe)).withColumn("turns", parse_turns(F.col("formatted")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return made.withColumn("loss", loss_text(F.col("segments"))).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


OP4_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(t, '([\[<])(\\*)(/?INST\]|/?SYS\]|OUT\]|/?TURN|/?s>)', '\1#\2\3', 'g')) AS esc,
         CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 16 + 2 * strlen(role) END AS marks
  FROM rows_
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(esc + marks) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, t),
                         's|s?u(au)*a?') AS valid
FROM e GROUP BY conv_id
"""


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(_table(spark, sf_dir, "documents"), refill=True, rounds=REFILLS)
    return made.select("doc_id", "size", "source_size", "target", "taken")


#: Passes that go on past documents that do not fit.
REFILLS = 4


def _refill_sql(n: int) -> str:
    return f"""), small{n} AS (
  SELECT l.stratum, l.k, l.doc_id, l.size, l.rank_, o.open_ FROM left{n - 1} l JOIN open{n - 1} o ON l.stratum = o.stratum
  WHERE CAST(l.size AS DOUBLE) <= o.open_
), pass{n} AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY stratum ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) <= open_ AS fits FROM small{n}
), added{n} AS (SELECT stratum, sum(size) AS added FROM pass{n} WHERE fits GROUP BY stratum
), open{n} AS (
  SELECT o.stratum, o.open_ - CAST(coalesce(a.added, 0) AS DOUBLE) AS open_ FROM open{n - 1} o LEFT JOIN added{n} a ON a.stratum = o.stratum
), left{n} AS (SELECT stratum, k, doc_id, size, rank_ FROM pass{n} WHERE NOT fits
"""


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS stratum, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT stratum, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY 1
), w AS (
  SELECT *, 2 * size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY stratum) - 1) % 3 + 1] AS weight FROM s
), f AS (
  SELECT *, 3 * sum(size) OVER () - 2 * coalesce(sum(cap) OVER earlier, 0) AS left2,
         sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights
  FROM w WINDOW earlier AS (ORDER BY cap / weight, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (SELECT *, weight * left2 > 2 * cap * weights AS over_ FROM f
), level AS (SELECT left2, weights FROM g WHERE NOT over_ ORDER BY cap / weight, stratum LIMIT 1
), t AS (
  SELECT stratum, size AS source_size,
         CASE WHEN over_ OR (SELECT count(*) FROM level) = 0 THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight AS DOUBLE) * CAST((SELECT left2 FROM level) AS DOUBLE) / CAST(2 * (SELECT weights FROM level) AS DOUBLE) END AS target
  FROM g
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         row_number() OVER w AS rank_, sum(d.size) OVER w AS upto
  FROM d JOIN t USING (stratum) WINDOW w AS (PARTITION BY d.stratum ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)
), x AS (SELECT *, target - whole * source_size AS extra FROM r
), y AS (SELECT *, size > 0 AND CAST(upto AS DOUBLE) <= extra AS fits FROM x
), open0 AS (
  SELECT stratum, max(extra) - CAST(coalesce(sum(CASE WHEN fits THEN size END), 0) AS DOUBLE) AS open_ FROM y GROUP BY stratum
), left0 AS (SELECT stratum, k, doc_id, size, rank_ FROM y WHERE NOT fits AND size > 0
REFILL), taken AS (
  SELECT stratum, rank_ FROM y WHERE fits TAKEN
), rest AS (
  SELECT y.stratum, y.rank_, abs(CAST(y.size AS DOUBLE) - o.open_) AS miss FROM y JOIN openLAST o ON o.stratum = y.stratum
  LEFT JOIN taken t ON t.stratum = y.stratum AND t.rank_ = y.rank_
  WHERE t.rank_ IS NULL AND y.size > 0 AND abs(CAST(y.size AS DOUBLE) - o.open_) < o.open_
), b AS (
  SELECT stratum, rank_ FROM (SELECT stratum, rank_, row_number() OVER (PARTITION BY stratum ORDER BY miss, rank_) AS i FROM rest) r WHERE i = 1
), once AS (SELECT stratum, rank_ FROM taken UNION ALL SELECT stratum, rank_ FROM b
)
SELECT y.doc_id, y.size, y.source_size, y.target, CAST(y.size * (y.whole + CASE WHEN c.rank_ IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM y LEFT JOIN once c ON c.stratum = y.stratum AND c.rank_ = y.rank_
"""
OP5_SQL = (
    OP5_SQL.replace("REFILL", "".join(_refill_sql(n) for n in range(1, REFILLS + 1)))
    .replace("TAKEN", "".join(f"UNION ALL SELECT stratum, rank_ FROM pass{n} WHERE fits " for n in range(1, REFILLS + 1)))
    .replace("openLAST", f"open{REFILLS}")
)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(_table(spark, sf_dir, "documents"))


#: The table of the reflected CRC-32 polynomial, by its rule, and the checksum of the bytes of ``t``.
CRC_SQL = """crc_table AS (
  SELECT [list_reduce(list_prepend(CAST(i AS BIGINT), [0::BIGINT FOR j IN range(0, 8)]),
            lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) FOR i IN range(0, 256)] AS tab
)"""
CRC_OF = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
   [('0x' || substr(hex(encode({t})), CAST(2 * i - 1 AS INT), 2))::BIGINT FOR i IN range(1, strlen({t}) + 1)]),
   lambda a, b: xor(a >> 8, tab[xor(a, b) % 256 + 1])))"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS stratum, md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         strlen(coalesce(text, '')) + 16 AS size, coalesce(text, '') AS t
  FROM documents
), f AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, size) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY stratum) AS fraction FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, k, doc_id, size) - 1 AS at_, count(*) OVER () AS n FROM f
), s AS (SELECT *, CAST(at_ * 40 // n AS INTEGER) AS shard FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, 'rows' AS law, shard, CAST(at_ - (shard * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard,
       text_crc32
FROM (SELECT s.*, CRC AS text_crc32 FROM s, crc_table) x
"""
OP10_SQL = OP10_SQL.replace("WITH d AS", "WITH " + CRC_SQL + ", d AS", 1).replace("CRC AS", CRC_OF.format(t="t") + " AS", 1)

QUERIES = {
    "op4_chat_format": op4_chat_format,
    "op5_mix": op5_mix,
    "op8_exact_dedup": op8_exact_dedup,
    "op10_shards": op10_shards,
}
ORACLES = {"op4_chat_format": OP4_SQL, "op5_mix": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op10_shards": OP10_SQL}
