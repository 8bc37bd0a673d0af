"""Rendezvous hashing of record keys over weighted shards, in SQL functions only.

Every (key, shard) pair draws a uniform number u from a digest; a key goes to the shard with the least ``-ln(u) / w``.
The draw of a pair does not depend on the other shards, so one more shard only takes keys into itself, and a shard of
weight w gets its share w / sum(w) of the keys.

Defined cases: a missing key is a key of its own; rows with equal keys share a shard; a null or empty text has no
bytes (size 1, crc32 0); an empty table gives no rows; other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.llm.common import count_copies, expand_copies, hex_number, key_text, running_start, table
from costweave.llm.registry import query
from costweave.session import cut_lineage

#: Hex digits of the digest that a draw uses; a double holds 52 bits exactly.
DRAW_DIGITS = 13
#: Hex digits of the key's digest that cut a shard into segments.
SEGMENT_DIGITS = 3
#: Production parameters of the query: eight shards of equal weight, then a ninth.
SHARDS = (1.0,) * 8
ONE_MORE = 1.0


def shard_scores(key: Column, weights: Sequence[float]) -> Column:
    """Array with ``-ln(u) / weight`` of each shard."""
    if any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")

    def score(weight: Column, shard: Column) -> Column:
        digest = F.md5(F.concat(key_text(key), F.lit(":"), shard.cast("string")))
        u = (hex_number(digest, 1, DRAW_DIGITS).cast("double") + 0.5) / float(16**DRAW_DIGITS)
        return -F.log(u) / weight

    return F.transform(F.array(*[F.lit(float(w)) for w in weights]), score)


def least_score(scores: Column) -> Column:
    """Place of the least score, from 0."""
    return (F.array_position(scores, F.array_min(scores)) - 1).cast("int")


def assign_shards(
    df: DataFrame, key: str, weights: Sequence[float], extra: float | None = None, shard: str = "shard"
) -> DataFrame:
    """Adds the shard of each row and, given the weight of one more shard, ``grown_<shard>`` with it. No shuffle."""
    every = [*weights, *([extra] if extra is not None else [])]
    scored = df.withColumn("__scores", shard_scores(F.col(key), every))
    placed = scored.withColumn(shard, least_score(F.slice("__scores", 1, len(weights))))
    if extra is not None:
        placed = placed.withColumn(f"grown_{shard}", least_score(F.col("__scores")))
    return placed.drop("__scores")


def number_slots(df: DataFrame, group: str, key: str, slot: str = "slot") -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, in the order of a digest of the key, then the columns.

    Equal rows are counted first and dealt out again, so neither a large group nor a much repeated row meets in a task.
    """
    digest = hex_number(F.md5(key_text(F.col(key))), 1, SEGMENT_DIGITS).cast("int")
    counted = cut_lineage(count_copies(df.withColumn("__part", digest), "__copies"))
    placed = running_start(counted, [group], "__part", df.columns, "__copies", "__start")
    rows = expand_copies(placed, "__copies", "__copy")
    return rows.select(*df.columns, (F.col("__start") + F.col("__copy")).alias(slot))


SQL_SHARDS = f"""
WITH docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(CAST(doc_id AS VARCHAR), '<null>') AS k,
    hex(encode(coalesce(text, ''))) AS hx
  FROM documents),
steps AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j:
    CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i)),
crc_table AS (SELECT list(v ORDER BY i) AS crc FROM steps),
bytes AS (
  SELECT docs.*, crc, list_transform(range(CAST(length(hx) / 2 AS BIGINT)), lambda i: i) AS ix,
    list_transform(string_split(hx, ''), lambda d: ascii(d) - CASE WHEN d <= '9' THEN 48 ELSE 55 END) AS digit
  FROM docs, crc_table),
summed AS (
  SELECT doc_id, size, k, CASE WHEN size = 1 THEN 0::BIGINT ELSE
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(ix, lambda i: CAST(digit[2 * i + 1] * 16 + digit[2 * i + 2] AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) END AS text_crc32
  FROM bytes),
scored AS (
  SELECT doc_id, size, text_crc32, k, list_transform(range({len(SHARDS) + 1}), lambda j:
    -ln((CAST(('0x' || substr(md5(k || ':' || CAST(j AS VARCHAR)), 1, {DRAW_DIGITS})) AS BIGINT) + 0.5e0)
      / {float(16**DRAW_DIGITS)!r}) / 1e0) AS s
  FROM summed),
placed AS (
  SELECT doc_id, size, text_crc32, k,
    CAST(list_position(s[1:{len(SHARDS)}], list_min(s[1:{len(SHARDS)}])) - 1 AS INTEGER) AS shard,
    CAST(list_position(s, list_min(s)) - 1 AS INTEGER) AS grown_shard
  FROM scored)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, {SEGMENT_DIGITS}), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  grown_shard
FROM placed"""


@query("op1_shards", SQL_SHARDS)
def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards by doc_id, with the shard that one more shard would give."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = number_slots(assign_shards(docs, "doc_id", SHARDS, ONE_MORE), "shard", "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
