"""Sharding by a Feistel permutation of global row numbers; DataFrame functions only.

Rows are numbered from 0 in the order of MD5(doc_id). A keyed Feistel network permutes the numbers 0 to n - 1; row
number's image p goes to shard p % shards, slot p div shards. So shard and slot of any row can be computed from
its number, n and the seed, shard counts differ by one row at most, and slots have no gaps.

The network works on pairs (left, right) with left < a, right < b, where a = ceil(sqrt(n)), b = ceil(n / a). That domain
has fewer than a numbers too many; an image beyond n is permuted again until it falls within (cycle walking).
WALK steps are laid out; a row that needs more, less likely than a ** -WALK, fails the job rather
than get a wrong slot.

Null texts have size 1 and CRC 0. A null doc_id is numbered like an empty key. Rows that repeat a doc_id get numbers
by size and CRC; full copies are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear, table
from .ordering import numbered

ROUNDS = 6
WALK = 40


def _mixed(half: Column, step: Column, seed: str) -> Column:
    """A round's 32-bit function value."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), step.cast("string"), half.cast("string"))), 1, 8), 16, 10).cast("long")


def permuted(number: Column, n: Column, seed: str) -> Column:
    """Image of number under the permutation of 0 to n - 1 that seed keys."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")
    pair = lambda left, right: F.struct(left.alias("left"), right.alias("right"))

    def network(x: Column) -> Column:
        turn = lambda s, i: F.when(i % 2 == 0, pair((s["left"] + _mixed(s["right"], i, seed)) % a, s["right"])).otherwise(
            pair(s["left"], (s["right"] + _mixed(s["left"], i, seed)) % b)
        )
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(F.floor(x / b).cast("long"), x % b), turn, lambda s: s["left"] * b + s["right"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), network(number), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return walked


def sharded(rows: DataFrame, key: str, ties: list[str], shards: int = 16, seed: str = "0") -> DataFrame:
    """rows with shard and slot by the permutation; columns of these names give way to the result's."""
    own = rows.drop("shard", "slot")
    p = clear(own)
    number, total, image = f"{p}number", f"{p}total", f"{p}image"
    placed = numbered(own, key, [], ties, number, total).withColumn(image, permuted(F.col(number), F.col(total), seed))
    at = F.when(F.col(image) < F.col(total), F.col(image)).otherwise(F.raise_error(F.lit("cycle walk too short")).cast("long"))
    return placed.withColumn(image, at).select(
        *own.columns, (F.col(image) % shards).cast("int").alias("shard"), F.floor(F.col(image) / shards).cast("long").alias("slot")
    )


def op6_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharded(rows, "doc_id", ["size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The same in DuckDB; the CRC goes byte by byte through the table of the polynomial 0xEDB88320.
OP6_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)
), sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         CAST(xor(list_reduce([4294967295::BIGINT] || [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')],
                         lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295::BIGINT) AS BIGINT) AS text_crc32
  FROM documents, crc_table
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size, text_crc32) - 1 AS num, count(*) OVER () AS n FROM sized
), sides AS (
  SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM numbered
), walk(doc_id, size, text_crc32, num, n, a, b, x, step) AS (
  SELECT doc_id, size, text_crc32, num, n, a, (n + a - 1) // a, num, 0 FROM sides
  UNION ALL
  SELECT doc_id, size, text_crc32, num, n, a, b,
         list_reduce([x] || range({ROUNDS}), lambda s, i: CASE WHEN i % 2 = 0
           THEN ((s // b + CAST('0x' || substr(md5('0:' || i || ':' || (s % b)), 1, 8) AS BIGINT)) % a) * b + s % b
           ELSE (s // b) * b + (s % b + CAST('0x' || substr(md5('0:' || i || ':' || (s // b)), 1, 8) AS BIGINT)) % b END), step + 1
  FROM walk WHERE step = 0 OR x >= n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 16 AS INTEGER) AS shard, CAST(x // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM walk WHERE step > 0 AND x < n
"""
