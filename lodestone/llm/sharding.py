"""Operator 6: sharding by proportional stratified interleaving, with SQL functions only.

Rows are shuffled by a seeded hash and ranked within their source; row r of a source of n rows stands at the fraction
(r + 1/2) / n, all rows are sorted by that fraction, and the sorted rows are cut into shards whose counts differ by
one at most, so that every shard has the sources' mixture. Ranks come from bins of the hash, so a source with a third
of all rows is no single task; bins grow in number with the rows. The second order is ranged over partitions by all its columns.

A null source is a source of its own; a null text has size 1 and the checksum of no bytes. Ties (repeated rows) are
ordered by id, then checksum; rows that are alike in all of these are interchangeable. An empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import bins_for, ranked, uniform
from lodestone.operators.ranks import numbered
from lodestone.shared import Scratch


def shards(df: DataFrame, n_shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, text_crc32, fraction, position, shard, slot."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # Texts are read once; numbers of a few bytes a row go on.
    scratch = Scratch(df.sparkSession)
    slim = scratch.save(slim.withColumn("dice", uniform(F.col("id"), F.col("text_crc32"), seed=seed)))
    total = slim.count()
    bins = bins_for(total)
    own = ranked(slim, ["source"], ["dice", "id", "text_crc32"], F.floor(F.col("dice") / F.lit(float(2**52) / bins)), "place")
    of = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "s")
    rows = own.join(of, own["source"].eqNullSafe(F.col("s")), "left").withColumn("fraction", (F.col("place") + F.lit(0.5)) / F.col("n")).drop("s", "n", "place", "dice")
    # Ranged over all columns of the order: many small sources stand at the same few fractions.
    out = numbered(rows, [F.col(c) for c in ("fraction", "source", "id", "text_crc32")], "position")
    out = out.withColumn("shard", F.expr(f"cast((position * {n_shards}) div {max(total, 1)} as int)"))
    out = out.withColumn("slot", F.expr(f"position - (cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}"))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("source", source_col)


#: SQL of the query over `documents` with 16 shards; the checksum is built from its polynomial.
ORACLE = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
x AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS bytes FROM documents),
y AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32 FROM x, t),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('17|' || doc_id || '|' || text_crc32), 1, 13))::BIGINT, doc_id) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM y),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source, doc_id) - 1 AS position, count(*) OVER () AS n FROM r),
q AS (SELECT *, (position * 16 // n)::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (position - (shard::BIGINT * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM q
"""
