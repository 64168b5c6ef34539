"""Operator 13: exact dedup by deterministic block naming.

A text is stripped of ASCII white space and cut into blocks of BLOCK bytes (the last one shorter; an empty text has one
empty block). Distinct blocks are sorted and get their place in that order, a whole number, as name; then every two
adjacent names (a last odd one stands alone, beside -1) are named in the same way, level by level, until each document
has one name. Names are places among distinct values, so two documents of equal level and name have equal texts, and
equal texts get equal names: no hash decides. Blocks travel once: documents carry two 64-bit hashes of each block,
and where blocks meet, the smallest and the largest block of each pair of hashes are compared. Should they ever
differ, the hashes are drawn again with other seeds, so that what names blocks is proven to tell them apart. Blocks are
sorted by hashes (even bins, whatever the texts), pairs by a hash and then by themselves.

A class's row with the most code points in its original text stays, then the smallest id (null ids come last); of rows
that repeat an id and length one stays. A null text counts as empty, and empty texts (white space alone) are one class.
A long text is one row with many blocks, each level halves them. An empty table gives no rows; only the id and the text
are read, so other columns may have any names. A group of copies is counted before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import bins_for, ranked
from lodestone.shared import Scratch

BLOCK = 1024
#: Fixed value: ASCII white space, which does not count.
BLANKS = " \t\n\x0b\x0c\r"


def stripped(text: Column) -> Column:
    """The UTF-8 bytes of a text without white space; those of null are empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary")


def _cut(v: Column, block: int, of: Column) -> Column:
    """An array of `of(a block)` for the blocks of a binary value."""
    last = F.greatest(F.lit(0), F.floor((F.octet_length(v) - 1) / block)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: of(F.substring(v, (i * block + 1).cast("int"), F.lit(block))))


def _hashes(bits: int, seed: int):
    """Two hashes of a block, of so many bits each."""
    short = lambda h: h if bits >= 64 else F.shiftrightunsigned(h, 64 - bits)
    return lambda b: F.struct(short(F.xxhash64(F.lit(2 * seed), b)).alias("g"), short(F.xxhash64(F.lit(2 * seed + 1), b)).alias("h"))


def named(kinds: DataFrame, order: list[str], most: int, bits: int = 64) -> DataFrame:
    """Distinct rows (`most` at most) with `name`, their gapless place in an order that begins with an even hash of so many bits."""
    bins = bins_for(most, 16).bit_length() - 1
    return ranked(kinds, [], order, F.shiftright(F.col(order[0]), max(0, bits - bins)), "name")


def block_names(df: DataFrame, scratch: Scratch, block: int, bits: int) -> DataFrame:
    """The rows id, text as saved rows r, id, n_points, sha, blocks, with the named blocks of all (g, h, name)."""
    for seed in range(64):
        pair = _hashes(min(64, bits * 8**seed), seed)
        whole = lambda v: F.struct(F.sha2(v, 256).alias("sha"), F.octet_length(v).cast("bigint").alias("n_bytes"), _cut(v, block, pair).alias("blocks"))  # noqa: B023, E731
        docs = df.select(F.monotonically_increasing_id().alias("r"), "id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_points"), F.inline(F.transform(F.array(stripped(F.col("text"))), whole)))
        docs = scratch.save(docs)
        pieces = df.select(F.explode(F.transform(F.array(stripped(F.col("text"))), lambda v: _cut(v, block, lambda b: b))[0]).alias("block"))
        kinds = pieces.select(pair(F.col("block")).alias("k"), "block").groupBy("k.g", "k.h").agg(F.min("block").alias("low"), F.max("block").alias("high"))
        kinds = scratch.save(kinds.select("g", "h", (F.col("low") != F.col("high")).alias("clash")))
        if kinds.where("clash").isEmpty():
            return docs, named(kinds.drop("clash"), ["g", "h"], kinds.count(), min(64, bits * 8**seed))
        scratch.drop(docs, kinds)
    raise RuntimeError("no seeds told the blocks apart")


def identities(docs: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows r, level, name: each document's one name, after as many levels as halve its blocks to one."""
    rows = docs.select("r", F.size("blocks").alias("m"), F.posexplode("blocks").alias("pos", "b")).select("r", "m", "pos", "b.g", "b.h")
    rows = scratch.save(rows.join(names, ["g", "h"]).select("r", "m", "pos", "name"))
    found, level = rows.where("m = 1").select("r", F.lit(0).alias("level"), "name"), 0
    blocks, most = rows.agg(F.count(F.lit(1)), F.max("m")).first()
    while (most or 1) > 1:
        level, blocks, most = level + 1, (blocks + 1) // 2 + 1, (most + 1) // 2
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = rows.where("m > 1").groupBy("r", F.expr("cast(pos div 2 as int)").alias("pos")).agg(F.expr("cast((max(m) + 1) div 2 as int)").alias("m"), side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        kinds = named(pairs.select(F.xxhash64("a", "b").alias("x"), "a", "b").distinct(), ["x", "a", "b"], blocks)
        rows = scratch.save(pairs.join(kinds.drop("x"), ["a", "b"]).select("r", "m", "pos", "name"))
        found = found.union(rows.where("m = 1").select("r", F.lit(level).alias("level"), "name"))
    return found


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """id, keep_id (of the row that stays), group_size, kept, text_sha256, n_bytes (of the stripped text), level, name.

    bits: of each of the first two hashes; fewer only make a second draw likelier.
    """
    scratch = Scratch(df.sparkSession)
    docs, names = block_names(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), scratch, block, bits)
    found = docs.drop("blocks").join(identities(docs, names, scratch), "r")
    found = scratch.save(found)
    scratch.keep_only(found)
    first = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("none"), "id", "r"))
    classes = found.groupBy(F.col("level").alias("_level"), F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("group_size"), first.alias("one"))
    out = found.join(classes, F.expr("level = _level and name = _name"))
    return out.select(F.col("id").alias(id_col), F.col("one.id").alias("keep_id"), "group_size", (F.col("r") == F.col("one.r")).alias("kept"), F.col("sha").alias("text_sha256"), "n_bytes", "level", "name")


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, row_number() OVER w = 1 AS kept, sha256(s) AS text_sha256
FROM t WINDOW w AS (PARTITION BY s ORDER BY points DESC, doc_id)
"""
