"""Unhashed bit matrices: which bits are kept, which equal columns they stand for, and the rows as sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranks import hash_bin, numbered
from lodestone.shared import Scratch


def equal_columns(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """Of distinct rows bit, compound: each bit with n, and the smallest bit that is set on exactly the same compounds.

    Bits of equal number and equal sums of hashes are held against the smallest of them, compound by compound; those that
    turn out to differ are tried among themselves again, so hashes only say what to compare.
    """
    marks = postings.groupBy("bit").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("compound")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "compound")).alias("y"))
    left = scratch.save(marks)
    done = None
    while True:
        tried = left.withColumn("first", F.min("bit").over(Window.partitionBy("n", "x", "y")))
        others = tried.where("bit <> first").select("bit", "n", "first")
        mine = others.join(postings, "bit").select("bit", "n", "first", "compound")
        theirs = postings.join(others.select("first").distinct(), F.col("bit") == F.col("first"), "left_semi").select(F.col("bit").alias("_b"), F.col("compound").alias("_c"))
        same = mine.join(theirs, F.expr("first = _b and compound = _c")).groupBy("bit", "n", "first").agg(F.count(F.lit(1)).alias("k")).where("k = n")
        found = scratch.save(same.select("bit", "n", F.col("first").alias("duplicate_of")).unionByName(tried.where("bit = first").select("bit", "n", F.col("first").alias("duplicate_of"))))
        done = found if done is None else done.unionByName(found)
        rest = scratch.save(left.join(found.select("bit"), "bit", "left_anti"))
        if rest.isEmpty():
            return done
        left = rest


def keep_bits(bits: DataFrame, least: int) -> DataFrame:
    """Of rows (compound, bit): the bits that at least so many compounds have: n_compounds, whether it is kept, and which bit it equals."""
    scratch = Scratch(bits.sparkSession)
    rows = bits.where("bit is not null and compound is not null").select("compound", "bit").distinct()
    often = rows.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("bit")
    postings = scratch.save(rows.join(often, "bit"))
    found = equal_columns(postings, scratch)
    return found.select("bit", F.col("n").alias("n_compounds"), (F.col("bit") == F.col("duplicate_of")).alias("kept"), "duplicate_of")


def vocabulary(kept: DataFrame) -> DataFrame:
    """bit, column: gapless numbers from 0 of the kept bits, in the order of a hash (parts of even size), then of the bits."""
    named = kept.where("kept").select("bit", F.md5(F.col("bit").cast("string").cast("binary")).alias("_h"))
    return numbered(Scratch(kept.sparkSession).save(named), [F.col("_h"), F.col("bit")], "column", bins=hash_bin(F.col("_h"))).select("bit", "column")


def bit_matrix(bits: DataFrame, compounds: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(matrix, vocabulary): a row for each compound with the sorted column numbers that are set; none set is an empty row.

    bits: compound, bit; compounds: every compound once, those without a bit (such as unparsable ones) too.
    """
    words = Scratch(bits.sparkSession).save(vocabulary(keep_bits(bits, least)))
    held = bits.join(words, "bit").groupBy(F.col("compound").alias("_c")).agg(F.array_sort(F.collect_set("column")).alias("indices"))
    rows = compounds.select("compound").join(held, F.col("compound") == F.col("_c"), "left").drop("_c")
    return rows.withColumn("indices", F.coalesce("indices", F.array().cast("array<bigint>"))), words

