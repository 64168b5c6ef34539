"""The corpus pipeline, part of subpackage llm: toxicity, line dedup, MinHash near-dedup, mixing, packing.

Every stage takes any columns besides those of documents and keeps them. A null or empty text is no toxic one, has no
lines to lose, is like no other text, and is mixed and packed (one closing id). Repeated rows go the same way: toxicity
and mixing keep each, line dedup treats rows of one id and text as one document, near dedup keeps all rows of a
kept id. Rows with a null id are kept by all stages. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import lines, mixing, near, packing, toxicity
from lodestone.llm.queries import public_file
from lodestone.shared import Scratch, free_names
from lodestone.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not call toxic."""
    ship(spark)
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere before; those of which no word is left go."""
    ship(spark)
    (removed,) = free_names(docs.columns, "n_removed")
    out = lines.dedup_lines(docs).where((F.col(removed) == 0) | F.col("text").rlike("[^\\s]"))
    length = F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the smallest id) of each group of near duplicates."""
    ship(spark)
    (name,) = free_names(docs.columns, "_gone")
    gone = near.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in an order in which every prefix holds the sources at their target weights."""
    ship(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents: sequences of power-of-two lengths, numbered in the mixture's order.

    A scan of files keeps no order, so the order is made again here from the documents' own columns.
    """
    ship(spark)
    return packing.pack(mixing.mixed(docs), public_file("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: The classifier is fitted outside SQL; tests/llm/test_pipeline.py holds all stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again; a stage's table goes when the next one's is written."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
            scratch.keep_only(docs)
    return docs
