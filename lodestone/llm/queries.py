"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import counts, exact, graphs, licences, lines, media, mixing, near, packing, phrases, sharding, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_file(name: str) -> str:
    """A vocabulary file that every machine has."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(_table(spark, sf_dir, "documents"))
    seen = media.read(stored, ["doc_id", "n_bytes"])
    feature = F.concat_ws(";", F.concat(F.lit("frames="), "frames"), F.concat(F.lit("ms="), F.expr("samples * 1000 div sample_rate")), F.concat_ws("", F.lit("vbr="), "vbr", F.lit(":"), "vbr_frames"), F.concat(F.lit("crc="), F.expr("crc_checked - crc_bad"), F.lit("/"), "crc_checked"), F.concat(F.lit("lost="), "sync_losses"), F.concat_ws("", F.lit("seek="), F.md5(F.concat_ws(",", F.col("seek").cast("array<string>")))))
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "samples", "sample_rate", "seek")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(_table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_table(spark, sf_dir, "documents"), public_file("piece_bpe_32k.model"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("_position").alias("position"), F.col("_place").alias("place"), F.col("_block").alias("block"), F.col("_release").alias("release"), F.col("_due").alias("due"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpeg_media": op1,
    "op2_near_duplicates": op2,
    "op3_power_of_two_packing": op3,
    "op4_toxicity": op4,
    "op5_token_counts": op5,
    "op6_stratified_sharding": op6,
    "op7_pfair_mixing": op7,
    "op8_license_scan": op8,
    "op9_embedding_graphs": op9,
    "op10_line_dedup": op10,
    "op11_phrase_mining": op11,
    "op12_embedding_whitening": op12,
    "op13_exact_dedup": op13,
}

ORACLE_SQL: dict[str, str] = {"op6_stratified_sharding": sharding.ORACLE, "op10_line_dedup": lines.ORACLE, "op11_phrase_mining": phrases.ORACLE, "op13_exact_dedup": exact.ORACLE}
