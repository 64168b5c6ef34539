"""The registry of named queries: each has a plan over (spark, sf_dir) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def big(c: Column) -> Column:
    return c.cast("bigint")


#: Truth and prediction of each line: endpoint by return flag, arm by line status, five folds by order.
PREDICTIONS_SQL = """p AS (SELECT l_orderkey * 8 + l_linenumber AS compound, l_returnflag AS endpoint, l_linestatus AS arm, l_orderkey % 5 + 1 AS fold,
  p_type, p_name, l_extendedprice AS real_raw, l_quantity * p_retailprice * (1 - l_discount) AS pred_raw,
  log10(l_extendedprice) AS real_y, log10(l_quantity * p_retailprice * (1 - l_discount)) AS pred_y, 0.05::DOUBLE + l_discount + l_tax AS uq_std
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.functions.transforms import num

    pred = F.col("l_quantity") * F.col("p_retailprice") * (num(1) - F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("compound"), F.col("l_returnflag").alias("endpoint"), F.col("l_linestatus").alias("arm"), (F.col("l_orderkey") % 5 + 1).alias("fold"), "p_type", "p_name",
        F.col("l_extendedprice").alias("real_raw"), pred.alias("pred_raw"), F.log10("l_extendedprice").alias("real_y"), F.log10(pred).alias("pred_y"), (num(0.05) + F.col("l_discount") + F.col("l_tax")).alias("uq_std"),
    )


#: Documents as compounds: internal if labelled, keys by text.
COMPOUNDS_SQL = """c AS (SELECT d.doc_id, d.source AS origin, d.text, d.lang, d.n_chars, CASE WHEN l.doc_id IS NULL THEN 'EXP' ELSE 'internal' END AS source,
  l.quality, l.toxic, md5(lower(trim(d.text))) AS _ik, substr(md5(regexp_replace(lower(d.text), '[^a-z]', '', 'g')), 1, 14) AS _sk,
  CASE WHEN d.n_chars % 3 = 0 THEN NULL ELSE log10(d.n_chars::DOUBLE) END AS label
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.functions.keys import text_key

    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    joined = table(spark, sf_dir, "documents").join(labels.withColumn("_known", F.lit(1)), "doc_id", "left")
    return joined.select(
        "doc_id", F.col("source").alias("origin"), "text", "lang", "n_chars", F.when(F.col("_known").isNull(), "EXP").otherwise("internal").alias("source"), "quality", "toxic",
        text_key(F.col("text")).alias("_ik"), text_key(F.col("text"), "skeleton").alias("_sk"), F.when(F.col("n_chars") % 3 != 0, F.log10(F.col("n_chars").cast("double"))).alias("label"),
    )
