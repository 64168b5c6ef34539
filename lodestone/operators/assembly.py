"""From raw internal tables and public sources to modelling frames and training pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Endpoint
from lodestone.functions.transforms import clip_upper, finite, finite_or_null, forward, forward_value, matches
from lodestone.operators.relational import drop_twins, fill_from, join_auxiliary, prefer_source

LONG = "compound string, smiles string, label double, source string, origin string, raw double, endpoint string"


def internal_block(raw: DataFrame, e: Endpoint, id_col: str = "name", smiles_col: str = "smiles") -> DataFrame:
    """An endpoint's internal rows, filtered, in modelling space (labels that are not finite stay null)."""
    rows = raw.where(matches(F.col(f"`{e.filter_column}`"), e.filter_pattern)) if e.filter_column else raw
    rows = rows.where(F.col(f"`{e.column}`").isNotNull())
    value = F.col(f"`{e.column}`").cast("double")
    return rows.select(F.col(id_col).alias("compound"), F.col(smiles_col).alias("smiles"), forward(e.transform, value).alias("label"), F.lit("internal").alias("source"), F.lit("internal").alias("origin"), value.alias("raw"), F.lit(e.name).alias("endpoint"))


def public_block(source: DataFrame, e: Endpoint) -> DataFrame:
    """A public source's four contract columns (values in modelling space) as rows of the long frame."""
    return source.select("compound", "smiles", F.col("value").alias("label"), F.lit("EXP").alias("source"), "origin", F.lit(None).cast("double").alias("raw"), F.lit(e.name).alias("endpoint"))


def long_frame(spark: SparkSession, raw: DataFrame, endpoints: list[Endpoint], public: dict[str, list[DataFrame]] | None = None, **names: str) -> DataFrame:
    """All endpoints' rows, one table with an endpoint column."""
    out = spark.createDataFrame([], LONG)
    for e in endpoints:
        out = out.unionByName(internal_block(raw, e, **names))
        for p in (public or {}).get(e.name, []):
            out = out.unionByName(public_block(p, e))
    return out


def modelling_frame(long: DataFrame, features: DataFrame, e: Endpoint, feature_columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """Capped, joined to features, complete, finite, one row a structure (internal first)."""
    rows = long.where(F.col("endpoint") == e.name)
    if e.cap is not None:
        rows = rows.withColumn("label", clip_upper(F.col("label"), forward_value(e.transform, e.cap)))
    rows = rows.join(features.select("compound", *feature_columns), "compound").where(finite(F.col("label")))
    rows = rows.na.drop(subset=feature_columns)
    return prefer_source(rows, ["smiles"], F.col("source"), "internal", order or [F.col("compound")])


def training_pools(wide: DataFrame, tasks: list[str], target: str, aux: DataFrame | None = None, aux_columns: list[str] | None = None, proxy: tuple[str, str] | None = None, level: str = "exact", key: str = "_ik") -> tuple[DataFrame, DataFrame]:
    """(pretraining pool of public rows without internal twins, fine-tuning pool of internal rows with the target).

    Labels that are not finite become null. Auxiliary tasks come by structure and are blank on internal rows; a proxy
    (task, auxiliary column) fills a public row's missing task. Raises if no public row has the target.
    """
    order = [F.col("smiles")]
    columns = list(aux_columns or [])
    rows = wide.withColumns({t: finite_or_null(F.col(t)) for t in tasks})
    if proxy:
        rows = fill_from(rows, aux, "smiles", proxy[0], proxy[1], F.col("source") != "internal", order)
    if aux is not None and columns:
        rows = join_auxiliary(rows, aux, "smiles", columns, F.col("source") == "internal", order)
    internal, public = rows.where("source = 'internal'"), rows.where("source <> 'internal'")
    public = drop_twins(public, internal, key, level).where(F.coalesce(*[F.col(c) for c in tasks + columns]).isNotNull())
    if not public.where(F.col(target).isNotNull()).limit(1).count():
        raise ValueError(f"no public row has {target}")
    return public, internal.where(F.col(target).isNotNull())


def binary_frames(internal: DataFrame, public: DataFrame, cutoff: float, label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(internal, public, both) with class = label at or above the cutoff; missing labels count as below."""
    from lodestone.functions.transforms import binarise

    one = lambda df: df.dropDuplicates(["compound"]).withColumn("class", binarise(F.col(label), cutoff))
    a, b = one(internal), one(public)
    return a, b, a.unionByName(b, allowMissingColumns=True)
