"""Confidence calibration: parameters as aggregates, leave-one-fold-out by subtracting sums, confidences as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.transforms import num
from lodestone.operators.ranks import prefix_sums

_SUMS = {"n": lambda s, r: F.count(F.lit(1)).cast("double"), "ss": lambda s, r: F.sum(s), "sr": lambda s, r: F.sum(r), "sss": lambda s, r: F.sum(s * s), "ssr": lambda s, r: F.sum(s * r), "srr": lambda s, r: F.sum(r * r)}


def line(n: Column, ss: Column, sr: Column, sss: Column, ssr: Column) -> tuple[Column, Column]:
    """Intercept and slope of |residual| on std from sums; a constant std gives slope 0."""
    b = F.coalesce(F.try_divide(n * ssr - ss * sr, n * sss - ss * ss), num(0))
    return F.try_divide(sr - b * ss, n), b


def parameters(df: DataFrame, by: list[str], real: str = "real_y", pred: str = "pred_y", std: str = "uq_std") -> DataFrame:
    """rmse_cv, label_std, recal_a, recal_b of each group."""
    r, s = F.abs(F.col(real) - F.col(pred)), F.col(std)
    sums = df.groupBy(*by).agg(*[f(s, r).alias(k) for k, f in _SUMS.items()], F.stddev_samp(real).alias("label_std"))
    a, b = line(*[F.col(k) for k in ("n", "ss", "sr", "sss", "ssr")])
    return sums.select(*by, F.col("n").cast("bigint").alias("n"), F.sqrt(F.col("srr") / F.col("n")).alias("rmse_cv"), "label_std", a.alias("recal_a"), b.alias("recal_b"))


def parameters_without_fold(df: DataFrame, by: list[str], fold: str = "fold", real: str = "real_y", pred: str = "pred_y", std: str = "uq_std") -> DataFrame:
    """For each fold the parameters of the group's other folds: sums by fold, subtracted from the group's; groups of one fold have none."""
    r, s, y = F.abs(F.col(real) - F.col(pred)), F.col(std), F.col(real)
    own = df.groupBy(*by, fold).agg(*[f(s, r).alias(k) for k, f in _SUMS.items()], F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
    names = [*_SUMS, "sy", "syy"]
    total = own.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[F.sum(k).alias(f"_t_{k}") for k in names], F.count(F.lit(1)).alias("_folds"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = (own.join(total, on) if by else own.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")).where("_folds > 1")
    rest = joined.select(*by, fold, *[(F.col(f"_t_{k}") - F.col(k)).alias(k) for k in names])
    a, b = line(*[F.col(k) for k in ("n", "ss", "sr", "sss", "ssr")])
    n = F.col("n")
    spread = F.sqrt(F.greatest(F.try_divide(F.col("syy") - F.col("sy") * F.col("sy") / n, n - 1), num(0)))
    return rest.select(*by, fold, F.col("n").cast("bigint").alias("n"), F.sqrt(F.col("srr") / n).alias("rmse_cv"), spread.alias("label_std"), a.alias("recal_a"), b.alias("recal_b"))


def confidence_columns(std: str = "uq_std", rmse: str = "rmse_cv", label_std: str = "label_std", a: str = "recal_a", b: str = "recal_b") -> dict[str, Column]:
    s = F.col(std)
    inside = lambda c: F.least(F.greatest(c, num(0)), num(1))
    return {
        "conf_labelstd": inside(F.exp(-F.try_divide(s, F.col(label_std)))),
        "conf_rmse": inside(F.exp(-F.try_divide(s, F.col(rmse)))),
        "conf_recal": inside(F.exp(-F.try_divide(F.greatest(F.col(a) + F.col(b) * s, num(0)), F.col(rmse)))),
    }


def conformal(df: DataFrame, by: list[str], real: str = "real_y", pred: str = "pred_y", std: str = "uq_std", rmse: str = "rmse_cv") -> DataFrame:
    """The rows with conf_conformal: the share of the group's |residual| / std at most rmse / std of the row.

    Scores and thresholds are counted by distinct value and merged in one order by group; counts come from running sums.
    """
    rows = df.withColumn("_t", F.try_divide(F.col(rmse), F.col(std))).withColumn("_s", F.try_divide(F.abs(F.col(real) - F.col(pred)), F.col(std)))
    keys = [F.col(c).alias(f"_g_{c}") for c in by]
    names = [f"_g_{c}" for c in by]
    scores = rows.where("_s is not null").groupBy(*keys, F.col("_s").alias("_v"), F.lit(0).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    limits = rows.where("_t is not null").groupBy(*keys, F.col("_t").alias("_v"), F.lit(1).alias("_k")).agg(F.lit(0).cast("bigint").alias("_n"))
    merged = prefix_sums(scores.unionByName(limits), names, [F.col("_v"), F.col("_k")], {"_c": F.col("_n")}).where("_k = 1").drop("_k", "_n")
    if by:
        totals = scores.groupBy(*[F.col(c).alias(f"_o{c}") for c in names]).agg(F.sum("_n").alias("_all"))
        merged = merged.join(totals, [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in names]).drop(*[f"_o{c}" for c in names])
    else:
        merged = merged.withColumn("_all", F.lit(scores.agg(F.sum("_n")).first()[0]).cast("bigint"))
    out = rows.join(merged, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)] + [F.col("_t") == F.col("_v")], "left")
    return out.withColumn("conf_conformal", F.try_divide(F.col("_c").cast("double"), F.col("_all").cast("double"))).drop("_t", "_s", "_v", "_c", "_all", *names)


LEAST_ROWS = 30


def arm_calibration(predictions: DataFrame, by: list[str], cv: str = "augmented_cv", cv_arms: tuple[str, ...] = ("internal_cv", "augmented_cv"), least: int = LEAST_ROWS) -> DataFrame:
    """Parameters for each group, arm and fold (null for single-block arms), with `n` rows behind them and which rows those are.

    Cross-validated arms: each fold by the other folds, by the pooled `cv` arm where there is one fold. Other arms: the
    `cv` arm without the compounds that this arm tests, or pooled where fewer than `least` rows are left.
    """
    base = predictions.where(F.col("arm") == cv)
    names = ["n", "rmse_cv", "label_std", "recal_a", "recal_b"]
    pooled = parameters(base, by)
    own = parameters_without_fold(predictions.where(F.col("arm").isin(*cv_arms)), [*by, "arm"]).withColumn("rows", F.lit("other folds"))
    folds = predictions.where(F.col("arm").isin(*cv_arms)).select(*by, "arm", "fold").distinct()
    lone = folds.join(own.select(*by, "arm", "fold"), [*by, "arm", "fold"], "left_anti").join(pooled, by, "left").withColumn("rows", F.lit("pooled"))
    tested = predictions.where(~F.col("arm").isin(*cv_arms)).select(*by, "arm", F.col("compound").alias("_tested")).distinct()
    arms = tested.select(*by, "arm").distinct()
    each = base.join(arms.withColumnRenamed("arm", "_arm"), by)
    match = [each[c] == F.col(f"_t_{c}") for c in by] + [F.col("_arm") == F.col("_in"), F.col("compound") == F.col("_tested")]
    rest = each.join(tested.select(*[F.col(c).alias(f"_t_{c}") for c in by], F.col("arm").alias("_in"), "_tested"), match, "left_anti")
    rest = parameters(rest.drop("arm").withColumnRenamed("_arm", "arm"), [*by, "arm"])
    single = arms.join(rest, [*by, "arm"], "left").withColumn("_few", F.coalesce(F.col("n"), F.lit(0)) < least)
    single = single.join(pooled.select(*by, *[F.col(c).alias(f"_p_{c}") for c in names]), by, "left")
    single = single.withColumns({c: F.when(F.col("_few"), F.col(f"_p_{c}")).otherwise(F.col(c)) for c in names})
    single = single.withColumn("rows", F.when(F.col("_few"), "pooled").otherwise("without tested")).withColumn("fold", F.lit(None).cast(predictions.schema["fold"].dataType))
    columns = [*by, "arm", "fold", *names, "rows"]
    return own.select(*columns).unionByName(lone.select(*columns)).unionByName(single.select(*columns))


def with_arm_confidence(predictions: DataFrame, by: list[str], std: str = "uq_std", **options) -> DataFrame:
    """The rows with the confidences of their arm's calibration, and which rows that stands on."""
    table = arm_calibration(predictions, by, **options)
    table = table.select(*[F.col(c).alias(f"_c_{c}") for c in (*by, "arm", "fold")], *[c for c in table.columns if c not in (*by, "arm", "fold", "n")])
    on = [F.col(c) == F.col(f"_c_{c}") for c in (*by, "arm")] + [F.col("_c_fold").isNull() | (F.col("fold") == F.col("_c_fold"))]
    return predictions.join(table, on, "left").withColumns(confidence_columns(std)).withColumnRenamed("rows", "calibrated_on").drop(*[f"_c_{c}" for c in (*by, "arm", "fold")])


def calibrated(df: DataFrame, by: list[str], fold: str | None = None, **names: str) -> DataFrame:
    """The rows with the confidences of their group, or (with a fold column) of the group's other folds."""
    keys = [*by, fold] if fold else by
    table = parameters_without_fold(df, by, fold, **names) if fold else parameters(df, by, **names)
    table = table.drop("n").select(*[F.col(c).alias(f"_{c}") for c in keys], *[c for c in table.columns if c not in (*keys, "n")])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return df.join(table, on).withColumns(confidence_columns(names.get("std", "uq_std"))).drop(*[f"_{c}" for c in keys])
