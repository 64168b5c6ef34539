"""Metrics as grouped aggregates over long prediction tables (real_y, pred_y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.transforms import finite, num
from lodestone.operators.ranks import percentiles, prefix_sums, value_bins
from lodestone.shared import Scratch


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation from sums; null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def r2det(real: str, pred: str) -> Column:
    """1 - SSE / SST; null where the real values are constant."""
    error = F.sum((F.col(real) - F.col(pred)) * (F.col(real) - F.col(pred)))
    return num(1) - F.try_divide(error, F.var_pop(real) * F.count(real))


def regression_aggregates(real: str = "real_y", pred: str = "pred_y") -> dict[str, Column]:
    d = F.col(pred) - F.col(real)
    return {"n": F.count(F.lit(1)), "rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)), "pearson_r": correlation(real, pred), "r2": F.pow(correlation(real, pred), num(2)), "r2det": r2det(real, pred), "bias": F.avg(d)}


def finite_pairs(df: DataFrame, real: str = "real_y", pred: str = "pred_y") -> DataFrame:
    return df.where(finite(F.col(real)) & finite(F.col(pred)))


def regression(df: DataFrame, by: list[str], real: str = "real_y", pred: str = "pred_y") -> DataFrame:
    aggregates = regression_aggregates(real, pred)
    return finite_pairs(df, real, pred).groupBy(*by).agg(*[c.alias(k) for k, c in aggregates.items()])


def spearman(df: DataFrame, by: list[str], a: str, b: str, name: str = "spearman_rho") -> DataFrame:
    """n and the rank correlation of each group's rows that have finite values on both sides; others have no rank.

    Rows are counted by their pair of values and written once; ranks of each side come from that table.
    """
    both = df.where(finite(F.col(a)) & finite(F.col(b)))
    rows = Scratch(df.sparkSession).save(both.groupBy(*by, F.col(a).alias("_x"), F.col(b).alias("_y")).agg(F.count(F.lit(1)).alias("_w")))
    ranked = weighted_ranks(rows, rows, by, "_x", "_a")
    ranked = weighted_ranks(ranked, rows, by, "_y", "_b")
    mean = lambda c: F.sum(F.col("_w") * c) / F.sum("_w")
    x, y = F.col("_a"), F.col("_b")
    spread = F.sqrt((mean(x * x) - mean(x) * mean(x)) * (mean(y * y) - mean(y) * mean(y)))
    return ranked.groupBy(*by).agg(F.sum("_w").alias("n"), F.try_divide(mean(x * y) - mean(x) * mean(y), spread).alias(name))


def weighted_ranks(df: DataFrame, counted: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """The rows of df with the rank of a column's value among the counted rows, which stand for `_w` rows each; ties at their mean."""
    counts = counted.groupBy(*[F.col(c).alias(f"_key_{c}") for c in by], F.col(column).alias("_value")).agg(F.sum("_w").alias("_n"))
    ranked = prefix_sums(counts, [f"_key_{c}" for c in by], [F.col("_value")], {"_before": F.col("_n")}, value_bins(counted.withColumnRenamed(column, "_value"), "_value"))
    table = ranked.select(*[f"_key_{c}" for c in by], "_value", (F.col("_before") + (F.col("_n") + 1) / num(2)).alias(name))
    on = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by] + [F.col(column).eqNullSafe(F.col("_value"))]
    return df.join(table, on).drop("_value", *[f"_key_{c}" for c in by])


def rank_association(df: DataFrame, columns: list[str], name: str = "rho") -> DataFrame:
    """first, second, n, rho: each pair of columns over the rows that have finite values of both; a pair without any has no row.

    One pass: each row stands under the pairs it has values of, and equal values are counted before any is ranked.
    """
    value = lambda c: F.col(f"`{c}`").cast("double")
    pairs = [F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), value(x).alias("a"), value(y).alias("b")) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    return spearman(df.select(F.inline(F.array(*pairs))), ["first", "second"], "a", "b", name)


def calibration_line(real: str = "real_y", pred: str = "pred_y") -> dict[str, Column]:
    return {"slope": F.regr_slope(real, pred), "intercept": F.regr_intercept(real, pred), "calib_gap": F.pow(correlation(real, pred), num(2)) - r2det(real, pred)}


def confusion(real: Column, call: Column) -> dict[str, Column]:
    return {"tp": F.count_if(real & call), "fp": F.count_if(~real & call), "fn": F.count_if(real & ~call), "tn": F.count_if(~real & ~call)}


def _share(a: Column, b: Column) -> Column:
    """A ratio that is 0 over 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), num(0))


def triage(df: DataFrame, by: list[str], real: Column, call: Column) -> DataFrame:
    """Accuracy, PPV, NPV, F1 of both sides, and MCC (null where a side has one class)."""
    counts = df.withColumn("_r", real).withColumn("_c", call).groupBy(*by).agg(*[c.alias(k) for k, c in confusion(F.col("_r"), F.col("_c")).items()])
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    mcc = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    values = {"accuracy": _share(tp + tn, tp + tn + fp + fn), "ppv": _share(tp, tp + fp), "npv": _share(tn, tn + fn), "f1_pos": _share(num(2) * tp, num(2) * tp + fp + fn), "f1_neg": _share(num(2) * tn, num(2) * tn + fp + fn), "mcc": mcc}
    return counts.withColumns(values)


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def roc_auc(df: DataFrame, by: list[str], real: Column, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums of counts by distinct score; null with one class."""
    counts = Scratch(df.sparkSession).save(df.withColumn("_y", real.cast("int")).groupBy(*by, score).agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_n")))
    ranked = prefix_sums(counts, by, [F.col(score)], {"_before": F.col("_n")}, value_bins(counts, score)).withColumn("_r", F.col("_before") + (F.col("_n") + 1) / num(2))
    out = ranked.groupBy(*by).agg(F.sum("_p").alias("pos"), (F.sum("_n") - F.sum("_p")).alias("neg"), F.sum(F.col("_p") * F.col("_r")).alias("_s"))
    p, n = F.col("pos").cast("double"), F.col("neg").cast("double")
    return out.withColumn("roc_auc", F.try_divide(F.col("_s") - p * (p + 1) / 2, p * n)).drop("_s")


def average_precision(df: DataFrame, by: list[str], real: Column, score: str) -> DataFrame:
    """Area under the precision-recall curve as a sum over score steps, from counts by distinct score."""
    steps = Scratch(df.sparkSession).save(df.withColumn("_y", real.cast("int")).groupBy(*by, score).agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_n")))
    steps = prefix_sums(steps, by, [F.desc(score)], {"_bp": F.col("_p"), "_bn": F.col("_n")}, -value_bins(steps, score))
    steps = steps.withColumn("_precision", (F.col("_bp") + F.col("_p")) / (F.col("_bn") + F.col("_n")))
    return steps.groupBy(*by).agg(F.try_divide(F.sum(F.col("_p") * F.col("_precision")), F.sum("_p").cast("double")).alias("pr_auc"))


def balanced_accuracy(df: DataFrame, by: list[str], real: Column, call: Column) -> DataFrame:
    """The mean of both classes' recall; null where a class has no row."""
    counts = df.withColumn("_r", real).withColumn("_c", call).groupBy(*by).agg(*[c.alias(k) for k, c in confusion(F.col("_r"), F.col("_c")).items()])
    recall = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return counts.select(*by, ((recall("tp", "fn") + recall("tn", "fp")) / num(2)).alias("balanced_accuracy"))


def ppv_curve(df: DataFrame, real: Column, score: str, points: int = 30) -> DataFrame:
    """(proba, n, ppv) at evenly spaced thresholds: rows are counted by the highest threshold they reach, then summed."""
    step = F.floor(F.col(score) * F.lit(float(points))).cast("bigint")
    bins = df.withColumn("_y", real.cast("int")).withColumn("_k", F.least(step, F.lit(points - 1))).groupBy("_k").agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(F.desc("_k"))
    sums = bins.select("_k", F.sum("_p").over(w).alias("p"), F.sum("_n").over(w).alias("n"))
    return sums.select((F.col("_k") / num(points)).alias("proba"), F.col("n").cast("bigint").alias("n"), (F.col("p") / F.col("n")).alias("ppv"))


def fixed_bins(conf: Column, width: int = 5) -> Column:
    """The right-closed bin 1..width of a confidence above 0, else null."""
    return F.when((conf > 0) & (conf <= 1), F.ceil(conf * width).cast("bigint"))


def quantile_bins(df: DataFrame, column: str, by: list[str], n: int = 5, name: str = "bin") -> DataFrame:
    """Bins between distinct quantiles, as many as there are; the lowest value belongs to the first."""
    edges = percentiles(df, by, column, [i / n for i in range(n + 1)], "_edges").withColumn("_edges", F.array_distinct("_edges"))
    edges = edges.select(*[F.col(c).alias(f"_e_{c}") for c in by], "_edges")
    place = F.size(F.filter(F.slice("_edges", 2, n + 1), lambda e: e < F.col(column))) + 1
    if by:
        joined = df.join(edges, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in by])
    else:
        joined = df.withColumn("_edges", F.array(*[num(x) for x in (edges.first() or [[]])[0]]).cast("array<double>"))
    return joined.withColumn(name, place.cast("bigint")).drop("_edges", *[f"_e_{c}" for c in by])


def half_split(df: DataFrame, by: list[str], conf: str, residual: str, split: float = 0.5) -> DataFrame:
    return df.withColumn("confident", F.col(conf) >= num(split)).groupBy(*by, "confident").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(residual) * F.col(residual))).alias("rmse"))


#: Columns of the metrics table of which the smallest value is the best.
LOWER_IS_BETTER = ("rmse", "mae")


def block_flags(df: DataFrame, block: str, columns: list[str], lower: tuple[str, ...] = LOWER_IS_BETTER) -> DataFrame:
    """For each metric whether a row has the block's best or worst value; where all are equal none is the worst, and a missing value is neither."""
    w, out = Window.partitionBy(block), {}
    for c in columns:
        best, worst = (F.min, F.max) if c in lower else (F.max, F.min)
        out[f"{c}_best"] = F.coalesce(F.col(c) == best(c).over(w), F.lit(False))
        out[f"{c}_worst"] = F.coalesce((F.col(c) == worst(c).over(w)) & (worst(c).over(w) != best(c).over(w)), F.lit(False))
    return df.withColumns(out)


def arm_block(arm: Column) -> Column:
    """The metrics table's block of an arm: 2 for a temporal one, whose name holds 'temp', else 1."""
    return F.when(F.lower(arm).contains("temp"), 2).otherwise(1)


def metrics_table(predictions: DataFrame, by: list[str], cutoff: Column, sign: str = ">=") -> DataFrame:
    """A row an arm: regression metrics, triage at the cutoff (in modelling space), block, and place by block and falling r2det.

    predictions: rows of `by`, arm, real_y, pred_y; a sign '>=' or '>' makes high values the favourable ones.
    """
    compare = {">=": lambda c: c >= cutoff, ">": lambda c: c > cutoff, "<=": lambda c: c <= cutoff, "<": lambda c: c < cutoff}[sign]
    keys = [*by, "arm"]
    numbers = regression(predictions, keys)
    calls = triage(finite_pairs(predictions), keys, compare(F.col("real_y")), compare(F.col("pred_y")))
    out = numbers.join(calls, keys).withColumn("block", arm_block(F.col("arm")))
    order = Window.partitionBy(*by).orderBy("block", F.col("r2det").desc_nulls_last(), "arm")  # a row an arm
    return out.withColumn("place", F.row_number().over(order).cast("bigint"))


def winners(df: DataFrame, by: list[str], metric: str, order: str) -> DataFrame:
    """The best row a group; ties go to the smaller order."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), F.col(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
