"""Queries of metrics, calibration, splits and similarity joins; the flagship round-trip score."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import Endpoint
from lodestone.functions import transforms as t
from lodestone.operators import bits as bt
from lodestone.operators import calibration as cal
from lodestone.operators import gram
from lodestone.operators import grouping as gp
from lodestone.operators import metrics as m
from lodestone.operators import nearshell as ns
from lodestone.operators import neighbours as nb
from lodestone.operators import pivots as pv
from lodestone.operators import relational as rel
from lodestone.operators import setjoin as sj
from lodestone.operators import splits as sp
from lodestone.plans.catalog import COMPOUNDS_SQL, PREDICTIONS_SQL, big, compounds, predictions, query, r6, rounded, table

P = f"WITH {PREDICTIONS_SQL}"
C = f"WITH {COMPOUNDS_SQL}"
CORR = "covar_pop(real_y, pred_y) / nullif(stddev_pop(real_y) * stddev_pop(pred_y), 0)"
R2DET = "1 - sum((real_y - pred_y) ** 2) / nullif(var_pop(real_y) * count(*), 0)"
REG = f"count(*) AS n, round(sqrt(avg((pred_y - real_y) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(pred_y - real_y)), 6) + 0.0 AS mae, round({CORR}, 6) + 0.0 AS pearson_r, round(({CORR}) ** 2, 6) + 0.0 AS r2, round({R2DET}, 6) + 0.0 AS r2det, round(avg(pred_y - real_y), 6) + 0.0 AS bias"
REG_COLUMNS = ("rmse", "mae", "pearson_r", "r2", "r2det", "bias")
TRIAGE = """round((tp + tn) / (tp + tn + fp + fn), 6) + 0.0 AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS ppv, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) + 0.0 AS npv,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1_pos, round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) + 0.0 AS f1_neg, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) + 0.0 AS mcc"""
COUNTS = "count(*) FILTER (r AND c)::DOUBLE AS tp, count(*) FILTER (NOT r AND c)::DOUBLE AS fp, count(*) FILTER (r AND NOT c)::DOUBLE AS fn, count(*) FILTER (NOT r AND NOT c)::DOUBLE AS tn"
TRIAGE_COLUMNS = ("accuracy", "ppv", "npv", "f1_pos", "f1_neg", "mcc")

#: The round trip's endpoints over the line table: cap, filter, transform and cutoff by return flag.
ROUND_TRIP = (Endpoint("A", "l_extendedprice", "log10", filter_column="p_type", filter_pattern="SMALL|ECONOMY", cap=80000.0, cutoff=30000.0, sign=">="), Endpoint("N", "l_extendedprice", "log10", cap=60000.0, cutoff=20000.0, sign="<"), Endpoint("R", "l_extendedprice", "log10", cutoff=40000.0, sign=">="))


@query("round_trip_score", f"""{P}, x AS (SELECT endpoint, arm, log10(CASE endpoint WHEN 'A' THEN least(real_raw, 80000) WHEN 'N' THEN least(real_raw, 60000) ELSE real_raw END) AS real_y, pred_y,
  CASE endpoint WHEN 'A' THEN 30000 WHEN 'N' THEN 20000 ELSE 40000 END AS cut FROM p WHERE endpoint <> 'A' OR regexp_matches(p_type, 'SMALL|ECONOMY')),
y AS (SELECT *, CASE WHEN endpoint = 'N' THEN real_y < log10(cut) ELSE real_y >= log10(cut) END AS r, CASE WHEN endpoint = 'N' THEN pred_y < log10(cut) ELSE pred_y >= log10(cut) END AS c FROM x),
a AS (SELECT endpoint, arm, {REG} FROM y GROUP BY ALL), b AS (SELECT endpoint, arm, {COUNTS} FROM y GROUP BY ALL)
SELECT a.*, {TRIAGE} FROM a JOIN b USING (endpoint, arm)""")
def round_trip_score(s, d):
    """Per endpoint and arm, the regression and triage metrics of predictions against filtered, capped, transformed truth."""
    p, real, cut, low = predictions(s, d), None, None, None
    keep = F.lit(False)
    for e in ROUND_TRIP:
        own = F.col("endpoint") == e.name
        keep = keep | (own & (t.matches(F.col(e.filter_column), e.filter_pattern) if e.filter_column else F.lit(True)))
        value = t.forward(e.transform, t.clip_upper(F.col("real_raw"), e.cap))
        real = F.when(own, value) if real is None else real.when(own, value)
        edge = t.num(t.forward_value(e.transform, e.cutoff))
        cut = F.when(own, edge) if cut is None else cut.when(own, edge)
        low = F.when(own, F.lit(e.sign == "<")) if low is None else low.when(own, F.lit(e.sign == "<"))
    rows = m.finite_pairs(p.where(keep).withColumn("real_y", real).withColumn("cut", cut).withColumn("low", low))
    call = lambda y: F.when(F.col("low"), F.col(y) < F.col("cut")).otherwise(F.col(y) >= F.col("cut"))
    by = ["endpoint", "arm"]
    counts = m.confusion(call("real_y"), call("pred_y"))
    both = rows.groupBy(*by).agg(*[c.alias(k) for k, c in (m.regression_aggregates() | counts).items()])
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), t.num(0))
    both = both.withColumns({"accuracy": share(tp + tn, tp + tn + fp + fn), "ppv": share(tp, tp + fp), "npv": share(tn, tn + fn), "f1_pos": share(2 * tp, 2 * tp + fp + fn), "f1_neg": share(2 * tn, 2 * tn + fp + fn), "mcc": F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})
    return rounded(both.drop("tp", "fp", "fn", "tn"), *REG_COLUMNS, *TRIAGE_COLUMNS)


@query("regression_metrics", f"{P} SELECT endpoint, arm, {REG} FROM p GROUP BY ALL")
def regression_metrics(s, d):
    return rounded(m.regression(predictions(s, d), ["endpoint", "arm"]), *REG_COLUMNS)


@query("bias_calibration_decomp", f"{P} SELECT endpoint, round(avg(pred_y - real_y), 6) + 0.0 AS bias, round(regr_slope(real_y, pred_y), 6) + 0.0 AS slope, round(regr_intercept(real_y, pred_y), 6) + 0.0 AS intercept, round(({CORR}) ** 2 - ({R2DET}), 6) + 0.0 AS calib_gap FROM p GROUP BY endpoint")
def bias_calibration_decomp(s, d):
    out = predictions(s, d).groupBy("endpoint").agg(F.avg(F.col("pred_y") - F.col("real_y")).alias("bias"), *[c.alias(k) for k, c in m.calibration_line().items()])
    return rounded(out, "bias", "slope", "intercept", "calib_gap")


@query("spearman_by_group", f"""{P}, r AS (SELECT endpoint, arm, rank() OVER (PARTITION BY endpoint, arm ORDER BY real_raw) + (count(*) OVER (PARTITION BY endpoint, arm, real_raw) - 1) / 2 AS a, rank() OVER (PARTITION BY endpoint, arm ORDER BY k) + (count(*) OVER (PARTITION BY endpoint, arm, k) - 1) / 2 AS b FROM (SELECT *, floor(pred_raw) AS k FROM p))
  SELECT endpoint, arm, count(*) AS n, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) + 0.0 AS spearman_rho FROM r GROUP BY ALL""")
def spearman_by_group(s, d):
    rows = predictions(s, d).withColumn("k", F.floor("pred_raw"))
    return rounded(m.spearman(rows, ["endpoint", "arm"], "real_raw", "k"), "spearman_rho")


def _association_sql(*pairs: str) -> str:
    one = "SELECT '{0}' AS first, '{1}' AS second, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) + 0.0 AS rho FROM (SELECT rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2 AS x, rank() OVER (ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2 AS y FROM v WHERE {0} IS NOT NULL AND {1} IS NOT NULL)"
    return " UNION ALL ".join(one.format(*p) for p in pairs)


@query("task_association", f"""WITH v AS (SELECT CASE WHEN p_partkey % 3 > 0 THEN p_size::DOUBLE END AS a, CASE WHEN p_partkey % 5 > 1 THEN p_retailprice END AS b, CASE WHEN p_partkey % 2 > 0 THEN length(p_name)::DOUBLE END AS c FROM part) {_association_sql('ab', 'ac', 'bc')}""")
def task_association(s, d):
    """Tasks that are measured on parts of the compounds only."""
    some = lambda share, c: F.when(share, c.cast("double"))
    k = F.col("p_partkey")
    v = table(s, d, "part").select(some(k % 3 > 0, F.col("p_size")).alias("a"), some(k % 5 > 1, F.col("p_retailprice")).alias("b"), some(k % 2 > 0, F.length("p_name")).alias("c"))
    return rounded(m.rank_association(v, ["a", "b", "c"]), "rho")


@query("triage_metrics", f"{P}, y AS (SELECT endpoint, arm, real_raw >= 40000 AS r, pred_raw >= 30000 AS c FROM p), b AS (SELECT endpoint, arm, {COUNTS} FROM y GROUP BY ALL) SELECT endpoint, arm, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {TRIAGE} FROM b")
def triage_metrics(s, d):
    return rounded(m.triage(predictions(s, d), ["endpoint", "arm"], F.col("real_raw") >= 40000, F.col("pred_raw") >= 30000), *TRIAGE_COLUMNS)


@query("confusion_crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_F, count(*) FILTER (l_linestatus = 'O') AS n_O FROM lineitem GROUP BY l_returnflag")
def confusion_crosstab(s, d):
    return m.crosstab(table(s, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("roc_auc", f"""{P}, r AS (SELECT endpoint, (real_raw >= 40000)::INT AS y, rank() OVER (PARTITION BY endpoint ORDER BY k0) + (count(*) OVER (PARTITION BY endpoint, k0) - 1) / 2 AS k FROM (SELECT *, floor(pred_raw) AS k0 FROM p))
  SELECT endpoint, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg, round((sum(CASE WHEN y = 1 THEN k ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) + 0.0 AS roc_auc FROM r GROUP BY endpoint""")
def roc_auc(s, d):
    return rounded(m.roc_auc(predictions(s, d).withColumn("k", F.floor("pred_raw")), ["endpoint"], F.col("real_raw") >= 40000, "k"), "roc_auc")


@query("pr_auc", f"""{P}, x AS (SELECT endpoint, floor(pred_raw / 100) AS score, count(*) AS n, count(*) FILTER (real_raw >= 40000) AS k FROM p GROUP BY ALL), y AS (SELECT *, sum(k) OVER (PARTITION BY endpoint ORDER BY score DESC) / sum(n) OVER (PARTITION BY endpoint ORDER BY score DESC) AS pr FROM x)
  SELECT endpoint, round(sum(k * pr) / sum(k), 6) + 0.0 AS pr_auc FROM y GROUP BY endpoint""")
def pr_auc(s, d):
    rows = predictions(s, d).withColumn("score", F.floor(F.col("pred_raw") / 100))
    return rounded(m.average_precision(rows, ["endpoint"], F.col("real_raw") >= 40000, "score"), "pr_auc")


@query("ppv_curve", f"{P}, x AS (SELECT least(floor(least(pred_raw / 100000, 1) * 30), 29) AS k, count(*) AS n, count(*) FILTER (real_raw >= 40000) AS y FROM p GROUP BY ALL) SELECT round(k / 30, 6) + 0.0 AS proba, (sum(n) OVER w)::BIGINT AS n, round(sum(y) OVER w / sum(n) OVER w, 6) + 0.0 AS ppv FROM x WINDOW w AS (ORDER BY k DESC)")
def ppv_curve(s, d):
    rows = predictions(s, d).withColumn("score", F.least(F.col("pred_raw") / 100000, t.num(1)))
    return rounded(m.ppv_curve(rows, F.col("real_raw") >= 40000, "score"), "proba", "ppv")


CALIB = """SELECT {keys}count(*) AS n, round(sqrt(avg(e * e)), 6) + 0.0 AS rmse_cv, round(stddev_samp(real_y), 6) + 0.0 AS label_std, round(regr_intercept(e, uq_std), 6) + 0.0 AS recal_a, round(regr_slope(e, uq_std), 6) + 0.0 AS recal_b FROM"""
CALIB_COLUMNS = ("rmse_cv", "label_std", "recal_a", "recal_b")


@query("calibration_params", f"{P} {CALIB.format(keys='endpoint, arm, ')} (SELECT *, abs(real_y - pred_y) AS e FROM p) GROUP BY endpoint, arm")
def calibration_params(s, d):
    return rounded(cal.parameters(predictions(s, d), ["endpoint", "arm"]), *CALIB_COLUMNS)


#: The arms of one line status: folds of all lines, a block that tests two of the folds, and one that tests every line.
ARM_CALIBRATION = f"""{P}, x AS (SELECT endpoint, compound, fold, uq_std, real_y, abs(real_y - pred_y) AS e FROM p WHERE arm = 'F'),
  s AS (SELECT a.endpoint, 'augmented_cv' AS arm, f.fold, 'other folds' AS "rows", a.e, a.uq_std, a.real_y FROM x a JOIN (SELECT DISTINCT endpoint, fold FROM x) f ON a.endpoint = f.endpoint AND a.fold <> f.fold
    UNION ALL SELECT endpoint, 'internal_temp', NULL, 'without tested', e, uq_std, real_y FROM x WHERE compound NOT IN (SELECT compound FROM x WHERE fold <= 2)
    UNION ALL SELECT endpoint, 'ext_to_internal', NULL, 'pooled', e, uq_std, real_y FROM x)
  SELECT endpoint, arm, fold, "rows", count(*) AS n, round(sqrt(avg(e * e)), 6) + 0.0 AS rmse_cv, round(stddev_samp(real_y), 6) + 0.0 AS label_std, round(regr_intercept(e, uq_std), 6) + 0.0 AS recal_a, round(regr_slope(e, uq_std), 6) + 0.0 AS recal_b FROM s GROUP BY ALL"""


@query("arm_calibration", ARM_CALIBRATION)
def arm_calibration(s, d):
    p = predictions(s, d).where("arm = 'F'").select("endpoint", "compound", "fold", "real_y", "pred_y", "uq_std")
    rows = p.withColumn("arm", F.lit("augmented_cv")).unionByName(p.where("fold <= 2").withColumn("arm", F.lit("internal_temp"))).unionByName(p.withColumn("arm", F.lit("ext_to_internal")))
    return rounded(cal.arm_calibration(rows, ["endpoint"]), *CALIB_COLUMNS)


@query("winner_table", f"""{P}, x AS (SELECT endpoint, CASE arm WHEN 'F' THEN 'internal_cv' ELSE 'augmented_cv' END AS arm, CASE WHEN fold = 1 THEN 'rf' ELSE 'cp' END AS method, round({R2DET}, 6) + 0.0 AS r2det FROM p WHERE fold <= 2 GROUP BY ALL),
  y AS (SELECT endpoint, arm, max(r2det) AS v, arg_min(method, (-r2det, method <> 'rf')) AS m FROM x GROUP BY ALL)
  SELECT endpoint, max(v) FILTER (arm = 'internal_cv') AS internal_cv, max(m) FILTER (arm = 'internal_cv') AS internal_cv_by, max(v) FILTER (arm = 'augmented_cv') AS augmented_cv, max(m) FILTER (arm = 'augmented_cv') AS augmented_cv_by, CASE max(m) FILTER (arm = 'augmented_cv') WHEN 'rf' THEN 'all public' ELSE NULL END AS note FROM y GROUP BY endpoint""")
def winner_table(s, d):
    from lodestone.operators.arms import winner_table as table_of

    p = predictions(s, d).withColumn("arm", F.when(F.col("arm") == "F", "internal_cv").otherwise("augmented_cv"))
    store = lambda fold: rounded(m.regression(p.where(F.col("fold") == fold), ["endpoint", "arm"]), "r2det")
    return table_of({"rf": store(1), "cp": store(2)}, ("internal_cv", "augmented_cv"), metric="r2det")


@query("confidence_across_arms", f"{P} SELECT CASE arm WHEN 'F' THEN 'cv' ELSE 'round trip' END AS setting, endpoint, compound::VARCHAR AS compound, round(abs(real_y - pred_y), 6) + 0.0 AS residual, round(exp(-uq_std), 6) + 0.0 AS confidence FROM p")
def confidence_across_arms(s, d):
    from lodestone.operators.arms import confidence_across_arms as across

    p = predictions(s, d).withColumn("conf_recal", F.exp(-F.col("uq_std")))
    return rounded(across({"cv": p.where("arm = 'F'"), "round trip": p.where("arm = 'O'")}), "residual", "confidence")


@query("metrics_table", f"{P}, x AS (SELECT endpoint, CASE arm WHEN 'F' THEN 'internal_cv' ELSE 'internal_temp' END AS arm, real_y, pred_y, real_y >= 4.6 AS r, pred_y >= 4.6 AS c FROM p), b AS (SELECT endpoint, arm, {REG}, {COUNTS} FROM x GROUP BY ALL) SELECT endpoint, arm, n, rmse, mae, pearson_r, r2, r2det, bias, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {TRIAGE}, CASE WHEN arm LIKE '%temp%' THEN 2 ELSE 1 END::INTEGER AS block, row_number() OVER (PARTITION BY endpoint ORDER BY arm LIKE '%temp%', r2det DESC, arm) AS place FROM b")
def metrics_table(s, d):
    p = predictions(s, d).select("endpoint", F.when(F.col("arm") == "F", "internal_cv").otherwise("internal_temp").alias("arm"), "real_y", "pred_y")
    return rounded(m.metrics_table(p, ["endpoint"], t.num(4.6)), *REG_COLUMNS, *TRIAGE_COLUMNS)


@query("balanced_accuracy", f"{P}, y AS (SELECT endpoint, real_raw >= 40000 AS r, pred_raw >= 30000 AS c FROM p) SELECT endpoint, round((avg(c::INT) FILTER (r) + avg((NOT c)::INT) FILTER (NOT r)) / 2, 6) + 0.0 AS balanced_accuracy FROM y GROUP BY endpoint")
def balanced_accuracy(s, d):
    return rounded(m.balanced_accuracy(predictions(s, d), ["endpoint"], F.col("real_raw") >= 40000, F.col("pred_raw") >= 30000), "balanced_accuracy")


@query("favourable_place", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(1 / (1 + exp(-(-1) * 2.0::DOUBLE * 1.5::DOUBLE * (log10(c_acctbal) - log10(5000::DOUBLE)))), 6) + 0.0 END AS place FROM customer")
def favourable_place(s, d):
    return table(s, d, "customer").select("c_custkey", r6(t.favourable_place("log10", "<=", F.col("c_acctbal"), 5000.0, 2.0, 1.5)).alias("place"))


@query("confidence_lofo", f"{P} {CALIB.format(keys='a.endpoint, f.fold, ')} (SELECT *, abs(real_y - pred_y) AS e FROM p) a JOIN (SELECT DISTINCT fold FROM p) f ON a.fold <> f.fold GROUP BY a.endpoint, f.fold")
def confidence_lofo(s, d):
    return rounded(cal.parameters_without_fold(predictions(s, d), ["endpoint"]).select("endpoint", "fold", "n", *CALIB_COLUMNS), *CALIB_COLUMNS)


@query("confidence_variants", f"""{P}, q AS (SELECT endpoint, sqrt(avg(e * e)) AS rmse, stddev_samp(real_y) AS sd, regr_intercept(e, uq_std) AS a, regr_slope(e, uq_std) AS b FROM (SELECT *, abs(real_y - pred_y) AS e FROM p) GROUP BY endpoint)
  SELECT endpoint, arm, count(*) AS n, round(avg(exp(-uq_std / sd)), 6) + 0.0 AS conf_labelstd, round(avg(exp(-uq_std / rmse)), 6) + 0.0 AS conf_rmse, round(avg(exp(-greatest(a + b * uq_std, 0) / rmse)), 6) + 0.0 AS conf_recal, round(min(exp(-uq_std / rmse)), 6) + 0.0 AS low FROM p JOIN q USING (endpoint) GROUP BY endpoint, arm""")
def confidence_variants(s, d):
    out = cal.calibrated(predictions(s, d), ["endpoint"])
    mean = [r6(F.avg(c)).alias(c) for c in ("conf_labelstd", "conf_rmse", "conf_recal")]
    return out.groupBy("endpoint", "arm").agg(F.count(F.lit(1)).alias("n"), *mean, r6(F.min("conf_rmse")).alias("low"))


@query("conformal_confidence", f"""{P}, x AS (SELECT p_type AS g, round(uq_std, 2) AS u, floor(abs(real_y - pred_y) * 1000) AS e FROM p), n AS (SELECT g, e / u AS s FROM x), v AS (SELECT g, s, count(*) AS k FROM n GROUP BY ALL), r AS (SELECT DISTINCT g, u FROM x)
  SELECT r.g, r.u, round(sum(k) FILTER (s <= 400 / u) / sum(k), 6) + 0.0 AS conf FROM r JOIN v ON r.g = v.g GROUP BY r.g, r.u""")
def conformal_confidence(s, d):
    rows = predictions(s, d).select(F.col("p_type").alias("g"), F.round("uq_std", 2).alias("uq_std"), t.num(0).alias("real_y"), F.floor(F.abs(F.col("real_y") - F.col("pred_y")) * 1000).cast("double").alias("pred_y"), t.num(400).alias("rmse_cv"))
    return cal.conformal(rows, ["g"]).select("g", F.round("uq_std", 2).alias("u"), r6("conf_conformal").alias("conf")).distinct()


CONF = "least(greatest(1 - abs(real_y - pred_y) / 2, 0), 1)"


def with_conf(s, d):
    p = predictions(s, d)
    return p.withColumn("conf", F.least(F.greatest(1 - F.abs(F.col("real_y") - F.col("pred_y")) / 2, t.num(0)), t.num(1))).withColumn("residual", F.abs(F.col("real_y") - F.col("pred_y")))


@query("fixed_bin_mean", f"{P}, x AS (SELECT *, {CONF} AS conf FROM p) SELECT endpoint, ceil(conf * 5)::BIGINT AS bin, count(*) AS n, round(avg(abs(real_y - pred_y)), 6) + 0.0 AS error FROM x WHERE conf > 0 GROUP BY ALL")
def fixed_bin_mean(s, d):
    rows = with_conf(s, d).withColumn("bin", m.fixed_bins(F.col("conf"))).where("bin is not null")
    return rows.groupBy("endpoint", "bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("residual")).alias("error"))


@query("quantile_bin_mean", "WITH q AS (SELECT event_type, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS e FROM events GROUP BY event_type) SELECT event_type, (1 + len(list_filter(list_distinct(e), lambda x: x < value)))::BIGINT AS bin, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events JOIN q USING (event_type) GROUP BY ALL")
def quantile_bin_mean(s, d):
    rows = m.quantile_bins(table(s, d, "events").select("event_type", "value"), "value", ["event_type"])
    return rows.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


@query("half_split_rmse", f"{P}, x AS (SELECT *, {CONF} AS conf FROM p) SELECT endpoint, conf >= 0.5 AS confident, count(*) AS n, round(sqrt(avg((real_y - pred_y) ** 2)), 6) + 0.0 AS rmse FROM x GROUP BY ALL")
def half_split_rmse(s, d):
    return rounded(m.half_split(with_conf(s, d), ["endpoint"], "conf", "residual"), "rmse")


@query("quadrant_share", f"{P}, x AS (SELECT endpoint, CASE WHEN real_raw >= 40000 THEN CASE WHEN pred_raw >= 30000 THEN 'hit' ELSE 'missed' END ELSE CASE WHEN pred_raw >= 30000 THEN 'false' ELSE 'clear' END END AS quadrant FROM p), y AS (SELECT endpoint, quadrant, count(*) AS n FROM x GROUP BY ALL) SELECT endpoint, quadrant, n, round(100 * n / sum(n) OVER (PARTITION BY endpoint), 6) + 0.0 AS share FROM y")
def quadrant_share(s, d):
    high, call = F.col("real_raw") >= 40000, F.col("pred_raw") >= 30000
    name = F.when(high & call, "hit").when(high, "missed").when(call, "false").otherwise("clear")
    counts = predictions(s, d).groupBy("endpoint", name.alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("endpoint").agg(F.sum("n").alias("all"))
    return counts.join(total, "endpoint").select("endpoint", "quadrant", "n", r6(F.col("n") * 100 / F.col("all")).alias("share"))


@query("reliability_deciles", "WITH x AS (SELECT value AS conf, value / 500 AS c FROM events WHERE value > 0), q AS (SELECT quantile_cont(c, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM x) SELECT (1 + len(list_filter(list_distinct(e), lambda y: y < c)))::BIGINT AS bin, count(*) AS n, round(avg(c), 6) + 0.0 AS conf, round(-ln(avg(c)) * 0.5, 6) + 0.0 AS expected FROM x, q GROUP BY ALL")
def reliability_deciles(s, d):
    rows = table(s, d, "events").where("value > 0").select((F.col("value") / 500).alias("c"))
    return m.quantile_bins(rows, "c", [], 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("c")).alias("conf"), r6(-F.log(F.avg("c")) * 0.5).alias("expected"))


@query("distinct_probabilities", "SELECT event_type, count(DISTINCT value) AS n FROM events GROUP BY event_type")
def distinct_probabilities(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.countDistinct("value").alias("n"))


@query("winner_per_arm", f"{P}, x AS (SELECT endpoint, arm, fold, round({R2DET}, 6) + 0.0 AS r2det FROM p GROUP BY ALL) SELECT endpoint, arm, arg_min(fold, (-r2det, fold)) AS fold, max(r2det) AS r2det FROM x GROUP BY endpoint, arm")
def winner_per_arm(s, d):
    rows = rounded(m.regression(predictions(s, d), ["endpoint", "arm", "fold"]), "r2det")
    return m.winners(rows, ["endpoint", "arm"], "r2det", "fold").select("endpoint", "arm", "fold", "r2det")


@query("metrics_table_blocks", f"{P}, x AS (SELECT endpoint, arm, {REG} FROM p GROUP BY ALL) SELECT endpoint, arm, r2det, rmse, row_number() OVER (ORDER BY arm = 'O', r2det DESC, endpoint) AS place FROM x")
def metrics_table_blocks(s, d):
    from pyspark.sql import Window

    rows = rounded(m.regression(predictions(s, d), ["endpoint", "arm"]), "r2det", "rmse")
    order = Window.orderBy(F.col("arm") == "O", F.col("r2det").desc_nulls_last(), "endpoint")
    return rows.select("endpoint", "arm", "r2det", "rmse", big(F.row_number().over(order)).alias("place"))


FLAGS_SQL = ", ".join(f"coalesce({c} = {best}({c}) OVER w, false) AS {c}_best, coalesce({c} = {worst}({c}) OVER w AND {best}({c}) OVER w <> {worst}({c}) OVER w, false) AS {c}_worst" for c, best, worst in (("rmse", "min", "max"), ("mae", "min", "max"), ("r2det", "max", "min")))


@query("best_worst_flags", f"{P}, x AS (SELECT endpoint, CASE arm WHEN 'F' THEN 'internal_cv' ELSE 'internal_temp' END AS arm, round(sqrt(avg((pred_y - real_y) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(pred_y - real_y)), 6) + 0.0 AS mae, round({R2DET}, 6) + 0.0 AS r2det FROM p GROUP BY ALL), y AS (SELECT *, CASE WHEN arm LIKE '%temp%' THEN 2 ELSE 1 END::INTEGER AS block FROM x) SELECT *, {FLAGS_SQL} FROM y WINDOW w AS (PARTITION BY block)")
def best_worst_flags(s, d):
    rows = rounded(m.regression(predictions(s, d), ["endpoint", "arm"]), "rmse", "mae", "r2det")
    rows = rows.withColumn("arm", F.when(F.col("arm") == "F", "internal_cv").otherwise("internal_temp")).select("endpoint", "arm", "rmse", "mae", "r2det")
    rows = rows.withColumn("block", m.arm_block(F.col("arm")))
    return m.block_flags(rows, "block", ["rmse", "mae", "r2det"])


@query("arm_summary", f"{P}, x AS (SELECT endpoint, arm, {R2DET} AS v FROM p GROUP BY ALL) SELECT endpoint, round(max(v) FILTER (arm = 'F'), 6) + 0.0 AS f, round(max(v) FILTER (arm = 'O'), 6) + 0.0 AS o, round(greatest(max(v), 0), 6) + 0.0 AS shown FROM x GROUP BY endpoint")
def arm_summary(s, d):
    rows = m.regression(predictions(s, d), ["endpoint", "arm"])
    v = F.col("r2det")
    return rows.groupBy("endpoint").agg(r6(F.max(F.when(F.col("arm") == "F", v))).alias("f"), r6(F.max(F.when(F.col("arm") == "O", v))).alias("o"), r6(F.greatest(F.max(v), t.num(0))).alias("shown"))


FOLDS = "ntile(5) OVER (ORDER BY md5('42|' || g), g)"


@query("grouped_kfold", f"{C}, g AS (SELECT g, {FOLDS} AS fold FROM (SELECT DISTINCT coalesce(CASE WHEN doc_id % 9 > 0 THEN _ik END, 'id:' || doc_id) AS g FROM c)) SELECT doc_id, fold FROM c JOIN g ON g.g = coalesce(CASE WHEN doc_id % 9 > 0 THEN _ik END, 'id:' || doc_id)")
def grouped_kfold(s, d):
    return sp.group_folds(compounds(s, d), "doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("_ik"))).select("doc_id", "fold")


@query("kfold_plain", f"SELECT c_custkey, {FOLDS} AS fold FROM (SELECT c_custkey, c_custkey::VARCHAR AS g FROM customer)")
def kfold_plain(s, d):
    return sp.group_folds(table(s, d, "customer"), "c_custkey").select("c_custkey", "fold")


@query("kfold_augmented", f"""{C}, f AS (SELECT doc_id, {FOLDS} AS fold FROM (SELECT doc_id, doc_id::VARCHAR AS g FROM c WHERE source = 'internal')), r AS (SELECT s AS split, doc_id, CASE WHEN fold = s THEN 'test' ELSE 'train' END AS role FROM f, generate_series(1, 5) t(s) UNION ALL SELECT s, doc_id, 'train' FROM c, generate_series(1, 5) t(s) WHERE source <> 'internal')
  SELECT split, role, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM r GROUP BY ALL""")
def kfold_augmented(s, d):
    c = compounds(s, d)
    folded = sp.group_folds(c.where("source = 'internal'"), "doc_id")
    out = sp.roles(folded, "doc_id", 5, c.where("source <> 'internal'"))
    return out.groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("temporal_split", "SELECT c_name, CASE WHEN row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '(\\d+)', 1) AS DOUBLE), c_name) <= floor((SELECT count(*) FROM customer) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM customer")
def temporal_split(s, d):
    return sp.temporal(table(s, d, "customer").select("c_name"), "c_name").select("c_name", "role")


@query("rolling_origin_blocks", "WITH b AS (SELECT ntile(10) OVER (ORDER BY ts, event_id) AS block FROM events), c AS (SELECT block, count(*) AS n_test FROM b GROUP BY block) SELECT block, n_test, n_train FROM (SELECT *, (sum(n_test) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS n_train FROM c) WHERE block > 5")
def rolling_origin_blocks(s, d):
    return sp.rolling_blocks(table(s, d, "events"), [F.col("ts"), F.col("event_id")])


@query("leave_one_group_out", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) AS fold FROM part")
def leave_one_group_out(s, d):
    return sp.leave_one_out(table(s, d, "part"), "p_name").select("p_partkey", "fold")


@query("stratified_group_kfold", """WITH RECURSIVE g AS (SELECT p_name, count(*) FILTER (p_size <= 25) AS c0, count(*) FILTER (p_size > 25) AS c1, md5('42|' || p_name) AS dice FROM part GROUP BY p_name),
  t AS (SELECT greatest(1, sum(c0))::DOUBLE AS t0, greatest(1, sum(c1))::DOUBLE AS t1 FROM g),
  pat AS (SELECT *, row_number() OVER (ORDER BY 2 * (c0 * c0 + c1 * c1) - (c0 + c1) * (c0 + c1) DESC, c0 DESC, c1 DESC) AS r FROM (SELECT c0, c1, count(*) AS n FROM g GROUP BY c0, c1)),
  steps AS (SELECT row_number() OVER (ORDER BY r, i) AS s, c0, c1, i FROM pat, range(5) x(i) WHERE i < n % 5),
  walk(s, a, b, f) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], [0, 0, 0, 0, 0]::BIGINT[], 0::BIGINT UNION ALL
    SELECT s, list_transform(range(1, 6), lambda j: a[j] + CASE WHEN j = f THEN c0 ELSE 0 END), list_transform(range(1, 6), lambda j: b[j] + CASE WHEN j = f THEN c1 ELSE 0 END), f FROM (
      SELECT st.s, w.a, w.b, c0, c1, (list_sort(list_transform(range(1, 6), lambda j: struct_pack(c := (w.a[j] * c0)::DOUBLE / (t0 * t0) + (w.b[j] * c1)::DOUBLE / (t1 * t1), z := w.a[j] + w.b[j], j := j))))[1].j AS f FROM walk w JOIN steps st ON st.s = w.s + 1, t)),
  placed AS (SELECT p_name, c0, c1, row_number() OVER (PARTITION BY c0, c1 ORDER BY dice, p_name) - 1 AS pos, count(*) OVER (PARTITION BY c0, c1) AS n FROM g)
  SELECT p_partkey, CASE WHEN pos < n // 5 * 5 THEN pos % 5 + 1 ELSE w.f END AS fold FROM part JOIN placed q USING (p_name) LEFT JOIN steps st ON st.c0 = q.c0 AND st.c1 = q.c1 AND st.i = pos - n // 5 * 5 LEFT JOIN walk w ON w.s = st.s""")
def stratified_group_kfold(s, d):
    part = table(s, d, "part").withColumn("y", (F.col("p_size") > 25).cast("int"))
    return sp.stratified_group_folds(part, "p_name", "y").select("p_partkey", "fold")


@query("stored_fold_reuse", "SELECT 'found' AS part, count(*) AS n, sum(o_custkey % 5)::BIGINT AS folds FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') UNION ALL SELECT 'missing', count(*), NULL FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def stored_fold_reuse(s, d):
    stored = table(s, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 5).alias("fold"))
    found, missing = sp.stored_folds(table(s, d, "orders").select("o_custkey").distinct(), stored, "o_custkey")
    return found.agg(F.lit("found").alias("part"), F.count(F.lit(1)).alias("n"), F.sum("fold").alias("folds")).union(missing.agg(F.lit("missing"), F.count(F.lit(1)), F.lit(None).cast("bigint")))


@query("best_combo", f"{C}, o AS (SELECT origin, count(*) AS n FROM c WHERE source <> 'internal' GROUP BY origin HAVING count(*) > 28) SELECT origin, n FROM o WHERE origin IN ('src1', 'src2', 'src3', 'src99') OR NOT EXISTS (SELECT 1 FROM o WHERE origin IN ('src1', 'src2', 'src3', 'src99'))")
def best_combo(s, d):
    counts = rel.origin_counts(compounds(s, d).where("source <> 'internal'"), "origin", 28)
    return counts.where(F.col("origin").isin(sp.best_combo(counts, ["src1", "src2", "src3", "src99"])))


#: The internal side is every fiftieth vector, a query set against all vectors but itself.
V = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT a.vec_id AS pool, b.vec_id AS internal, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) + 0.0 AS dist FROM v a, v b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"""


def vector_sides(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return v, v.where("id % 50 = 0")


def nearest_one(s, d, k=1):
    return nb.nearest(*vector_sides(s, d), k, digits=6, skip_same=True)


@query("distance_shell", f"WITH {V} SELECT pool, min(dist) AS nearest FROM x GROUP BY pool HAVING min(dist) <= 0.7")
def distance_shell(s, d):
    return nb.shell(nearest_one(s, d), 0.7)


@query("pairs_within", f"WITH {V} SELECT pool, internal, dist FROM x WHERE dist <= 0.6")
def pairs_within(s, d):
    return nb.within(*vector_sides(s, d), 0.6, digits=6).where("pool <> internal")


@query("knn_join", f"WITH {V} SELECT internal, pool, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY internal ORDER BY dist, pool) AS rank FROM x) WHERE rank <= 5")
def knn_join(s, d):
    return nb.nearest(*vector_sides(s, d), 5, "internal", digits=6, skip_same=True).select("internal", "pool", "dist", "rank")


@query("mutual_knn", f"WITH {V} SELECT internal, pool, dist FROM (SELECT *, row_number() OVER (PARTITION BY internal ORDER BY dist, pool) AS a, row_number() OVER (PARTITION BY pool ORDER BY dist, internal) AS b FROM x) WHERE a <= 5 AND b <= 5")
def mutual_knn(s, d):
    return nb.mutual_nearest(*vector_sides(s, d), 5, digits=6, skip_same=True)


@query("enn_filter", f"WITH {V}, k AS (SELECT pool, avg(b.label) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY dist, internal) AS r FROM x) JOIN v b ON b.vec_id = internal WHERE r <= 3 GROUP BY pool) SELECT pool, round(mean, 6) + 0.0 AS neighbour_label, label FROM k JOIN v ON vec_id = pool WHERE abs(label - mean) <= 2")
def enn_filter(s, d):
    pool, internal = vector_sides(s, d)
    return rounded(nb.edited(nearest_one(s, d, 3), pool, internal, 2.0).select("pool", "neighbour_label", "label"), "neighbour_label")


@query("nearest_distance", f"WITH {V} SELECT pool, min(dist) AS nn_dist, min(dist) > 0.7 AS novel FROM x GROUP BY pool")
def nearest_distance(s, d):
    return nearest_one(s, d).select("pool", F.col("dist").alias("nn_dist"), (F.col("dist") > 0.7).alias("novel"))


@query("distance_weights", f"WITH {V} SELECT pool, round(exp(-min(dist) / 0.5), 6) + 0.0 AS weight FROM x GROUP BY pool")
def distance_weights(s, d):
    return rounded(nb.distance_weights(nearest_one(s, d), 0.5), "weight")


@query("affine_bias_correction", f"{C}, a AS (SELECT median(label) AS m, quantile_cont(label, 0.75) - quantile_cont(label, 0.25) AS q FROM c WHERE source <> 'internal'), b AS (SELECT median(label) AS m, quantile_cont(label, 0.75) - quantile_cont(label, 0.25) AS q FROM c WHERE source = 'internal') SELECT doc_id, round((label - a.m) * (b.q / a.q) + b.m, 6) + 0.0 AS affine FROM c, a, b WHERE source <> 'internal'")
def affine_bias_correction(s, d):
    c = compounds(s, d)
    out = nb.correct_bias(c.where("source <> 'internal'"), c.where("source = 'internal'"), "affine")
    return out.select("doc_id", r6("corrected").alias("affine"))


BITS_SQL = "b AS (SELECT DISTINCT o_custkey AS compound, (o_orderkey % 12)::BIGINT AS bit FROM orders UNION SELECT DISTINCT o_custkey, 100 + o_orderkey % 12 FROM orders)"
KEPT_SQL = "k AS (SELECT bit, count(*) AS n_compounds, md5(string_agg(compound::VARCHAR, ',' ORDER BY compound)) AS sig FROM b GROUP BY bit HAVING count(*) >= 5)"


def order_bits(s, d):
    """Bits of customers as compounds; each bit has a copy of another number."""
    one = table(s, d, "orders").select(F.col("o_custkey").alias("compound"), (F.col("o_orderkey") % 12).alias("bit"))
    return one.union(one.withColumn("bit", F.col("bit") + 100))


@query("kept_bits", f"WITH {BITS_SQL}, {KEPT_SQL} SELECT bit, n_compounds, bit = min(bit) OVER (PARTITION BY sig) AS kept, min(bit) OVER (PARTITION BY sig) AS duplicate_of FROM k")
def kept_bits(s, d):
    return bt.keep_bits(order_bits(s, d), 5)


@query("bit_matrix", f"""WITH {BITS_SQL}, {KEPT_SQL}, v AS (SELECT bit, row_number() OVER (ORDER BY md5(bit::VARCHAR), bit) - 1 AS i FROM (SELECT min(bit) AS bit FROM k GROUP BY sig)),
  h AS (SELECT compound, string_agg(i::VARCHAR, ',' ORDER BY i) AS indices, count(*) AS n FROM b JOIN v USING (bit) GROUP BY compound) SELECT c_custkey AS compound, coalesce(indices, '') AS indices, coalesce(n, 0) AS n FROM customer LEFT JOIN h ON compound = c_custkey""")
def bit_matrix(s, d):
    """Customers without orders have no bits and get an empty row."""
    matrix, _ = bt.bit_matrix(order_bits(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("compound")), 5)
    return matrix.select("compound", F.concat_ws(",", F.col("indices").cast("array<string>")).alias("indices"), F.size("indices").cast("bigint").alias("n"))


WORD_SETS_SQL = f"{COMPOUNDS_SQL}, w AS (SELECT doc_id, source, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM c)"


@query("tanimoto_within", f"""WITH {WORD_SETS_SQL}, x AS (SELECT a.doc_id AS pool, b.doc_id AS internal, len(list_intersect(a.w, b.w)) AS k, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON a.source <> 'internal' AND b.source = 'internal' AND least(len(a.w), len(b.w)) >= 0.39 * greatest(len(a.w), len(b.w)) AND len(a.w) > 0 AND len(b.w) > 0)
  SELECT pool, internal, round(1 - k / (n - k)::DOUBLE, 6) + 0.0 AS dist FROM x WHERE round(1 - k / (n - k)::DOUBLE, 6) <= 0.6""")
def tanimoto_within(s, d):
    """Internal documents and those of the pool that share words: sets of all words of all documents."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    c = compounds(s, d).select(F.col("doc_id").alias("id"), "source", words.alias("bits"))
    return sj.tanimoto_within(c.where("source <> 'internal'"), c.where("source = 'internal'"), 0.6, digits=6)


@query("knn_visits")
def knn_visits(s, d):
    """How many cells the pivot join met for each query, of how many."""
    pool, internal = vector_sides(s, d)
    found = pv.nearest_by_pivots(internal, pool, 5, digits=6, skip_same=True)
    return found.groupBy("id").agg(F.max("visited").alias("visited"), F.max("cells").alias("cells"), F.max("dist").alias("farthest"))


SCAN_SQL = """WITH v AS (SELECT vec_id, 'o' || (label % 3) AS origin, vec_id % 3 + 1 AS fold, vec_id % 4 = 0 AS mine, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[1]::DOUBLE * 2 + embedding[2]::DOUBLE - embedding[3]::DOUBLE * embedding[4]::DOUBLE AS y FROM embeddings),
o AS (SELECT origin, row_number() OVER (ORDER BY origin) - 1 AS i FROM (SELECT DISTINCT origin FROM v WHERE NOT mine)), m AS (SELECT m.mask, list(origin ORDER BY origin) AS os FROM range(1, 1 << (SELECT count(*) FROM o)) m(mask) JOIN o ON (m.mask >> i) & 1 = 1 GROUP BY m.mask),
held AS (SELECT 0 AS f UNION ALL SELECT DISTINCT fold FROM v WHERE mine),
train AS (SELECT mask, f, a, b, y, mine FROM m, held, v WHERE CASE WHEN mine THEN f > 0 AND fold <> f ELSE list_contains(os, origin) END),
s AS (SELECT mask, f, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) * var_pop(a) + 1 AS aa, count(*) * var_pop(b) + 1 AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS by_ FROM train GROUP BY mask, f),
h AS (SELECT mask, f, n, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS u, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS w, ma, mb, my FROM s),
p AS (SELECT mask, f, n, y, my + u * (a - ma) + w * (b - mb) AS p FROM h JOIN v ON mine AND (f = 0 OR f = fold)),
r AS (SELECT mask, f > 0 AS cv, any_value(n) FILTER (f = 0) AS n_train, corr(p, y) ** 2 AS r2, 1 - sum((p - y) ** 2) / (count(*) * var_pop(y)) AS det, sqrt(avg((p - y) ** 2)) AS rmse FROM p GROUP BY mask, f > 0)
SELECT x.mask, list_aggregate(os, 'string_agg', '+') AS combo, x.n_train, round(x.r2, 6) + 0.0 AS R2_pears, round(x.det, 6) + 0.0 AS R2_det, round(x.rmse, 6) + 0.0 AS RMSE, round(c.det, 6) + 0.0 AS cv_r2det, round(c.rmse, 6) + 0.0 AS cv_rmse FROM r x JOIN r c ON c.mask = x.mask AND c.cv JOIN m ON m.mask = x.mask WHERE NOT x.cv"""


@query("origin_scan", SCAN_SQL)
def origin_scan(s, d):
    """Every subset of the public origins as training rows of a ridge head on two features, alone and beside internal folds."""
    v = table(s, d, "embeddings").select("vec_id", F.concat(F.lit("o"), F.col("label") % 3).alias("origin"), (F.col("vec_id") % 3 + 1).alias("fold"), F.col("embedding").cast("array<double>").alias("e"))
    v = v.select("vec_id", "origin", "fold", F.slice("e", 1, 2).alias("features"), F.expr("e[0] * 2 + e[1] - e[2] * e[3]").alias("label"))
    out = gram.scan(v.where("vec_id % 4 <> 0"), v.where("vec_id % 4 = 0"))
    return rounded(out, "R2_pears", "R2_det", "RMSE", "cv_r2det", "cv_rmse")


@query("nested_selection", f"""{P}, x AS (SELECT fold, endpoint || arm AS strategy, round({R2DET}, 6) + 0.0 AS v FROM p GROUP BY ALL), y AS (SELECT a.fold AS outer_fold, a.strategy, a.v AS outer_v, round(avg(b.v), 6) + 0.0 AS inner_v FROM x a JOIN x b ON a.strategy = b.strategy AND a.fold <> b.fold GROUP BY ALL)
  SELECT outer_fold, arg_min(strategy, (-inner_v, strategy)) AS strategy, arg_min(outer_v, (-inner_v, strategy)) AS honest_r2 FROM y GROUP BY outer_fold""")
def nested_selection(s, d):
    rows = rounded(m.regression(predictions(s, d).withColumn("strategy", F.concat("endpoint", "arm")), ["fold", "strategy"]), "r2det").select("fold", "strategy", "r2det")
    others = rows.select(F.col("fold").alias("f"), F.col("strategy").alias("k"), F.col("r2det").alias("v"))
    inner = rows.join(others, (F.col("strategy") == F.col("k")) & (F.col("fold") != F.col("f"))).groupBy(F.col("fold").alias("outer_fold"), "strategy").agg(r6(F.avg("v")).alias("inner"), F.max("r2det").alias("outer"))
    return nb.nested_selection(inner)


@query("butina_clusters", f"""WITH RECURSIVE {V.split("x AS (")[0].rstrip().rstrip(",")}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) + 0.0 <= 0.66),
  o AS (SELECT a AS id, list(b) AS nb, row_number() OVER (ORDER BY count(*) DESC, a) AS r FROM e GROUP BY a),
  walk(r, centres) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.r, CASE WHEN len(list_intersect(nb, centres)) = 0 THEN list_append(centres, id) ELSE centres END FROM walk w JOIN o ON o.r = w.r + 1),
  c AS (SELECT unnest(centres) AS id FROM walk WHERE r = (SELECT count(*) FROM o)), t AS (SELECT e.a AS id, arg_min(e.b, o.r) AS centre FROM e JOIN c ON c.id = e.b JOIN o ON o.id = e.b WHERE e.a NOT IN (SELECT id FROM c) GROUP BY e.a)
  SELECT vec_id AS compound, coalesce(centre, vec_id) AS cluster FROM v LEFT JOIN t ON t.id = vec_id""")
def butina_clusters(s, d):
    """All vectors against all: the densest one takes its neighbours, then the next that is left."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ns.butina(v.select(F.col("id").alias("compound")), nb.links_within(v, 0.66, digits=6), once=True)


@query("task_clusters")
def task_clusters(s, d):
    """Tasks measured on some lines only, grouped by the rank correlations of those measured together."""
    k, some = F.col("l_orderkey") + F.col("l_linenumber"), lambda share, c: F.when(share, c)
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    tasks = {"quantity": some(k % 3 > 0, F.col("l_quantity")), "price": some(k % 5 > 0, F.col("l_quantity") * F.col("p_retailprice")), "tax": F.col("l_tax"), "discount": some(k % 2 > 0, F.col("l_discount")), "retail": F.col("p_retailprice"), "size": some(k % 7 > 2, F.col("p_size").cast("double"))}
    wide = rows.select(*[c.cast("double").alias(n) for n, c in tasks.items()])
    return gp.cluster_table(s, gp.task_clusters(wide, list(tasks)))
