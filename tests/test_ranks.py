import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import calibration, metrics, ranks, relational, splits


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_of_many_wide_rows_are_gapless_complete_and_in_order(spark, tmp_path, adaptive):
    n, path = 400_000, str(tmp_path / "ids")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        wide = spark.range(n).select(F.xxhash64("id").alias("k"), F.concat(*[F.md5(F.concat("id", F.lit(str(i))).cast("binary")) for i in range(28)]).alias("text"))
        relational.sequential_ids(wide, [F.col("k")], name="at").write.parquet(path)
        got = spark.read.parquet(path)
        assert got.columns == ["k", "text", "at"]
        assert got.agg(F.count(F.lit(1)), F.countDistinct("at"), F.min("at"), F.max("at")).first() == (n, n, 0, n - 1)
        keys = got.select("k", "at").orderBy("at").toPandas()["k"]
        assert keys.is_monotonic_increasing
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_prefix_sums_by_group_with_clashing_names(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(5), "x") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, w int, _part string")
    got = ranks.prefix_sums(df, ["g"], [F.col("i")], {"before": F.col("w")}).collect()
    for r in got:
        assert r.before == sum(w for g, i, w, _ in rows if g == r.g and i < r.i) and r._part == "x"
    assert len(got) == 500 and ranks.prefix_sums(df.limit(0), ["g"], [F.col("i")], {"before": F.col("w")}).count() == 0


def test_even_parts_are_ntiles(spark):
    for n in (1, 3, 10, 11, 99):
        got = [r.p for r in spark.range(n).select(ranks.even_parts(F.col("id"), n, 10).alias("p")).collect()]
        want = [r.p for r in spark.range(n).selectExpr("ntile(10) over (order by id) p").collect()]
        assert got == want


def test_percentiles_and_bins(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], float(x)) for i, x in enumerate(np.round(rng.normal(size=301), 1))] + [("a", None), ("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    for r in ranks.percentiles(df, ["g"], "v", shares).collect():
        assert np.allclose(r.q, np.quantile([v for g, v in rows if g == r.g and v is not None], shares))
    assert np.allclose(ranks.percentiles(df, [], "v", [0.5]).first().q, np.median([v for _, v in rows if v is not None]))
    got = metrics.quantile_bins(df.where("v is not null"), "v", [], 4).collect()
    edges = np.unique(np.quantile([v for _, v in rows if v is not None], [0, 0.25, 0.5, 0.75, 1]))
    assert all(r.bin == max(1, int(np.searchsorted(edges, r.v, "left"))) for r in got)


def test_rank_metrics_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 200).astype(float), rng.integers(0, 7, 200).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    want = np.corrcoef(rank(a), rank(b))[0, 1]
    assert metrics.spearman(df, [], "a", "b").first().spearman_rho == pytest.approx(want)
    assert metrics.rank_association(df, ["a", "b"]).first()["rho"] == pytest.approx(want)
    y = b > 4
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in a[y] for n in a[~y]])
    assert metrics.roc_auc(df, [], F.col("b") > 4, "a").first().roc_auc == pytest.approx(auc)
    call = a >= 5
    got = metrics.balanced_accuracy(df, [], F.col("b") > 4, F.col("a") >= 5).first().balanced_accuracy
    assert got == pytest.approx((call[y].mean() + (~call[~y]).mean()) / 2)


def test_conformal_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], float(e), float(s)) for i, (e, s) in enumerate(zip(rng.integers(0, 5, 120) / 4, rng.integers(0, 4, 120) / 4))]
    df = spark.createDataFrame(rows, "g string, pred_y double, uq_std double").withColumn("real_y", F.lit(0.0)).withColumn("rmse_cv", F.lit(0.5))
    for by in (["g"], []):
        for r in calibration.conformal(df, by).collect():
            scores = [e / s for g, e, s in rows if s > 0 and (not by or g == r.g)]
            want = None if r.uq_std == 0 else np.mean([x <= 0.5 / r.uq_std for x in scores])
            assert (r.conf_conformal is None) == (want is None) and (want is None or r.conf_conformal == pytest.approx(want))


def test_arm_calibration_leaves_out_what_an_arm_tests(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = []
    for arm, folds, ids in (("internal_cv", 5, range(100)), ("augmented_cv", 5, range(100)), ("ext_to_internal", 1, range(100)), ("internal_temp", 1, range(70, 100))):
        rows += [("e", arm, i % folds + 1, i, float(rng.normal()), float(rng.normal()), float(rng.random()) + 0.1) for i in ids]
    df = spark.createDataFrame(rows, "endpoint string, arm string, fold int, compound int, real_y double, pred_y double, uq_std double")
    got = {(r.arm, r.fold): r for r in calibration.arm_calibration(df, ["endpoint"]).collect()}
    assert len(got) == 12
    rmse = lambda keep: np.sqrt(np.mean([(y - p) ** 2 for _, a, f, i, y, p, _ in rows if a == "augmented_cv" and keep(f, i)]))
    for f in range(1, 6):
        assert got["augmented_cv", f].rmse_cv == pytest.approx(rmse(lambda g, i: g != f)) and got["augmented_cv", f].rows == "other folds"
    assert got["internal_temp", None].rmse_cv == pytest.approx(rmse(lambda f, i: i < 70)) and got["internal_temp", None].n == 70
    assert got["ext_to_internal", None].rmse_cv == pytest.approx(rmse(lambda f, i: True)) and got["ext_to_internal", None].rows == "pooled"
    out = calibration.with_arm_confidence(df, ["endpoint"])
    assert out.count() == len(rows) and out.where("conf_recal is null or conf_recal < 0 or conf_recal > 1").count() == 0
    one = df.where("arm = 'augmented_cv'").withColumn("fold", F.lit(1))
    assert {r.rows for r in calibration.arm_calibration(one, ["endpoint"]).collect()} == {"pooled"}


def test_flags_know_which_way_is_better(spark):
    rows = [("internal_cv", 0.2, 0.5), ("augmented_cv", 0.4, 0.9), ("internal_temp", 0.7, 0.1), ("ext_temp", None, 0.1)]
    df = spark.createDataFrame(rows, "arm string, rmse double, r2det double").withColumn("block", metrics.arm_block(F.col("arm")))
    got = {r.arm: r for r in metrics.block_flags(df, "block", ["rmse", "r2det"]).collect()}
    assert got["internal_cv"].rmse_best and got["augmented_cv"].rmse_worst and got["augmented_cv"].r2det_best and got["internal_cv"].r2det_worst
    assert got["internal_temp"].rmse_best and not got["internal_temp"].rmse_worst and not got["ext_temp"].rmse_best and not got["ext_temp"].rmse_worst
    assert got["internal_temp"].r2det_best and not got["internal_temp"].r2det_worst


def test_metrics_table_orders_blocks_and_knows_signs(spark):
    rows = [(arm, float(y), y + shift) for arm, shift in (("internal_temp", 0.0), ("internal_cv", 0.5), ("augmented_cv", 0.1)) for y in range(10)]
    df = spark.createDataFrame(rows, "arm string, real_y double, pred_y double").withColumn("endpoint", F.lit("e"))
    got = metrics.metrics_table(df, ["endpoint"], F.lit(-1.0)).orderBy("place").collect()
    assert [r.arm for r in got] == ["augmented_cv", "internal_cv", "internal_temp"] and all(r.accuracy == 1 and r.ppv == 1 for r in got)
    low = metrics.metrics_table(df, ["endpoint"], F.lit(20.0), "<").first()
    assert low.accuracy == 1 and low.tp == 10


def test_blocks_of_time_hold_even_shares(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 10).alias("ts"))
    got = splits.time_blocks(df, [F.col("ts"), F.col("id")], 10).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in got] == [11, 11, 11] + [10] * 7
    assert [(r.block, r.n_train, r.n_test) for r in splits.rolling_blocks(df, [F.col("ts"), F.col("id")]).orderBy("block").collect()] == [(6, 53, 10), (7, 63, 10), (8, 73, 10), (9, 83, 10), (10, 93, 10)]
