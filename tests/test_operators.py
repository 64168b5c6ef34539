import json
import math

import pytest
from pyspark.sql import functions as F

from lodestone.config import Endpoint
from lodestone.operators import assembly, calibration, grid, learners, metrics, neighbours, registry, relational, serving, splits
from lodestone.sources import readers, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_modelling_frame_caps_merges_and_prefers_internal(spark):
    rows = [("C1", "CCO", math.log10(20000), "internal", "internal"), ("C2", "c1ccccc1", math.log10(500), "EXP", "pub_a"), ("C3", "CCO", math.log10(300), "EXP", "pub_a"), ("C4", "asp", float("-inf"), "EXP", "pub_b"), ("C5", "caf", math.log10(800), "EXP", "pub_b")]
    long = frame(spark, rows, "compound string, smiles string, label double, source string, origin string").withColumn("endpoint", F.lit("sol"))
    features = frame(spark, [(f"C{i}", 1.0, 2.0) for i in range(1, 5)], "compound string, F0 double, F1 double")
    got = {r.smiles: r for r in assembly.modelling_frame(long, features, Endpoint("sol", "x", "log10", cap=15000.0), ["F0", "F1"]).collect()}
    assert set(got) == {"CCO", "c1ccccc1"} and got["CCO"].compound == "C1" and got["CCO"].label == pytest.approx(math.log10(15000))


def test_long_frame_filters_and_transforms(spark):
    raw = frame(spark, [("I1", "a", 100.0, 10.0, "MDR1"), ("I2", "b", 1000.0, 5.0, "MDR2"), ("I3", "c", None, 2.0, "MDR1")], "name string, smiles string, sol double, mdck double, `Cell line` string")
    pub = frame(spark, [("P1", "caf", math.log10(50), "nvs")], "compound string, smiles string, value double, origin string")
    eps = [Endpoint("sol", "sol", "log10"), Endpoint("mdck", "mdck", "log10", filter_column="Cell line", filter_pattern="MDR1")]
    got = assembly.long_frame(spark, raw, eps, {"sol": [pub], "mdck": [pub]}).collect()
    assert sorted(r.compound for r in got if r.endpoint == "sol") == ["I1", "I2", "P1"]
    assert sorted(r.compound for r in got if r.endpoint == "mdck") == ["I1", "I3", "P1"]
    assert next(r for r in got if r.endpoint == "sol" and r.compound == "I1").label == 2.0


def test_training_pools(spark):
    rows = [("I1", "eth", "internal", 1.0, 2.0), ("I2", "ben", "internal", None, 2.5), ("I3", "tol", "internal", 2.2, None), ("I4", "caf", "internal", float("-inf"), 1.0), ("P1", "eth", "EXP", 1.1, None), ("P2", "nap", "NVS", None, 2.4), ("P3", "xyl", "ADM", None, None)]
    wide = relational.with_keys(frame(spark, rows, "compound string, smiles string, source string, sol double, logd double"), "smiles")
    aux = frame(spark, [("nap", 0.7, 9.0), ("tol", 0.1, 8.0)], "smiles string, le double, px double")
    pub, own = assembly.training_pools(wide, ["sol", "logd"], "logd", aux, ["le"])
    assert [r.compound for r in pub.collect()] == ["P2"] and {r.compound for r in own.collect()} == {"I1", "I2", "I4"}
    assert all(r.le is None for r in own.collect()) and pub.first().le == 0.7 and own.where("compound = 'I4'").first().sol is None
    pub, _ = assembly.training_pools(wide, ["sol", "logd"], "logd", level="none")
    assert {r.compound for r in pub.collect()} == {"P1", "P2"}
    with pytest.raises(ValueError):
        assembly.training_pools(wide.where("compound <> 'P2'"), ["sol", "logd"], "logd")


def test_anti_join_keeps_missing_keys(spark):
    pub = frame(spark, [("a", "k1"), ("b", None), ("c", "k2")], "compound string, _ik string")
    own = frame(spark, [("x", "k1"), ("y", None)], "compound string, _ik string")
    assert {r.compound for r in relational.drop_twins(pub, own).collect()} == {"b", "c"}
    assert {r.compound: r.is_twin for r in relational.twin_mask(pub, own).collect()} == {"a": True, "b": False, "c": False}
    pub = frame(spark, [("a", "ABCDEFGHIJKLMN-XX"), ("b", "OTHER")], "compound string, _ik string")
    own = frame(spark, [("x", "ABCDEFGHIJKLMN-YY")], "compound string, _ik string")
    for level, gone in (("exact", set()), ("skeleton", {"a"}), ("none", set())):
        assert {r.compound for r in relational.twin_mask(pub, own, level=level).where("is_twin").collect()} == gone
        assert {r.compound for r in relational.drop_twins(pub, own, level=level).collect()} == {"a", "b"} - gone


def test_natural_join_matches_missing_keys(spark):
    a, b = frame(spark, [(1, None), (2, "x")], "i int, k string"), frame(spark, [(None, 5), ("x", 6)], "k string, v int")
    assert {(r.i, r.v) for r in relational.natural_join(a, b).collect()} == {(1, 5), (2, 6)}
    with pytest.raises(ValueError):
        relational.natural_join(a.select("i"), b)


def test_checks_raise(spark):
    a = frame(spark, [("x",)], "compound string")
    with pytest.raises(ValueError):
        relational.check_coverage(a, frame(spark, [], "compound string"), "compound")
    with pytest.raises(ValueError):
        relational.check_columns(["a"], ["b"], "f")
    with pytest.raises(ValueError):
        relational.check_cardinality(a, a.union(a), ["compound"])
    two = frame(spark, [("x",), ("y",), (None,)], "compound string")
    relational.check_cardinality(two, two, ["compound"])
    with pytest.raises(ValueError, match="lost rows of 1 keys and repeated rows of 1"):
        relational.check_cardinality(two, frame(spark, [("x",), ("x",), (None,)], "compound string"), ["compound"])
    with pytest.raises(ValueError):
        sinks.check_contract(frame(spark, [("a", "s", float("nan"), "o")], "compound string, smiles string, value double, origin string"))


def test_group_folds_partition_and_keep_twins(spark):
    rows = [(f"SRB-{i:06d}-001", None if i < 2 else f"IK{i // 2}") for i in range(40)]
    df = frame(spark, rows, "compound string, _ik string")
    got = splits.group_folds(df, "compound", F.col("_ik")).collect()
    assert len(got) == 40 and {r.fold for r in got} == {1, 2, 3, 4, 5}
    by = {}
    for r in got:
        if r._ik:
            assert by.setdefault(r._ik, r.fold) == r.fold
    assert sorted(map(tuple, got)) == sorted(map(tuple, splits.group_folds(df, "compound", F.col("_ik")).collect()))
    roles = splits.roles(splits.group_folds(df, "compound", F.col("_ik")), "compound", 5, frame(spark, [("P",)], "compound string"))
    assert roles.where("id = 'P' and role = 'test'").count() == 0 and roles.where("role = 'test'").count() == 40


def test_temporal_cut_truncates_like_a_double(spark):
    df = frame(spark, [(f"X{i}",) for i in range(90)], "id string")
    assert splits.temporal(df, "id").where("role = 'train'").count() == int(90 * 0.7)


def test_confidences_are_bounded_and_fall_with_spread(spark):
    import random

    random.seed(1)
    rows = []
    for i in range(500):
        s, y = abs(random.gauss(0.3, 0.1)) + 0.01, random.gauss(0, 1)
        rows.append((i, y, y + random.gauss(0, 1) * s * 3, s, i % 5 + 1))
    df = frame(spark, rows, "compound int, real_y double, pred_y double, uq_std double, fold int")
    p = calibration.parameters(df, []).first()
    assert p.recal_b > 0.5
    got = calibration.conformal(calibration.calibrated(df.withColumn("g", F.lit(1)), ["g"]), ["g"])
    for c in ("conf_labelstd", "conf_rmse", "conf_recal", "conf_conformal"):
        r = got.agg(F.min(c), F.max(c), F.corr(c, "uq_std")).first()
        assert 0 <= r[0] <= r[1] <= 1 and r[2] < 0
    lofo = calibration.calibrated(df.withColumn("g", F.lit(1)), ["g"], fold="fold")
    assert lofo.count() == 500
    assert calibration.parameters_without_fold(df.withColumn("fold", F.lit(1)), []).count() == 0


def test_degenerate_metrics_do_not_raise(spark):
    df = frame(spark, [(1.0, i / 9, 0.1 + i / 10) for i in range(10)], "real_y double, pred_y double, uq_std double")
    r = metrics.regression(df, []).first()
    assert r.r2 is None and r.r2det is None and r.rmse > 0
    assert calibration.parameters(df, []).first().rmse_cv > 0
    one = metrics.triage(df, [], F.col("real_y") > 0, F.col("pred_y") >= 0).first()
    assert one.accuracy == 1 and one.ppv == 1 and one.npv == 0 and one.mcc is None


def test_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 6)), rng.normal(size=(30, 6))
    x[5], x[6] = x[4], 0.0
    pool = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, v array<double>")
    own = frame(spark, [(100 + i, v.tolist()) for i, v in enumerate(y)], "id int, v array<double>")
    with np.errstate(invalid="ignore"):
        d = np.round(1 - x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)), 12)
    want = {(100 + j, int(i), r + 1) for j in range(30) for r, i in enumerate(sorted((i for i in range(70) if i != 6), key=lambda i: (d[i, j], i))[:3])}
    small, neighbours.PART_ROWS, neighbours.GROUP_ROWS = (neighbours.PART_ROWS, neighbours.GROUP_ROWS), 16, 8
    try:
        got = neighbours.nearest(pool, own, 3, "internal")
        assert {(r.internal, r.pool, r["rank"]) for r in got.collect()} == want
        a = {(100 + j, i) for j, i, _ in ((j - 100, i, r) for j, i, r in want)}
        b = {(100 + int(j), i) for i in range(70) if i != 6 for j in sorted(range(30), key=lambda j: (d[i, j], j))[:3]}
        assert {(r.internal, r.pool) for r in neighbours.mutual_nearest(pool, own, 3).collect()} == a & b
        pairs = {(r.pool, r.internal) for r in neighbours.within(pool, own, 0.4).collect()}
        assert pairs == {(i, 100 + j) for i in range(70) for j in range(30) if d[i, j] <= 0.4}
    finally:
        neighbours.PART_ROWS, neighbours.GROUP_ROWS = small
    assert neighbours.nearest(pool.limit(0), own, 2).count() == 0


def test_bias_correction(spark):
    pool = frame(spark, [(float(i),) for i in range(11)], "label double")
    own = frame(spark, [(100.0 + 2 * i,) for i in range(11)], "label double")
    mid = lambda mode, **k: sorted(r.corrected for r in neighbours.correct_bias(pool, own, mode, **k).collect())
    assert mid("shift")[5] == 110 and mid("affine") == [100.0 + 2 * i for i in range(11)]
    assert mid("anchor", anchors=frame(spark, [(1.0, 4.0), (2.0, 4.0), (3.0, 4.0)], "pool_label double, internal_label double"))[0] == 2.0
    assert mid("anchor", anchors=frame(spark, [], "pool_label double, internal_label double"))[0] == 0.0


def test_registry(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        registry.Registry(spark, str(tmp_path / "none"))
    r = registry.Registry(spark, str(tmp_path / "r"), create=True)
    assert r.table().count() == 0
    assert r.add("exp", "rf", "sol", {"r2": 0.5}, "a") == (1, 1) and r.add("exp", "rf", "sol", {}, "b", 1) == (1, 2) and r.add("exp", "rf", "sol", {}, "c") == (2, 1)
    with pytest.raises(ValueError):
        r.add("other", "rf", "sol", {}, "d", 1)
    assert registry.resolve(r.table(), "exp") == 2 and registry.resolve(r.table(), "exp", 1) == 1 and registry.resolve(r.table(), "zzz") is None
    with pytest.raises(ValueError):
        registry.resolve(r.table(), "zzz", 1)
    r.delete(2)
    assert registry.resolve(r.table(), "exp") == 1


def test_top_up_computes_only_what_is_missing(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(sorted(r.compound for r in df.collect()))
        return df.withColumn("F0", F.lit(1.0))

    path = str(tmp_path / "cache")
    ids = lambda *x: frame(spark, [(i,) for i in x], "compound string")
    assert sinks.top_up(spark, path, ids("a", "b"), "compound", compute) == 2
    assert sinks.top_up(spark, path, ids("a", "b"), "compound", compute) == 0
    assert sinks.top_up(spark, path, ids("a", "c"), "compound", compute) == 1
    assert seen == [["a", "b"], ["c"]] and spark.read.parquet(path).count() == 3


def test_records_and_export(spark):
    text = "mol1\nx\nM  END\n$$$$\n\nbad\n$$$$\n\nM  END\n> <a>\n1\n\n$$$$\n"
    got = readers.split_records(frame(spark, [(text,)], "value string")).orderBy("ordinal").collect()
    assert [r.compound for r in got] == ["mol1", "2"]
    out = grid.sdf_records(frame(spark, [("m\nM  END\n", 1.5, None)], "block string, a double, b double"), ["a", "b"]).first().record
    assert out == "m\nM  END\n> <a>\n1.5\n\n$$$$\n"
    assert readers.sniff_columns(["Name", "SMILES", "my_id"]) == ("SMILES", "Name")
    assert readers.sniff_columns(["smiles", "x"]) == ("smiles", None)
    data = "m\nM  END\n> <a>\n1\n\n"
    row = frame(spark, [(0, data, float("inf"), float("nan"), None, "t"), (7, "n", 1.0, 2.0, 3, None)], "idx int, block string, a double, b double, c int, d string")
    texts = [r.record for r in grid.sdf_records(row, ["a", "b", "c", "d"]).orderBy("idx").collect()]
    assert texts == [data + "> <d>\nt\n\n$$$$\n", "n\n> <a>\n1.0\n\n> <b>\n2.0\n\n> <c>\n3\n\n$$$$\n"]
    with pytest.raises(Exception, match="outside this run"):
        grid.sdf_records(row, ["a"], total=5).collect()
    with pytest.raises(ValueError):
        readers.sniff_columns(["a"])


def test_run_store(spark):
    rows = frame(spark, [(f"r{i}", 1000 + i) for i in range(10)], "run_id string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = grid.live_runs(rows, F.timestamp_seconds(F.lit(1012)), 6, 3)
    assert [r.run_id for r in got.collect()] == ["r9", "r8", "r7"]
    assert len(serving.run_id()) >= 20


def test_scoring_feed(spark):
    eps = [Endpoint("sol", "s", "log10", cutoff=10.0)]
    model = {"sol": lambda df: df.withColumn("pred_y", F.col("x")).withColumn("uq_std", F.lit(0.1))}
    df = frame(spark, [(1, 2.0), (2, None)], "id int, x double")
    steps = serving.score(df, eps, model, {"sol": {"rmse_cv": 0.5, "label_std": 1.0, "recal_a": 0.0, "recal_b": 1.0}}, lambda d: d)
    lines = list(serving.progress(steps, lambda f: [r.asDict() for r in f.orderBy("id").collect()]))
    assert [json.loads(x).get("done") for x in lines[:-1]] == [1, 2, 3]
    rows = serving.read_progress(iter(lines))
    assert rows[0]["sol_pred"] == 100 and rows[0]["sol_favorable"] is True and rows[1]["sol_pred"] is None
    with pytest.raises(RuntimeError):
        serving.read_progress(serving.progress(steps_that_fail(), lambda f: f))
    with pytest.raises(RuntimeError):
        serving.check_startup(["a"], [])


def steps_that_fail():
    yield "a", 1, 2, None
    raise ValueError("no")


def test_tree_spread_agrees_with_the_model(spark, tmp_path):
    import random

    random.seed(2)
    rows = [(i, [random.random() for _ in range(4)]) for i in range(120)]
    df = frame(spark, rows, "compound int, features array<double>").withColumn("label", F.expr("features[0] * 3 + features[1]"))
    model = learners.forest(trees=5, depth=4).fit(learners.with_vector(df))
    a = {r.compound: r.pred_y for r in learners.tree_spread(model, df, str(tmp_path / "m")).collect()}
    b = {r.compound: r.prediction for r in model.transform(learners.with_vector(df)).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in b)


def test_partition_replacement(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(frame(spark, [("a", 1), ("b", 2)], "endpoint string, v int"), path, ["endpoint"])
    sinks.replace_partitions(frame(spark, [("b", 3)], "endpoint string, v int"), path, ["endpoint"])
    assert {(r.endpoint, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
