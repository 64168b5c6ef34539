"""Deployment, serving bindings, arms with confidence, the near-shell search and the command line."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.config import Endpoint
from lodestone.functions import keys
from lodestone.operators import arms, deploy, learners, nearshell, registry, relational


def rows_of(spark, n, prefix, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    y = x @ np.array([1.0, -0.5, 0.3, 0, 0, 0]) + shift + rng.normal(size=n) * 0.1
    rows = [(f"{prefix}{i:03d}", f"S{prefix}{i}", [float(v) for v in x[i]], float(y[i]), i % 5 + 1, "train" if i < 0.7 * n else "test", f"pub:{'ab'[i % 2]}") for i in range(n)]
    return spark.createDataFrame(rows, "compound string, smiles string, features array<double>, label double, fold int, role string, origin string")


@pytest.fixture(scope="module")
def sides(spark):
    return rows_of(spark, 50, "I", 1), rows_of(spark, 40, "P", 2, 0.2).drop("fold", "role")


class Counting:
    """A forest that notes how many rows each fit had."""

    def __init__(self):
        self.sizes = []

    def __call__(self):
        model, sizes = learners.forest(trees=4, depth=4), self.sizes

        class Fit:
            def fit(self, df):
                sizes.append(df.count())
                return model.fit(df)

        return Fit()


def test_deploy_fits_calibrates_registers_and_binds(spark, sides, tmp_path):
    internal, public = sides
    e, make = Endpoint("sol", "x", "log10", unit="uM", cutoff=10.0), Counting()
    dry = deploy.deploy_endpoint(e, internal, public, make, str(tmp_path / "dry"), dry_run=True)
    assert dry.model_id is None and make.sizes == [80] * 5 + [90] and dry.n_train == 90 and dry.sources == ["internal", "pub:a", "pub:b"]
    assert set(dry.calibration) == {"rmse_cv", "recal_a", "recal_b", "label_std"} and dry.calibration["rmse_cv"] == pytest.approx(dry.cv_rmse)
    reg = registry.Registry(spark, str(tmp_path / "reg"), create=True)
    small = lambda: learners.forest(trees=4, depth=4)
    one = deploy.deploy_endpoint(e, internal, public, small, str(tmp_path / "m"), reg)
    two = deploy.deploy_endpoint(e, internal, public, small, str(tmp_path / "m"), reg, pin=one.model_id)
    assert (one.model_id, one.version, two.model_id, two.version) == (1, 1, 1, 2) and "sol: 1" in one.notice and two.notice is None
    assert reg.training_set(1).count() == 90 and reg.details(1)["version"] == 2 and reg.trail(1).count() == 2
    with pytest.raises(ValueError):
        deploy.deploy_endpoint(e, internal, public, small, str(tmp_path / "m"), reg, pin=99)
    with pytest.raises(KeyError):
        reg.details(99)
    cp = deploy.deploy_transfer(e, internal, public, str(tmp_path / "t"), reg, tasks=["logd", "sol"])
    again = deploy.deploy_transfer(e, internal, public, str(tmp_path / "t"), None, dry_run=True)
    assert cp.meta["target_index"] == 1 and again.model_id is None and deploy.read_json(spark, f"{cp.artifact}/meta")["confidence"] == "rf"
    bound, warnings = deploy.bind(reg, {"sol": 1, "logd": None, "hlm": 77}, str(tmp_path / "b"))
    assert set(bound) == {"sol"} and len(warnings) == 2
    scored = bound["sol"].apply(internal.select("compound", "features"))
    assert scored.count() == 50 and bound["sol"].calibration["rmse_cv"] == pytest.approx(two.calibration["rmse_cv"])
    deploy.write_text(spark, f"{two.artifact}/meta", json.dumps({"endpoint": "sol"}))
    fallback, _ = deploy.bind(reg, {"sol": 1}, str(tmp_path / "b"))
    assert fallback["sol"].calibration == {"label_std": pytest.approx(np.std([r.label for r in reg.training_set(1).collect()], ddof=1))}
    values, warnings = deploy.bind_values(reg, {"sol": "transfer", "logd": "transfer", "hlm": "magic"}, {"sol": cp.model_id})
    assert set(values) == {"sol"} and len(warnings) == 2
    truth = {r.compound: r.label for r in internal.collect()}
    got = {r.compound: r.pred_y for r in values["sol"].apply(internal.select("compound", "features")).collect()}
    assert np.corrcoef([got[c] for c in truth], [truth[c] for c in truth])[0, 1] > 0.9
    told = deploy.roster([Endpoint("zzz", "z"), e], {"sol": bound["sol"], "zzz": bound["sol"]}, values, [{"key": "px", "model_id": 5}], ["sol"])
    assert [x["key"] for x in told["endpoints"]] == ["sol", "zzz"] and told["endpoints"][0]["value_model"] == "transfer" and told["endpoints"][1]["value_model"] == "rf" and told["extras"][0]["cutoff"] == 0.5
    assert [f for f, _ in deploy.filter_fields(told)] == ["mpo", "sol_pred", "sol_confidence", "zzz_pred", "zzz_confidence", "px_pred"]
    reg.delete(1)
    with pytest.raises(KeyError):
        reg.details(1)


def test_selection_touches_visible_rows_only(spark):
    df = spark.range(10).withColumn("selected", F.col("id") == 0)
    seen = F.col("id") < 4
    assert deploy.selection_state(df, seen) == "some"
    on = deploy.select_all(df, seen, True)
    assert deploy.selection_state(on, seen) == "all" and on.where("selected").count() == 4
    assert deploy.selection_state(deploy.select_all(on, seen, False), seen) == "none" and deploy.selection_state(on, F.lit(False)) == "none"
    assert deploy.select_all(df, F.col("id") > 4, False).where("selected").count() == 1
    scored = deploy.extra_columns(df, {"px": lambda d: d.withColumn("proba", F.lit(0.25))})
    assert scored.columns == ["id", "selected", "px_pred"]


def test_arms_have_confidences_and_origins_are_scanned(spark, sides, tmp_path):
    internal, public = sides
    make = lambda: learners.forest(trees=3, depth=3)
    out = arms.assess_with_confidence(internal, public, make, str(tmp_path / "a"), k=5)
    assert {r.arm for r in out.select("arm").distinct().collect()} == {a.name for a in arms.ARMS}
    assert out.where("conf_recal is null or conf_recal < 0 or conf_recal > 1").count() == 0
    assert out.where("arm = 'internal_cv'").count() == 50 and out.where("arm like '%temporal'").count() == 45
    scan = arms.scan_origins(public, internal, ["pub:a", "pub:b"], make, str(tmp_path / "s")).collect()
    assert sorted(r.combo for r in scan) == ["a", "a+b", "b"] and scan[0].R2_pears == max(r.R2_pears for r in scan)
    with pytest.raises(ValueError):
        arms.scan_origins(public, internal, list("abcdefghijk"), make, "x")
    moved = arms.transfer_arms(internal, public, 2)
    assert {(r.arm, r.n) for r in moved.groupBy("arm").agg(F.count(F.lit(1)).alias("n")).collect()} == {("augmented_cv", 20), ("internal_cv", 20), ("ext_to_internal", 50)}
    frame = arms.confidence_across_arms({"cv": out.where("arm = 'internal_cv'").withColumn("endpoint", F.lit("e")), "trip": out.limit(3).withColumn("endpoint", F.lit("e"))})
    assert frame.count() == 53


def test_uncertainty_modes(spark, sides, tmp_path):
    internal, public = sides
    for mode in learners.UNCERTAINTY:
        got = learners.uncertain(mode, public, internal.select("compound", "features"), lambda: learners.forest(trees=4, depth=4), str(tmp_path / mode), members=3)
        assert got.columns == ["compound", "features", "pred_y", "uq_std"] and got.where("uq_std >= 0 and pred_y is not null").count() == 50
    with pytest.raises(ValueError):
        learners.uncertain("dropout", public, internal, None, "x")


def test_winner_table(spark):
    store = lambda rows: spark.createDataFrame(rows, "endpoint string, arm string, r2 double")
    rf = store([("a", "internal_cv", 0.5), ("a", "augmented_cv", 0.6), ("b", "internal_cv", 0.3), ("b", "augmented_cv", 0.2), ("c", "augmented_cv", 0.4)])
    cp = store([("a", "augmented_cv", 0.7), ("b", "internal_cv", 0.3), ("z", "augmented_cv", 0.9)])
    got = {r.endpoint: r for r in arms.winner_table({"rf": rf, "cp": cp}, nested=spark.createDataFrame([("b", 0.25)], "endpoint string, honest double"), groupings=spark.createDataFrame([("a", "all8")], "endpoint string, grouping string")).collect()}
    assert set(got) == {"a", "b", "c"} and (got["a"].augmented_cv, got["a"].augmented_cv_by, got["a"].note) == (0.7, "cp", "all8")
    assert (got["b"].internal_cv_by, got["b"].augmented_cv_by, got["b"].note) == ("rf", "near-shell", "dist060_agree") and got["c"].note == "all public" and got["c"].internal_cv is None


def linear():
    return LinearRegression(featuresCol="_vector", labelCol="label", regParam=0.01)


def test_strategies_pick_what_they_say(spark, sides, tmp_path):
    internal, public = sides
    pool, own = public.select("compound", "features", "label"), internal.select("compound", "features", "label")
    known = nearshell.strategies(str(tmp_path))
    p, q = pool.collect(), own.collect()
    x, y = np.array([r.features for r in p]), np.array([r.features for r in q])
    d = 1 - x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1))
    label, theirs = np.array([r.label for r in p]), np.array([r.label for r in q])
    names = np.array([r.compound for r in p])
    three = np.array([theirs[np.argsort(row)[:3]].mean() for row in d])
    want = {"internal_only": np.zeros(40, bool), "all_nvs": np.ones(40, bool), "dist_040": d.min(1) <= 0.4, "knn_3": np.isin(np.arange(40), np.argsort(d, axis=0)[:3]), "enn_050": abs(label - three) <= 0.5, "dist060_agree": (d.min(1) <= 0.6) & (abs(label - three) <= 0.5), "range_00": (label >= theirs.min()) & (label <= theirs.max())}
    for name, pick in known.items():
        got = pick(pool, own)
        assert got.columns == nearshell.COLUMNS, name
        rows = got.collect()
        assert all(r.weight >= 0 and math.isfinite(r.weight) for r in rows) and len({r.compound for r in rows}) == len(rows)
        if name in want:
            assert {r.compound for r in rows} == set(names[want[name]]), name
    weights = {r.compound: r.weight for r in known["expw"](pool, own).collect()}
    assert all(weights[n] == pytest.approx(math.exp(-v / 0.25)) for n, v in zip(names, d.min(1)))


def test_near_shell_run_resumes_and_isolates_errors(spark, sides, tmp_path):
    internal, public = sides
    internal = internal.where("fold <= 3")
    load = lambda name: (public.limit(0), internal) if name == "none" else (public, internal) if name == "good" else 1 / 0
    names, tight, folder = ["internal_only", "all_nvs"], ["internal_only", "all_nvs"], str(tmp_path)
    records, errors = nearshell.run(spark, ["good", "bad", "none"], load, {"lin": linear}, folder, names, tight)
    assert [r["endpoint"] for r in records] == ["good", "none"] and "ZeroDivisionError" in errors["bad"] and records[1]["note"] == "no public pool"
    rows = deploy.read_json(spark, f"{folder}/compare_good")
    assert len(rows) == 2 and rows[0]["lin_r2det"] == max(r["lin_r2det"] for r in rows) and {"lin_r2", "lin_sec", "n_pool"} <= set(rows[0])
    verdict = deploy.read_json(spark, f"{folder}/nested_good")["nested"]
    assert set(verdict["fold_winners"]) == {"1", "2", "3"} and records[0]["nested_r2det"] == verdict["honest_r2det"]
    calls = []
    again, _ = nearshell.run(spark, ["good", "none"], lambda n: calls.append(n) or load(n), {"lin": linear}, folder, names, tight, resume=True)
    assert calls == ["none"] and {r["endpoint"] for r in again} == {"good", "none"}  # without a pool there is no verdict to find
    table = nearshell.verdict_table(again)
    assert set(table[0]) == set(nearshell.VERDICT) and table[0]["endpoint"] == "good"


def test_greedy_groups():
    worth = {"a": 2.0, "b": 1.0, "c": -1.0}
    score = lambda g: sum(worth[x] for x in g)
    assert nearshell.greedy_groups(list(worth), score) == (["a", "b"], 3.0)
    assert nearshell.greedy_groups(list(worth), score, forward=False) == (["a", "b"], 3.0)


def test_butina_against_one_list(spark):
    random.seed(3)
    links = {(min(a, b), max(a, b)) for a, b in ((random.randrange(60), random.randrange(60)) for _ in range(110)) if a != b}
    near = {i: {b if a == i else a for a, b in links if i in (a, b)} for i in range(70)}
    want, left = {}, set(range(70))
    for i in sorted(range(70), key=lambda i: (-len(near[i]), i)):
        if i in left:
            for j in {i} | near[i] & left:
                want[j] = i
            left -= {i} | near[i]
    ids = spark.range(70).select(F.col("id").alias("compound"))
    got = nearshell.butina(ids, spark.createDataFrame(sorted(links), "a bigint, b bigint"))
    assert {r.compound: r.cluster for r in got.collect()} == want
    assert nearshell.butina(ids, spark.createDataFrame([], "a bigint, b bigint")).where("cluster <> compound").count() == 0


@pytest.mark.parametrize("few", [0, 20, 10**6])
def test_butina_settles_open_links_on_tables_and_in_one_task(spark, few):
    """A chain of rows that wait for each other, a star and single ones; links come in any order and again, or once."""
    chain = [(i, i + 1) for i in range(12)]
    star = [(40 + i, 30) for i in range(5)]
    links, ids = chain + star, spark.range(60).select(F.col("id").alias("compound"))
    near = {i: {a + b - i for a, b in links if i in (a, b)} for i in range(60)}
    want, left = {}, set(range(60))
    for i in sorted(range(60), key=lambda i: (-len(near[i]), i)):
        if i in left:
            want |= {j: i for j in {i} | near[i] & left}
            left -= {i} | near[i]
    again = spark.createDataFrame([*links, *[(b, a) for a, b in links], *links, (5, 5)], "a bigint, b bigint")
    once = spark.createDataFrame(links, "a bigint, b bigint")
    for frame, told in ((again, False), (once, True)):
        assert {r.compound: r.cluster for r in nearshell.butina(ids, frame, once=told, few=few).collect()} == want


def test_columns_and_providers(spark):
    df = spark.createDataFrame([("1.5", "x", 3)], "DS_a string, DS_b string, other int")
    assert relational.prefixed(df.columns, "DS_") == ["DS_a", "DS_b"] and relational.prefixed(df.columns, "", ("other",)) == ["DS_a", "DS_b"]
    assert tuple(relational.conform(df, ["other", "DS_b", "DS_a", "gone"]).first()) == (3.0, None, 1.5, None)
    with pytest.raises(LookupError):
        keys.provided("weight", F.col("DS_a"))
    keys.provide("weight", lambda s: s.str.len().astype(float), "double")
    try:
        assert df.select(keys.provided("weight", F.col("DS_a")).alias("w")).first().w == 3.0
    finally:
        keys.PROVIDERS.clear()


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(9)
    n = 40
    x = rng.normal(size=(2 * n, 4))
    y = 10 ** (x[:, 0] - x[:, 1] / 2)
    raw = [(f"C-{i:03d}", f"mol{i}", float(y[i])) for i in range(n)] + [("C-900", "zero", 0.0)]
    spark.createDataFrame(raw, "name string, smiles string, sol double").write.parquet(f"{tmp_path}/internal.parquet")
    public = [(f"P{i}", f"pub{i}" if i > n else "mol0", float(math.log10(y[i])), "o:a") for i in range(n, 2 * n)]
    spark.createDataFrame(public, "compound string, smiles string, value double, origin string").write.parquet(f"{tmp_path}/public_sol.parquet")
    spark.createDataFrame([(c[0], [float(v) for v in x[i]]) for i, c in enumerate([*raw[:n], *public])], "compound string, features array<double>").write.parquet(f"{tmp_path}/features.parquet")
    (tmp_path / "c.yaml").write_text("endpoints:\n  sol: {column: sol, transform: log10, cap: 1000.0}\nn_folds: 2\n")
    common = ["--config", str(tmp_path / "c.yaml"), "--data", str(tmp_path), "--out", str(tmp_path / "out"), "--trees", "3", "--depth", "3"]
    internal, pub = cli.frames(spark, cli.load_settings(tmp_path / "c.yaml"), str(tmp_path), Endpoint("sol", "sol", "log10"), "exact")
    assert internal.count() == n and pub.count() == n - 1  # a zero has no logarithm; one public row is an internal molecule
    got = cli.main([*common, "--assess", "--deploy", "--assess-transfer"], spark)
    assert {r["arm"] for r in got["assess"]} == {a.name for a in arms.ARMS} and got["deploy"][0]["model_id"] == 1 and len(got["assess_transfer"]) == 3
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["deploy"][0]["n_train"] == 2 * n - 1
    again = cli.main([*common, "--assess"], spark)
    assert [r["rmse"] for r in again["assess"]] == [r["rmse"] for r in got["assess"]]  # loaded, not fitted again
    with pytest.raises(SystemExit):
        cli.main(["--config", "x"], spark)
