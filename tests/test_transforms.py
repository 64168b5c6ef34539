import math

import pytest
from pyspark.sql import functions as F

from lodestone.config import Endpoint, Settings, load_settings
from lodestone.functions import formula as fm
from lodestone.functions import transforms as t
from lodestone.functions.keys import align_features, featurise, keys_for

INF, NAN = float("inf"), float("nan")


def one(spark, value, column, kind="double"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(("kind", "v", "want"), [("log10", 100.0, 2.0), ("log10", 0.0, None), ("log10", -1.0, None), ("logit_pct", 50.0, 0.0), ("logit_pct", 0.0, None), ("logit_pct", 100.0, None), ("identity", 7.0, 7.0), ("log10", None, None)])
def test_forward(spark, kind, v, want):
    assert one(spark, v, lambda c: t.forward(kind, c)) == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("kind", ["log10", "logit_pct", "identity"])
def test_inverse_undoes_forward(spark, kind):
    assert one(spark, 37.5, lambda c: t.inverse(kind, t.forward(kind, c))) == pytest.approx(37.5)
    assert t.forward_value(kind, 37.5) == pytest.approx(one(spark, 37.5, lambda c: t.forward(kind, c)))


@pytest.mark.parametrize(("v", "want"), [(0.0, math.log10(0.001 / 0.999)), (100.0, math.log10(0.999 / 0.001))])
def test_extraction_clips(spark, v, want):
    assert one(spark, v, lambda c: t.extract("logit_pct", c)) == pytest.approx(want)


@pytest.mark.parametrize(("unit", "v", "want"), [("logS", 0.0, 1e6), ("log10_nM", 3.0, 1.0), ("nM", 1000.0, 1.0)])
def test_units(spark, unit, v, want):
    assert one(spark, v, lambda c: t.to_micromolar(unit, c)) == pytest.approx(want)


def test_mass_units_need_a_weight(spark):
    assert one(spark, 1.0, lambda c: t.to_micromolar("ug.mL-1", c, F.lit(500.0))) == pytest.approx(2.0)
    assert one(spark, 1.0, lambda c: t.to_micromolar("ug.mL-1", c, F.lit(0.0))) is None


def test_unknown_names_raise():
    for call in (lambda: t.forward("ln", F.lit(1)), lambda: t.harmonise("x", F.lit(1)), lambda: t.to_micromolar("kg", F.lit(1)), lambda: Endpoint("a", "b", transform="ln")):
        with pytest.raises(ValueError):
            call()


def test_missing_nan_and_infinite_are_told_apart(spark):
    rows = spark.createDataFrame([(None,), (NAN,), (INF,), (-INF,), (1.0,)], "v double")
    v = F.col("v")
    got = rows.select(t.finite(v), t.finite_or_null(v), t.clip_upper(v, 0.5), t.compare(v, ">=", 0.5), t.binarise(v, 0.5), t.favorable(v, 0.5, ">=")).collect()
    assert [r[0] for r in got] == [False] * 4 + [True]
    assert [r[1] for r in got] == [None] * 4 + [1.0]
    assert got[0][2] is None and got[2][2] == 0.5
    assert [r[3] for r in got] == [False] * 4 + [True]
    assert [r[4] for r in got] == [0] * 4 + [1]
    assert [r[5] for r in got] == [None] * 4 + [True]


@pytest.mark.parametrize(("text", "hit", "bound"), [("2.5", True, True), ("12", False, False), (">5", None, None), (">20", False, False), ("<5", True, True), ("<20", False, None), ("n.d.", None, None), (None, None, None), (" <9.4 ", True, True)])
def test_hit_calls(spark, text, hit, bound):
    assert one(spark, text, lambda c: t.hit_call(c, 10.0), "string") is hit
    assert one(spark, text, lambda c: t.bound_call(c, 10.0), "string") is bound


def test_short_number(spark):
    rows = spark.createDataFrame([(123.4,), (12.34,), (1.234,), (0.1234,), (None,)], "v double").select(t.short_number(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["123", "12.3", "1.23", "0.123", "—"]


def test_desirability_is_half_at_the_centre(spark):
    assert one(spark, 10.0, lambda c: t.desirability("log10", ">=", c, 10.0)) == pytest.approx(0.5)
    assert one(spark, 100.0, lambda c: t.desirability("log10", "<", c, 10.0)) == pytest.approx(1 / (1 + math.exp(2)))


ENDPOINTS = {"sol": Endpoint("sol", "s", "log10", cutoff=10.0), "logd": Endpoint("logd", "l", cutoff=3.0, sign="<")}


@pytest.mark.parametrize(("text", "want"), [("sol + 1", 11.0), ("mean(sol, logd)", 6.0), ("clamp(sol, 0, 5)", 5.0), ("min(sol, logd) * 2", 4.0), ("pow(logd, 3)", 8.0), ("d(sol)", 0.5), ("sol / (logd - 2)", None), ("log(logd - 2)", None), ("-abs(-logd)", -2.0), ("sigmoid(logd, 2)", 0.5)])
def test_formula(spark, text, want):
    values = {k: F.col(k) for k in ENDPOINTS}
    got = spark.createDataFrame([(10.0, 2.0)], "sol double, logd double").select(fm.compile_formula(text, ENDPOINTS, values)).first()[0]
    assert got == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("text", ["__import__('os')", "sol.x", "(lambda: 1)()", "[sol]", "sol if 1 else 2", "d(1)", "unknown", "exp(sol, logd)", "'a'", "c(sol)", "sol +", "True"])
def test_formula_rejects(text):
    with pytest.raises(fm.FormulaError):
        fm.compile_formula(text, ENDPOINTS, {k: F.lit(1.0) for k in ENDPOINTS})


def test_formula_misses_with_its_arguments(spark):
    rows = spark.createDataFrame([(None, 2.0)], "sol double, logd double")
    values = {k: F.col(k) for k in ENDPOINTS}
    assert rows.select(*[fm.compile_formula(x, ENDPOINTS, values) for x in ("min(sol, logd)", "mean(sol, logd)", "clamp(sol, 0, 1)")]).first() == (None, None, None)


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("endpoints:\n  a: {column: x, transform: log10, cutoff: 1}\n  b: {column: y}\ndisplay_order: [b]\nseed: 7\nother: 1\n")
    got = load_settings(tmp_path / "s.yaml")
    assert got.ordered() == ["b", "a"] and got.seed == 7 and got.extra == {"other": 1} and got.endpoint("a").transform == "log10"
    assert Settings().origin_min_n == 100


def test_keys_prefer_the_cache(spark):
    rows = spark.createDataFrame([("a", "CCO"), ("b", "cco "), ("c", None)], "compound string, smiles string")
    cache = spark.createDataFrame([("a", "K1", 0), ("a", "K2", 1)], "compound string, _ik string, ordinal int")
    got = {r.compound: r._ik for r in keys_for(rows, cache).collect()}
    assert got["a"] == "K2" and got["b"] and got["b"] != "K2" and got["c"] is None


def test_features(spark):
    rows = spark.createDataFrame([("abcabc",), ("",), (None,)], "smiles string")
    got = [r.features for r in featurise(rows, "H237", dim=8).collect()]
    assert sum(got[0][:8]) == 4 and got[0][8] == 6 and sum(got[1][:8]) == 0
    with pytest.raises(ValueError):
        featurise(rows, "X")
    assert spark.createDataFrame([([1.0, 2.0],)], "f array<double>").select(align_features(F.col("f"), ["a", "b"], ["b", "a"])).first()[0] == [2.0, 1.0]
    with pytest.raises(ValueError):
        align_features(F.lit(1), ["a"], ["z"])


def test_registered_sql_functions(spark):
    t.register(spark)
    assert spark.sql("SELECT to_log10(100D), from_log10(2D), to_logit_pct(50D), from_logit_pct(0D), to_log10(0D)").first() == (2.0, 100.0, 0.0, 50.0, None)
