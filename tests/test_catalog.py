"""Every registered query of the library against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.plans.all import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert norm([tuple(r) for r in got.collect()], got.columns) == norm(want.fetchall(), columns)


@pytest.mark.parametrize("name", ["clearance_scaling", "harmonise_ops"])
def test_logarithms_at_and_below_zero_equal_sql(spark, tmp_path, name):
    """The smallest tables have no event of value 0, larger ones do."""
    values = [0.0, -0.0, -1.5, 2.5, math.inf, math.nan]
    rows = [(i, kind, v) for i, (kind, v) in enumerate((k, v) for k in ("click", "view", "error") for v in values)]
    spark.createDataFrame(rows, "event_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    assert norm([tuple(r) for r in got.collect()], got.columns) == norm(want.fetchall(), [c[0] for c in want.description])


@pytest.mark.parametrize("name", ["clearance_scaling", "harmonise_ops"])
def test_events_without_value_or_kind_equal_sql(spark, tmp_path, name):
    values = [None, 0.0, 7.25, 99.99, 100.0, 250.0, -math.inf]
    rows = [(i, kind, v) for i, (kind, v) in enumerate((k, v) for k in ("click", "view", None) for v in values)]
    spark.createDataFrame(rows, "event_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    assert norm([tuple(r) for r in got.collect()], got.columns) == norm(want.fetchall(), [c[0] for c in want.description])


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_tree_classifier_featurises_once(spark, monkeypatch):
    """What the tree's passes read are written features, not texts."""
    from lodestone.operators import learners

    seen, whole = [], learners.with_vector
    monkeypatch.setattr(learners, "with_vector", lambda df, *a: seen.extend(df.inputFiles()) or whole(df, *a))
    assert QUERIES["tree_classifier"](spark, SF).count() == 1
    assert seen and not [f for f in seen if "documents.parquet" in f]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_plans_push_down(spark):
    plan = QUERIES["regex_contains_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_type:string>" in plan
    plan = QUERIES["round_trip_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "l_shipdate" not in plan
