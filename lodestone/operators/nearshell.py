"""Search for the public rows that help: strategies scored under several learners, an honest nested verdict, a resumable run.

A strategy takes public and internal training rows (compound, features, label) and gives the public rows to add, with a
weight each. Everything that looks at internal labels sees training folds only.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.transforms import num
from lodestone.operators import metrics, neighbours
from lodestone.operators.deploy import read_json, write_text
from lodestone.operators.learners import forest, tree_spread, with_vector
from lodestone.operators.ranks import percentiles
from lodestone.shared import Scratch

Strategy = Callable[[DataFrame, DataFrame], DataFrame]
COLUMNS = ["compound", "features", "label", "weight"]
_IDS = {"pool_id": "compound", "internal_id": "compound", "vector": "features"}


def _weighted(df: DataFrame, weight=None) -> DataFrame:
    return df.withColumn("weight", num(1) if weight is None else weight).select(*COLUMNS)


def _of(pool: DataFrame, ids: DataFrame, column: str = "pool") -> DataFrame:
    return pool.join(ids.select(F.col(column).alias("compound")).distinct(), "compound", "left_semi")


def near(pool: DataFrame, internal: DataFrame, k: int = 1, of: str = "pool") -> DataFrame:
    return neighbours.nearest(pool, internal, k, of, **_IDS)


def shell(limit: float) -> Strategy:
    return lambda pool, internal: _weighted(_of(pool, neighbours.shell(near(pool, internal), limit)))


def agreeing(limit: float, most: float, k: int = 3) -> Strategy:
    """Within the shell, and with a label near the mean of the k nearest internal ones."""

    def pick(pool: DataFrame, internal: DataFrame) -> DataFrame:
        close = neighbours.shell(near(pool, internal), limit)
        return _weighted(_of(_of(pool, close), _edited(pool, internal, most, k)))

    return pick


def _edited(pool: DataFrame, internal: DataFrame, most: float, k: int = 3) -> DataFrame:
    labels = lambda df: df.select(F.col("compound").alias("id"), "label")
    return neighbours.edited(near(pool, internal, k), labels(pool), labels(internal), most)


def nearest_of(k: int) -> Strategy:
    return lambda pool, internal: _weighted(_of(pool, near(pool, internal, k, "internal")))


def mutual(k: int) -> Strategy:
    return lambda pool, internal: _weighted(_of(pool, neighbours.mutual_nearest(pool, internal, k, **_IDS)))


def edited(most: float) -> Strategy:
    return lambda pool, internal: _weighted(_of(pool, _edited(pool, internal, most)))


def both(a: Strategy, b: Strategy) -> Strategy:
    return lambda pool, internal: _of(a(pool, internal), b(pool, internal), "compound")


def by_distance(weight: Callable) -> Strategy:
    def pick(pool: DataFrame, internal: DataFrame) -> DataFrame:
        dist = near(pool, internal).select(F.col("pool").alias("compound"), "dist")
        return _weighted(pool.join(dist, "compound"), weight(F.col("dist"))).where("weight > 0")

    return pick


def by_domain(seed: int = 42) -> Strategy:
    """Weights by a classifier's odds that a row is an internal one."""

    def pick(pool: DataFrame, internal: DataFrame) -> DataFrame:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import vector_to_array

        rows = pool.select("features", F.lit(0.0).alias("side")).unionByName(internal.select("features", F.lit(1.0).alias("side")))
        model = LogisticRegression(featuresCol="_vector", labelCol="side", regParam=0.1).fit(with_vector(rows))
        p = vector_to_array("probability")[1]
        scored = model.transform(with_vector(pool)).withColumn("weight", p / (num(1) - p + num(1e-6)))
        return scored.select(*COLUMNS)

    return pick


def in_range(tail: float) -> Strategy:
    """Public rows whose label lies between the internal quantiles."""

    def pick(pool: DataFrame, internal: DataFrame) -> DataFrame:
        low, high = percentiles(internal, [], "label", [tail, 1 - tail]).first()[0]
        return _weighted(pool.where(F.col("label").between(low, high)))

    return pick


def no_outliers(reach: float = 1.5) -> Strategy:
    def pick(pool: DataFrame, internal: DataFrame) -> DataFrame:
        low, high = percentiles(pool, [], "label", [0.25, 0.75]).first()[0]
        return _weighted(pool.where(F.col("label").between(low - reach * (high - low), high + reach * (high - low))))

    return pick


def _spread(pool: DataFrame, internal: DataFrame, path: str) -> DataFrame:
    model = forest(trees=10, depth=6).fit(with_vector(internal.select("features", "label")))
    return tree_spread(model, pool, path).drop("pred_y", "low", "up")


def low_uncertainty(path: str) -> Strategy:
    def pick(pool: DataFrame, internal: DataFrame) -> DataFrame:
        scored = _spread(pool, internal, path)
        mid = percentiles(scored, [], "uq_std", [0.5]).first()
        return _weighted(scored.where(F.col("uq_std") <= num(mid[0][0]))) if mid and mid[0][0] is not None else _weighted(pool)

    return pick


def by_uncertainty(path: str, scale: float = 0.5) -> Strategy:
    return lambda pool, internal: _weighted(_spread(pool, internal, path), F.exp(-F.col("uq_std") / num(scale)))


def corrected(mode: str) -> Strategy:
    def pick(pool: DataFrame, internal: DataFrame) -> DataFrame:
        return _weighted(neighbours.correct_bias(pool, internal, mode).withColumn("label", F.col("corrected")))

    return pick


def strategies(path: str) -> dict[str, Strategy]:
    """All strategies by name; path is a shared folder for models."""
    out: dict[str, Strategy] = {"internal_only": lambda pool, internal: _weighted(pool.limit(0)), "all_nvs": lambda pool, internal: _weighted(pool)}
    out |= {f"dist_{int(100 * t):03d}": shell(t) for t in (0.4, 0.5, 0.6, 0.7)}
    out |= {f"knn_{k}": nearest_of(k) for k in (1, 3, 5, 10)} | {f"mnn_{k}": mutual(k) for k in (3, 5, 10)}
    out |= {f"enn_{int(100 * d):03d}": edited(d) for d in (0.3, 0.5, 1.0)}
    out |= {"dist060_agree": agreeing(0.6, 0.5), "knn1_enn": both(nearest_of(1), edited(0.5)), "agree_050": edited(0.5)}
    out |= {"distw": by_distance(lambda d: F.greatest(num(1) - d, num(0))), "expw": by_distance(lambda d: F.exp(-d / num(0.25))), "clfw": by_domain()}
    out |= {"range_00": in_range(0.0), "range_05": in_range(0.05), "noout": no_outliers(), "lowunc": low_uncertainty(f"{path}/lowunc"), "varw": by_uncertainty(f"{path}/varw")}
    return out | {"bias_shift": corrected("shift"), "bias_affine": corrected("affine")}


def predict_fold(pick: Strategy, pool: DataFrame, train: DataFrame, test: DataFrame, make_model: Callable) -> tuple[DataFrame, int]:
    """test's compound, real_y, pred_y by a model of training rows and the picked public rows; and how many these were."""
    scratch = Scratch(train.sparkSession)
    chosen = scratch.save(pick(pool, train))
    rows = with_vector(_weighted(train).unionByName(chosen))
    model = make_model().setWeightCol("weight").setPredictionCol("pred_y").fit(rows)
    out = scratch.save(model.transform(with_vector(test)).select("compound", F.col("label").alias("real_y"), "pred_y"))
    n = chosen.count()
    scratch.drop(chosen)
    return out, n


def evaluate(pick: Strategy, pool: DataFrame, internal: DataFrame, folds: list[int], make_model: Callable) -> dict:
    """n_pool (rows picked, a mean over folds), r2 and r2det of the folds' pooled predictions."""
    parts, picked = [], []
    for f in folds:
        rows = internal.where(F.col("fold").isin(*folds))
        part, n = predict_fold(pick, pool, rows.where(F.col("fold") != f), rows.where(F.col("fold") == f), make_model)
        parts.append(part)
        picked.append(n)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    row = metrics.regression(out, []).first()
    return {"n_pool": round(sum(picked) / len(picked)), "r2": row["r2"], "r2det": row["r2det"]}


def compare(chosen: dict[str, Strategy], pool: DataFrame, internal: DataFrame, learners: dict[str, Callable]) -> list[dict]:
    """A row a strategy: n_pool and, by learner, r2, r2det and seconds; the first learner's best r2det comes first."""
    folds, rows = sorted(r[0] for r in internal.select("fold").distinct().collect()), []
    for name, pick in chosen.items():
        row: dict = {"strategy": name}
        for learner, make in learners.items():
            began = time.perf_counter()
            got = evaluate(pick, pool, internal, folds, make)
            row |= {"n_pool": got["n_pool"], f"{learner}_r2": got["r2"], f"{learner}_r2det": got["r2det"], f"{learner}_sec": round(time.perf_counter() - began, 1)}
        rows.append(row)
    first = f"{next(iter(learners))}_r2det"
    return sorted(rows, key=lambda r: (-(r[first] if r[first] is not None else float("-inf")), r["strategy"]))


def nested(chosen: dict[str, Strategy], pool: DataFrame, internal: DataFrame, make_model: Callable) -> dict:
    """The honest score: each outer fold is predicted by the strategy that is best on the other folds."""
    folds, parts, winners = sorted(r[0] for r in internal.select("fold").distinct().collect()), [], {}
    for f in folds:
        rest = [x for x in folds if x != f]
        scores = {name: evaluate(pick, pool, internal, rest, make_model)["r2det"] for name, pick in chosen.items()}
        best = min(scores, key=lambda n: (-(scores[n] if scores[n] is not None else float("-inf")), n))
        winners[str(f)] = best
        parts.append(predict_fold(chosen[best], pool, internal.where(F.col("fold") != f), internal.where(F.col("fold") == f), make_model)[0])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    row = metrics.regression(out, []).first()
    return {"honest_r2": row["r2"], "honest_r2det": row["r2det"], "fold_winners": winners}


def run_endpoint(endpoint: str, pool: DataFrame, internal: DataFrame, learners: dict[str, Callable], folder: str, names: list[str], tight: list[str] | None = None) -> dict:
    """compare and nested for one endpoint, both written; the summary's record."""
    spark = internal.sparkSession
    record = {"endpoint": endpoint, "n_internal": internal.count(), "n_pool": pool.count()}
    if not record["n_pool"]:
        return {**record, "note": "no public pool"}
    known, first = strategies(f"{folder}/models/{endpoint}"), next(iter(learners))
    rows = compare({n: known[n] for n in names}, pool, internal, learners)
    write_text(spark, f"{folder}/compare_{endpoint}", json.dumps(rows))
    scores = {r["strategy"]: r[f"{first}_r2det"] for r in rows}
    base = scores.get("internal_only")
    record |= {"internal_r2det": base, "augmented_r2det": scores.get("all_nvs"), "best_strategy": rows[0]["strategy"], "best_r2det": rows[0][f"{first}_r2det"]}
    if tight:
        verdict = nested({n: known[n] for n in tight}, pool, internal, learners[first])
        write_text(spark, f"{folder}/nested_{endpoint}", json.dumps({"endpoint": endpoint, "learner": first, "pool": tight, "internal_only_r2det": base, "nested": verdict}))
        record |= {"nested_r2det": verdict["honest_r2det"], "beats_internal": base is not None and verdict["honest_r2det"] is not None and verdict["honest_r2det"] > base, "fold_winners": verdict["fold_winners"]}
    return record


def run(spark: SparkSession, endpoints: list[str], load: Callable[[str], tuple[DataFrame, DataFrame]], learners: dict[str, Callable], folder: str, names: list[str], tight: list[str] | None = None, resume: bool = False) -> tuple[list[dict], dict[str, str]]:
    """(records, errors) over endpoints: an endpoint that fails doesn't stop the others, and the summary is written after each.

    With resume, endpoints that the summary has (and, with a nested search, whose verdict is there) are left out.
    """
    path = lambda at: spark._jvm.org.apache.hadoop.fs.Path(at)
    exists = lambda at: path(at).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(at))
    records = read_json(spark, f"{folder}/summary")["records"] if resume and exists(f"{folder}/summary") else []
    errors: dict[str, str] = {}
    for endpoint in endpoints:
        done = any(r["endpoint"] == endpoint for r in records) and (not tight or exists(f"{folder}/nested_{endpoint}"))
        if resume and done:
            continue
        try:
            pool, internal = load(endpoint)
            record = run_endpoint(endpoint, pool, internal, learners, folder, names, tight)
        except Exception as problem:
            errors[endpoint] = f"{type(problem).__name__}: {problem}"
            continue
        records = [r for r in records if r["endpoint"] != endpoint] + [record]
        write_text(spark, f"{folder}/summary", json.dumps({"records": records}))
    return records, errors


VERDICT = ["endpoint", "n_internal", "n_pool", "augmented_r2det", "internal_r2det", "best_strategy", "best_r2det", "nested_r2det", "beats_internal"]


def verdict_table(records: list[dict]) -> list[dict]:
    """The records' columns of the verdict, those that any record has."""
    columns = [c for c in VERDICT if any(c in r for r in records)]
    return [{c: r.get(c) for c in columns} for r in records]


def greedy_groups(groups: list[str], score: Callable[[list[str]], float], forward: bool = True) -> tuple[list[str], float]:
    """Groups (scaffolds) added one by one while the score rises, or taken away from all; ties go to the earlier group."""
    chosen = [] if forward else list(groups)
    best = score(chosen)
    while True:
        moves = [[*chosen, g] if forward else [x for x in chosen if x != g] for g in groups if (g in chosen) != forward]
        scored = [(score(m), -i) for i, m in enumerate(moves)]
        if not scored or max(scored)[0] <= best:
            return chosen, best
        best, i = max(scored)
        chosen = moves[-i]


#: Open links that one task settles at once.
FEW_LINKS = 2**20


def _settled(links: pa.Table) -> pa.Table:
    """Rows a that a centre before them takes, of links a, b (b before a) of open rows: centres are those with nothing open before them."""
    names, at = np.unique(np.concatenate([links["a"].to_numpy(), links["b"].to_numpy()]), return_inverse=True)
    a, b = at[: links.num_rows], at[links.num_rows :]
    gone = np.zeros(len(names), bool)
    while len(a):
        waits = np.zeros(len(names), bool)
        waits[a] = True
        gone[a[~waits[b]]] = True
        open_ = ~(gone[a] | gone[b])
        a, b = a[open_], b[open_]
    return pa.table({"a": pa.array(names[gone])})


def butina(ids: DataFrame, links: DataFrame, id_col: str = "compound", once: bool = False, few: int = FEW_LINKS) -> DataFrame:
    """(id, cluster): the row with most neighbours takes all its neighbours, then the next one that is left, and so on.

    links: pairs a, b within the distance; once: each pair is there in one order and once. A row is a centre if no neighbour
    before it in that order is one; this is settled in rounds on tables, so no task holds all rows, and a round reads only
    links of rows that were both open after the last; once `few` are left, one task settles them. Ties go to the smaller id; rows without links are their own.
    """
    scratch = Scratch(ids.sparkSession)
    pairs = links.where("a <> b").select("a", "b")
    one = scratch.save(pairs if once else pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())  # what finds the links runs once
    degree = scratch.save(one.select("a").union(one.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("d")))
    both = one.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    first = F.expr("d > e or (d = e and a < b)")  # a comes before b
    before = both.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("d", "e").alias("d"))
    before = scratch.save(before)  # a row a link: b comes before a and has d neighbours
    scratch.drop(one)
    live, left, centres = before.select("a", "b"), degree.select("a"), []
    while live.count() > few:
        new = scratch.save(left.join(live.select("a").distinct(), "a", "left_anti"))  # nothing open comes before them
        centres.append(new)
        taken = scratch.save(live.join(new.select(F.col("a").alias("b")), "b", "left_semi").select("a").distinct())
        after = scratch.save(left.join(new, "a", "left_anti").join(taken, "a", "left_anti"))
        rest = scratch.save(live.join(taken, "a", "left_anti").join(taken.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"))
        scratch.drop(taken, *((left, live) if len(centres) > 1 else ()))
        left, live = after, rest
    taken = live.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(_settled, f"a {live.schema['a'].dataType.simpleString()}")
    centres.append(left.join(scratch.save(taken), "a", "left_anti"))
    found = centres[0]
    for x in centres[1:]:
        found = found.union(x)
    found = scratch.save(found)
    rank = F.struct((-F.col("d")).alias("d"), F.col("b").alias("i"))
    taken = before.join(found.select(F.col("a").alias("b")), "b").groupBy("a").agg(F.min(rank).alias("r")).select(F.col("a").alias("_id"), F.col("r.i").alias("_centre"))
    return ids.select(id_col).join(taken, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("_centre", id_col).alias("cluster"))
