"""Prediction arms: one runner driven by a table of arms, cross-validated or single-block, with metrics and stores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.operators.calibration import with_arm_confidence
from lodestone.operators.learners import Transfer, tree_spread, with_vector
from lodestone.shared import Scratch
from lodestone.sources.sinks import commit, committed


@dataclass(frozen=True)
class Arm:
    """Train and test rows of each split: `public` adds public rows to training, `internal` internal ones."""

    name: str
    blocks: str  # "folds" or "temporal" or "all"
    internal: bool
    public: bool


ARMS = (
    Arm("ext_to_internal", "all", False, True), Arm("internal_cv", "folds", True, False), Arm("augmented_cv", "folds", True, True),
    Arm("internal_temporal", "temporal", True, False), Arm("augmented_temporal", "temporal", True, True), Arm("ext_to_temporal", "temporal", False, True),
)


def blocks(arm: Arm, internal: DataFrame, public: DataFrame, k: int):
    """(fold, train, test) of each split; internal rows carry `fold` and `role`."""
    pick = lambda rows: (rows if arm.internal else rows.limit(0)).unionByName(public, allowMissingColumns=True) if arm.public else rows
    if arm.blocks == "folds":
        for f in range(1, k + 1):
            yield f, pick(internal.where(F.col("fold") != f)), internal.where(F.col("fold") == f)
    elif arm.blocks == "temporal":
        yield 1, pick(internal.where("role = 'train'")), internal.where("role = 'test'")
    else:
        yield 1, pick(internal), internal


def predict(arm: Arm, internal: DataFrame, public: DataFrame, make_model: Callable, path: str, k: int = 5) -> DataFrame:
    """compound, real_y, pred_y, uq_std, low, up, fold, residuals of all splits; each fit is distributed, splits come in turn."""
    out = None
    for fold, train, test in blocks(arm, internal, public, k):
        model = make_model().fit(with_vector(train.select("features", "label")))
        part = tree_spread(model, test.select("compound", F.col("label").alias("real_y"), "features"), f"{path}/{arm.name}-{fold}").drop("features")
        part = part.withColumn("fold", F.lit(fold)).withColumn("residuals", F.abs(F.col("real_y") - F.col("pred_y")))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("arm", F.lit(arm.name))


def assess(internal: DataFrame, public: DataFrame, make_model: Callable, path: str, arms: tuple[Arm, ...] = ARMS, k: int = 5) -> DataFrame:
    """All arms' predictions; arms that need public rows are left out where there are none."""
    some = public.limit(1).count() > 0
    out = None
    for arm in arms:
        if some or not arm.public:
            part = predict(arm, internal, public, make_model, path, k)
            out = part if out is None else out.unionByName(part)
    return out


def assess_with_confidence(internal: DataFrame, public: DataFrame, make_model: Callable, path: str, arms: tuple[Arm, ...] = ARMS, k: int = 5) -> DataFrame:
    """All arms' predictions with leakage-controlled confidences, written once and read back."""
    rows = Scratch(internal.sparkSession).save(assess(internal, public, make_model, path, arms, k))
    return with_arm_confidence(rows.withColumn("endpoint", F.lit("")), ["endpoint"]).drop("endpoint")


def scan_origins(public: DataFrame, internal: DataFrame, origins: list[str], make_model: Callable, path: str, most: int = 10) -> DataFrame:
    """Every non-empty subset of the origins scored by what its rows tell of internal ones, the best squared correlation first.

    Subsets are fitted in turn; more than `most` origins raise, as 2 ** most fits are no scan any more.
    """
    if len(origins) > most:
        raise ValueError(f"{len(origins)} origins have too many subsets")
    combos = [list(c) for n in range(1, len(origins) + 1) for c in combinations(origins, n)]
    scores = None
    for i, combo in enumerate(combos):
        one = transfer_score(public, internal, combo, make_model, f"{path}/combo-{i}")
        scores = one if scores is None else scores.unionByName(one)
    return scores.orderBy(F.desc_nulls_last("R2_pears"), "combo")


def transfer_arms(internal: DataFrame, public: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """compound, real_y, pred_y, fold, arm of three arms on the same folds: representation of public rows with a head on the
    training folds (augmented_cv), all of it on the training folds (internal_cv), and all of it on public rows (ext_to_internal)."""
    shown = lambda df, fold, arm: df.select("compound", F.col("label").alias("real_y"), "pred_y", F.lit(fold).alias("fold"), F.lit(arm).alias("arm"))
    base, out = Transfer.represent(public, seed), []
    for f in range(1, k + 1):
        train, test = internal.where(F.col("fold") != f), internal.where(F.col("fold") == f)
        out.append(shown(base.with_head(train).predict(test), f, "augmented_cv"))
        out.append(shown(Transfer.represent(train, seed).with_head(train).predict(test), f, "internal_cv"))
    out.append(shown(base.with_head(public).predict(internal), 1, "ext_to_internal"))
    rows = out[0]
    for df in out[1:]:
        rows = rows.unionByName(df)
    return rows.withColumn("residuals", F.abs(F.col("real_y") - F.col("pred_y")))


def winner_table(stores: dict[str, DataFrame], arms: tuple[str, ...] = ("ext_to_internal", "internal_cv", "augmented_cv"), nested: DataFrame | None = None, metric: str = "r2", groupings: DataFrame | None = None) -> DataFrame:
    """A row an endpoint with, for each arm, the best method's value and its name, and a note on the augmented arm.

    stores: method -> endpoint, arm and metrics (the first method always competes and decides which endpoints have a
    row); nested: endpoint and honest value, a candidate of the augmented arm only; groupings: endpoint, grouping.
    """
    rows = None
    for place, (method, store) in enumerate(stores.items()):
        one = store.where(F.col("arm").isin(*arms)).select("endpoint", "arm", F.lit(method).alias("method"), F.col(metric).alias("value"), F.lit(place).alias("place"))
        rows = one if rows is None else rows.unionByName(one)
    if nested is not None:
        rows = rows.unionByName(nested.select("endpoint", F.lit("augmented_cv").alias("arm"), F.lit("near-shell").alias("method"), F.col("honest").alias("value"), F.lit(len(stores)).alias("place")))
    best = rows.where("value is not null").groupBy("endpoint", "arm").agg(F.max(F.struct("value", (-F.col("place")).alias("order"), "method")).alias("b"))
    cells = [x for a in arms for x in (F.max(F.when(F.col("arm") == a, F.col("b.value"))).alias(a), F.max(F.when(F.col("arm") == a, F.col("b.method"))).alias(f"{a}_by"))]
    first = list(stores)[0]
    endpoints = stores[first].select("endpoint").distinct()
    out = endpoints.join(best.groupBy("endpoint").agg(*cells), "endpoint", "left")
    grouping = F.lit(None).cast("string")
    if groupings is not None:
        out, grouping = out.join(groupings.select("endpoint", "grouping"), "endpoint", "left"), F.col("grouping")
    note = F.when(F.col("augmented_cv_by") == first, "all public").when(F.col("augmented_cv_by") == "near-shell", "dist060_agree").otherwise(grouping)
    return out.withColumn("note", note).drop("grouping")


def confidence_across_arms(frames: dict[str, DataFrame], confidence: str = "conf_recal") -> DataFrame:
    """setting, endpoint, compound, residual, confidence of several prediction tables, one below the other."""
    out = None
    for setting, df in frames.items():
        one = df.where(F.col(confidence).isNotNull()).select(F.lit(setting).alias("setting"), "endpoint", F.col("compound").cast("string").alias("compound"), F.abs(F.col("real_y") - F.col("pred_y")).alias("residual"), F.col(confidence).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


def transfer_score(public: DataFrame, internal: DataFrame, combo: list[str], make_model: Callable, path: str) -> DataFrame:
    """One origin combination's score on all internal rows."""
    train = public.where(F.col("origin").isin(combo))
    part = predict(Arm("combo", "all", False, True), internal, train, make_model, path)
    return metrics.regression(part, ["arm"]).select(F.lit("+".join(x.split(":")[-1] for x in combo)).alias("combo"), F.lit(train.count()).alias("n_train"), F.col("r2").alias("R2_pears"), F.col("r2det").alias("R2_det"), F.col("rmse").alias("RMSE"))


def compute_or_load(spark, table: str, endpoint: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """An endpoint's part of a result table; computed and written (only that partition) where it is missing.

    The part is written beside the table and moved in whole, so a run that ends halfway leaves nothing that a later one
    takes for a result; a folder without the writer's mark of success is computed again.
    """
    path = f"{table}/endpoint={endpoint}"
    if not committed(spark, path):
        commit(compute(), path)
    return spark.read.parquet(path).withColumn("endpoint", F.lit(endpoint))
