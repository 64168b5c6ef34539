"""Queries that fit models; SQL can't express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import Endpoint
from lodestone.functions.keys import featurise
from lodestone.operators import arms, deploy, learners, nearshell
from lodestone.operators import metrics as m
from lodestone.operators import splits as sp
from lodestone.plans.catalog import compounds, query, rounded, table
from lodestone.shared import Scratch, shared_dir
from lodestone.streaming import events as ev
from lodestone.streaming import runs as rs


def folder(s) -> str:
    """A folder that all executors share, for models."""
    import uuid

    return f"{shared_dir(s)}/models-{uuid.uuid4().hex}"


def vectors(s, d):
    """Embeddings as compounds: a label made of the components, public but for a tenth of the rows."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("compound"), F.col("embedding").cast("array<double>").alias("features"), F.concat(F.lit("o"), F.col("label") % 3).alias("origin"), (F.col("label") >= 5).cast("int").alias("class"))
    label = F.expr("features[0] * 2 + features[1] - features[2] * features[3]")
    return v.withColumn("label", label).withColumn("source", F.when(F.col("compound") % 4 == 0, "internal").otherwise("EXP"))


def pools(s, d):
    v = vectors(s, d)
    internal = sp.group_folds(v.where("source = 'internal'"), "compound", k=3)
    role = sp.temporal(internal.select("compound"), "compound").select("compound", "role")
    return internal.join(role, "compound"), v.where("source <> 'internal'")


def small_forest():
    return learners.forest(trees=12, depth=6)


@query("rf_uq")
def rf_uq(s, d):
    internal, public = pools(s, d)
    model = small_forest().fit(learners.with_vector(public.select("features", "label")))
    return learners.tree_spread(model, internal.select("compound", "label", "features"), folder(s)).drop("features")


@query("assess_arms")
def assess_arms(s, d):
    internal, public = pools(s, d)
    return rounded(m.regression(arms.assess(internal, public, small_forest, folder(s), k=3), ["arm"]), "rmse", "r2det")


@query("transfer_combo")
def transfer_combo(s, d):
    internal, public = pools(s, d)
    return arms.transfer_score(public, internal, ["o0", "o1"], small_forest, folder(s))


@query("gbt_classifier")
def gbt_classifier(s, d):
    v = sp.group_folds(vectors(s, d), "compound", k=3)
    train = learners.balanced(learners.with_vector(v.where("fold <> 1")).select("_vector", "class"))
    out = learners.probabilities(v.where("fold = 1"), learners.boosted_classifier(8, 4).fit(train))
    return out.select("compound", "class", "proba", F.col("prediction").cast("int").alias("call"))


@query("tree_classifier")
def tree_classifier(s, d):
    c = featurise(compounds(s, d).withColumnRenamed("text", "smiles").withColumn("class", (F.col("lang") == "en").cast("int")), "H237")
    kept = Scratch(s)
    c = kept.save(c.select("doc_id", "_sk", "class", "features"))  # texts are read, keyed and featurised once
    folded = kept.save(sp.stratified_group_folds(c, "_sk", "class"))
    model = learners.tree_classifier(8).fit(learners.with_vector(folded.where("fold <> 1")))
    out = learners.probabilities(folded.where("fold = 1").select("doc_id", "class", "features"), model)
    return m.triage(out, [], F.col("class") == 1, F.col("proba") >= 0.5)


@query("transfer_arm")
def transfer_arm(s, d):
    internal, public = pools(s, d)
    out = learners.transfer(public, internal.where("fold <> 1"), internal.where("fold = 1"))
    return out.select("compound", F.col("label").alias("real_y"), "pred_y")


@query("windowed_event_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY ALL")
def windowed_event_counts(s, d):
    return rounded(ev.windowed_counts(table(s, d, "events")), "mean")


@query("streamed_event_counts")
def streamed_event_counts(s, d):
    import uuid

    name = f"counts_{uuid.uuid4().hex[:8]}"
    return ev.run_once(ev.windowed_counts(ev.event_stream(s, f"{d}/events.parquet*")), name, folder(s))


@query("run_store_stream", "SELECT owner, run_id, ts, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, run_id) AS place FROM (SELECT user_id::VARCHAR AS owner, event_id::VARCHAR AS run_id, ts FROM events WHERE epoch_ms((SELECT max(ts) FROM events)) * 1000 - epoch_us(ts) <= 864000000000) QUALIFY place <= 5")
def run_store_stream(s, d):
    """The events as runs of their users, streamed through the keyed store: who is live when the stream ends."""
    runs = ev.event_stream(s, f"{d}/events.parquet*").select(F.col("user_id").alias("owner"), F.col("event_id").alias("run_id"), "ts")
    return rs.live(rs.replay(s, runs, 5, 10 * 86400, folder(s)))


@query("forest_classifier")
def forest_classifier(s, d):
    """A forest that calls a class from a probability of 0.3 on: how held-out rows are called."""
    v = sp.stratified_group_folds(vectors(s, d).withColumn("group", F.concat("origin", (F.col("compound") % 50).cast("string"))), "group", "class", k=3)
    model = learners.forest_classifier(12, 6, cut=0.3).fit(learners.with_vector(v.where("fold <> 1")))
    out = learners.probabilities(v.where("fold = 1"), model)
    return out.select("compound", "class", "proba", F.col("prediction").cast("int").alias("call"))


@query("boosted_screen")
def boosted_screen(s, d):
    """The boosted screen learner on public rows, scored on internal ones."""
    internal, public = pools(s, d)
    model = learners.boosted(10, 4).fit(learners.with_vector(public.select("features", "label")))
    scored = model.transform(learners.with_vector(internal)).select(F.col("label").alias("real_y"), F.col("prediction").alias("pred_y"))
    return rounded(m.regression(scored, []), "rmse", "r2det")


@query("deploy_calibration")
def deploy_calibration(s, d):
    """What a deployment would store: the calibration of held-out predictions of all folds, and what the final model is fitted on."""
    internal, public = (df.withColumn("smiles", F.concat(F.lit("s"), F.col("compound").cast("string"))) for df in pools(s, d))
    done = deploy.deploy_endpoint(Endpoint("sol", "x", "log10", unit="uM", cutoff=10.0), internal, public, small_forest, folder(s), dry_run=True, k=3)
    return s.createDataFrame([(done.n_train, float(done.cv_rmse), *[float(done.calibration[c]) for c in ("rmse_cv", "recal_a", "recal_b", "label_std")])], "n_train bigint, cv_rmse double, rmse_cv double, recal_a double, recal_b double, label_std double")


@query("near_shell_compare")
def near_shell_compare(s, d):
    """Strategies of adding public rows, each scored by folds of the internal rows."""
    internal, public = pools(s, d)
    known = nearshell.strategies(folder(s))
    rows = nearshell.compare({n: known[n] for n in ("internal_only", "all_nvs", "dist_060")}, public, internal, {"rf": small_forest})
    return s.createDataFrame([(r["strategy"], r["n_pool"], r["rf_r2"], r["rf_r2det"]) for r in rows], "strategy string, n_pool bigint, rf_r2 double, rf_r2det double")


@query("near_shell_nested")
def near_shell_nested(s, d):
    """The honest score: each fold is predicted by the strategy that is best on the others."""
    internal, public = pools(s, d)
    known = nearshell.strategies(folder(s))
    got = nearshell.nested({n: known[n] for n in ("internal_only", "all_nvs")}, public, internal, small_forest)
    return s.createDataFrame([(f, w, got["honest_r2"], got["honest_r2det"]) for f, w in sorted(got["fold_winners"].items())], "fold string, strategy string, honest_r2 double, honest_r2det double")
