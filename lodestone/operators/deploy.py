"""Fitting and registering the models that are served: five calibration fits whose models are thrown away, one on all rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Endpoint
from lodestone.operators import calibration, metrics
from lodestone.operators.arms import Arm, predict
from lodestone.operators.learners import Transfer, tree_spread, with_vector
from lodestone.operators.registry import Registry, resolve, unpinned_notice
from lodestone.shared import Scratch

AUGMENTED = Arm("augmented_cv", "folds", True, True)


@dataclass
class Summary:
    endpoint: str
    n_train: int
    sources: list[str]
    calibration: dict[str, float] = field(default_factory=dict)
    cv_rmse: float | None = None
    cv_r2: float | None = None
    model_id: int | None = None
    version: int | None = None
    artifact: str | None = None
    meta: dict = field(default_factory=dict)
    notice: str | None = None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any file system."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def calibrate(predictions: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """The calibration of held-out predictions, and their metrics."""
    row = calibration.parameters(predictions, []).first()
    numbers = metrics.regression(predictions, []).first()
    return {k: float(row[k] if row[k] is not None else 0.0) for k in ("rmse_cv", "recal_a", "recal_b", "label_std")}, {"rmse": numbers["rmse"], "r2": numbers["r2"], "r2det": numbers["r2det"]}


def _register(registry: Registry | None, out: Summary, name: str, framework: str, pin: int | None, values: dict, training: DataFrame, dry_run: bool) -> Summary:
    if dry_run or registry is None:
        return out
    known = resolve(registry.table(), name, pin)
    out.model_id, out.version = registry.add(name, framework, out.endpoint, {k: v for k, v in values.items() if v is not None}, out.artifact, known, training)
    out.notice = None if pin is not None else unpinned_notice(framework, out.endpoint, out.model_id)
    return out


def deploy_endpoint(e: Endpoint, internal: DataFrame, public: DataFrame, make_model: Callable, path: str, registry: Registry | None = None, pin: int | None = None, dry_run: bool = False, k: int = 5, suffix: str = "") -> Summary:
    """A forest on internal and public rows (compound, smiles, label, features, origin; internal ones with fold).

    k fits predict each internal fold from the others and all public rows, and calibrate the confidence; one more on all
    rows is saved with the calibration and registered as the next version of <endpoint><suffix>.
    """
    spark = internal.sparkSession
    held = Scratch(spark).save(predict(AUGMENTED, internal, public, make_model, path, k))
    numbers, cv = calibrate(held)
    train = internal.unionByName(public, allowMissingColumns=True).select("compound", "smiles", "label", "features")
    model = make_model().fit(with_vector(train.select("features", "label")))
    sources = ["internal", *sorted(r[0] for r in public.select("origin").distinct().collect())]
    out = Summary(e.name, train.count(), sources, numbers, cv["rmse"], cv["r2"])
    if dry_run:
        return out
    out.artifact = f"{path}/{e.name}{suffix}"
    model.write().overwrite().save(f"{out.artifact}/model")
    out.meta = {"endpoint": e.name, "transform": e.transform, "unit": e.unit, "sources": sources, "n_train": out.n_train, "calibration": numbers}
    write_text(spark, f"{out.artifact}/meta", json.dumps(out.meta))
    values = {"rmse_cv": numbers["rmse_cv"], "r2_cv": cv["r2"], "recal_a": numbers["recal_a"], "recal_b": numbers["recal_b"]}
    return _register(registry, out, f"{e.name}{suffix}", "rf", pin, values, train.select("compound", "smiles", "label"), dry_run)


def deploy_transfer(e: Endpoint, internal: DataFrame, public: DataFrame, path: str, registry: Registry | None = None, pin: int | None = None, dry_run: bool = False, grouping: str = "all", tasks: list[str] | None = None, force: bool = False, seed: int = 42) -> Summary:
    """A head on all internal rows over a representation of public ones, which is kept by grouping and used again unless forced.

    It gives values only: the confidence stays the forest's.
    """
    spark, kept, tasks = internal.sparkSession, f"{path}/pretrained/{grouping}", tasks or [e.name]
    at = spark._jvm.org.apache.hadoop.fs.Path(kept)
    if force or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        Transfer.represent(public, seed).with_head(public).save(kept)
    model = Transfer.load(kept).with_head(internal)
    out = Summary(e.name, internal.count(), ["internal"], artifact=f"{path}/{e.name}_transfer")
    out.meta = {"endpoint": e.name, "grouping": grouping, "tasks": tasks, "target_index": tasks.index(e.name), "transform": e.transform, "unit": e.unit, "n_train": out.n_train, "seed": seed, "pretrained": kept, "confidence": "rf"}
    model.save(f"{out.artifact}/model")
    write_text(spark, f"{out.artifact}/meta", json.dumps(out.meta))
    return _register(registry, out, f"{e.name}_transfer", "transfer", pin, {"n_train": out.n_train}, internal.select("compound", "smiles", "label"), dry_run)


def deploy_all(endpoints: list[Endpoint], build: Callable[[Endpoint], tuple[DataFrame, DataFrame]], deploy: Callable[..., Summary], registry: Registry | None, pins: dict[str, int | None] | None = None, **options) -> list[Summary]:
    """deploy for every endpoint with the internal and public rows that build gives."""
    out = []
    for e in endpoints:
        internal, public = build(e)
        out.append(deploy(e, internal, public, registry=registry, pin=(pins or {}).get(e.name), **options))
    return out


@dataclass
class Bound:
    """A served model: what scores rows, and what the roster says of it."""

    model_id: int
    apply: Callable[[DataFrame], DataFrame]
    calibration: dict[str, float]
    meta: dict


def bind(registry: Registry, pins: dict[str, int | None], path: str) -> tuple[dict[str, Bound], list[str]]:
    """The forests of the pinned ids, and warnings; an endpoint without a usable pin is left out, as it has no confidence.

    Without a calibration the scale is the standard deviation of the archived training labels, or 1.
    """
    from pyspark.ml.regression import RandomForestRegressionModel

    out, warnings = {}, []
    for endpoint, model_id in pins.items():
        if model_id is None:
            warnings.append(f"{endpoint}: no pin")
            continue
        try:
            row = registry.details(int(model_id))
            model, meta = RandomForestRegressionModel.load(f"{row['artifact']}/model"), read_json(registry.spark, f"{row['artifact']}/meta")
        except Exception as problem:  # a model that is gone must not stop the others
            warnings.append(f"{endpoint}: id {model_id} unavailable ({type(problem).__name__})")
            continue
        numbers = meta.get("calibration")
        if not numbers:
            try:
                numbers = {"label_std": float(registry.training_set(row["id"]).agg(F.stddev_samp("label")).first()[0] or 1.0)}
            except Exception as problem:
                numbers = {"label_std": 1.0}
                warnings.append(f"{endpoint}: no training labels ({type(problem).__name__})")
        score = lambda df, m=model, at=f"{path}/{endpoint}": tree_spread(m, df, at)
        out[endpoint] = Bound(int(model_id), score, numbers, meta)
    return out, warnings


def bind_values(registry: Registry, wanted: dict[str, str], pins: dict[str, int | None]) -> tuple[dict[str, Bound], list[str]]:
    """Transfer models of the endpoints whose value they give; what can't be bound keeps the forest's value."""
    out, warnings = {}, [f"{e}: unsupported model {m!r}" for e, m in wanted.items() if m not in ("rf", "transfer", "forest")]
    for endpoint in [e for e, m in wanted.items() if m == "transfer"]:
        try:
            row = registry.details(int(pins[endpoint]))
            model, meta = Transfer.load(f"{row['artifact']}/model"), read_json(registry.spark, f"{row['artifact']}/meta")
        except Exception as problem:
            warnings.append(f"{endpoint}: transfer model unavailable ({type(problem).__name__}); the forest's value stays")
            continue
        out[endpoint] = Bound(int(row["id"]), model.predict, {}, meta)
    return out, warnings


def extra_columns(df: DataFrame, classifiers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The rows with <key>_pred, the probability of the positive class, of classifiers that stay out of the score's formula."""
    for key, score in classifiers.items():
        df = score(df).withColumn(f"{key}_pred", F.col("proba")).drop("proba", "prediction", "probability", "rawPrediction", "_vector")
    return df


def roster(endpoints: list[Endpoint], forests: dict[str, Bound], values: dict[str, Bound], extras: list[dict] | None = None, order: list[str] | None = None, slope: float = 2.0) -> dict:
    """What the grid is told of its columns: endpoints in display order, then extra classifiers."""
    known = {e.name: e for e in endpoints if e.name in forests}
    names = [n for n in order or [] if n in known] + [n for n in known if n not in (order or [])]
    rows = []
    for n in names:
        e = known[n]
        rows.append({"key": n, "unit": e.unit, "cutoff": e.cutoff, "favorable": e.sign, "transform": e.transform, "color_slope": slope, "model_id": forests[n].model_id, "value_model": "transfer" if n in values else "rf", "value_model_id": (values.get(n) or forests[n]).model_id, "confidence_model_id": forests[n].model_id})
    more = [{"key": x["key"], "label": x.get("label", x["key"]), "unit": x.get("unit", ""), "cutoff": x.get("threshold", 0.5), "favorable": ">=", "kind": "classification", "transform": "identity", "color_slope": x.get("color_slope", 8.0), "model_id": x["model_id"]} for x in extras or []]
    return {"endpoints": rows, "extras": more}


def filter_fields(told: dict) -> list[tuple[str, str]]:
    """(field, label) of all that a filter term may name: the score, values and confidences, extra values."""
    out = [("mpo", "MPO")]
    for e in told["endpoints"]:
        out += [(f"{e['key']}_pred", e["key"]), (f"{e['key']}_confidence", f"{e['key']} confidence")]
    return out + [(f"{e['key']}_pred", e["label"]) for e in told["extras"]]


def select_all(df: DataFrame, visible, on: bool, selected: str = "selected") -> DataFrame:
    """Selects or clears the visible rows only; the others stay as they are."""
    return df.withColumn(selected, F.when(visible, F.lit(on)).otherwise(F.col(selected)))


def selection_state(df: DataFrame, visible, selected: str = "selected") -> str:
    """all, some or none of the visible rows."""
    row = df.where(visible).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(selected)).alias("k")).first()
    return "none" if not row["k"] else "all" if row["k"] == row["n"] else "some"
