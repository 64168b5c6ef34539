"""Scoring an upload against served models, with a progress feed; startup checks."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import Endpoint
from lodestone.functions.transforms import confidence, favorable, inverse, num


def run_id() -> str:
    return secrets.token_urlsafe(18)


def missing_models(required: list[str], loaded: list[str]) -> list[str]:
    return [x for x in required if x not in loaded]


def check_startup(required: list[str], loaded: list[str], strict: bool = True) -> list[str]:
    gaps = missing_models(required, loaded)
    if gaps and strict:
        raise RuntimeError(f"no models for {gaps}")
    return gaps


def override(df: DataFrame, endpoint: str, other: str) -> DataFrame:
    """Another model's value where it has one; the confidence stays."""
    return df.withColumn(f"{endpoint}_pred", F.coalesce(other, f"{endpoint}_pred"))


def score(df: DataFrame, endpoints: list[Endpoint], models: dict[str, Callable[[DataFrame], DataFrame]], calibration: dict[str, dict[str, float]], featurise: Callable[[DataFrame], DataFrame]) -> Iterator[tuple[str, int, int, DataFrame]]:
    """(label, done, total, frame) after each step; the last frame has each endpoint's value, confidence and call.

    A model adds pred_y and uq_std (modelling space); rows it can't score stay with nulls.
    """
    total = 2 + len(models)
    out = featurise(df)
    yield "features", 1, total, out
    for k, e in enumerate([x for x in endpoints if x.name in models], 2):
        out = models[e.name](out)
        c = calibration[e.name]
        conf = confidence(F.col("uq_std"), num(c["rmse_cv"]), num(c["recal_a"]), num(c["recal_b"])) if "recal_a" in c else confidence(F.col("uq_std"), num(c["label_std"]))
        value = inverse(e.transform, F.col("pred_y"))
        out = out.withColumns({f"{e.name}_pred": value, f"{e.name}_confidence": conf, f"{e.name}_favorable": favorable(value, e.cutoff, e.sign)}).drop("pred_y", "uq_std", "low", "up")
        yield e.name, k, total, out
    yield "table", total, total, out


def progress(steps: Iterator[tuple[str, int, int, DataFrame]], finish: Callable[[DataFrame], object]) -> Iterator[str]:
    """NDJSON lines: the steps, then the result or the error."""
    frame = None
    try:
        for label, done, total, frame in steps:
            yield json.dumps({"label": label, "done": done, "total": total}) + "\n"
        yield json.dumps({"result": finish(frame)}) + "\n"
    except Exception as e:  # the client reads the error from the feed
        yield json.dumps({"error": str(e)}) + "\n"


def read_progress(lines: Iterator[str]) -> dict:
    """The result of a feed; raises its error, or if it ended without either."""
    for line in lines:
        message = json.loads(line)
        if "error" in message:
            raise RuntimeError(message["error"])
        if "result" in message:
            return message["result"]
    raise RuntimeError("the feed ended without a result")
