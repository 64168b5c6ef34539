"""Command line: python -m lodestone.cli --config FILE --data FOLDER [--assess] [--assess-transfer] [--deploy] ...

The data folder has internal.parquet (name, smiles and the endpoints' raw columns), features.parquet (compound, features)
and, where there are public rows, public_<endpoint>.parquet of the contract compound, smiles, value, origin.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Endpoint, Settings, load_settings
from lodestone.functions.transforms import clip_upper, finite, forward_value
from lodestone.operators import arms, learners, metrics, nearshell, splits
from lodestone.operators.assembly import internal_block, public_block
from lodestone.operators.deploy import deploy_all, deploy_endpoint, deploy_transfer
from lodestone.operators.registry import Registry
from lodestone.operators.relational import drop_twins, prefer_source, with_keys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestone", description="Assess and deploy endpoint models.")
    out.add_argument("--config", required=True, help="YAML settings")
    out.add_argument("--data", required=True, help="folder of internal, features and public tables")
    out.add_argument("--out", required=True, help="folder of results, models and the registry")
    out.add_argument("--endpoints", default="all", help="comma list, or all")
    out.add_argument("--leak", default="exact", choices=["exact", "skeleton", "none"], help="drop public rows whose molecule is internal too")
    out.add_argument("--overwrite", action="store_true", help="compute results that are there already")
    out.add_argument("--assess", action="store_true", help="all forest arms of every endpoint")
    out.add_argument("--assess-transfer", action="store_true", help="the three transfer arms of every endpoint")
    out.add_argument("--deploy", action="store_true", help="fit, calibrate and register a forest for every endpoint")
    out.add_argument("--deploy-transfer", action="store_true", help="fit and register a transfer model for every endpoint")
    out.add_argument("--nearshell", action="store_true", help="compare strategies of choosing public rows")
    out.add_argument("--resume", action="store_true", help="leave out endpoints that the near-shell summary has")
    out.add_argument("--dry-run", action="store_true", help="fit, but register nothing")
    out.add_argument("--trees", type=int, default=200)
    out.add_argument("--depth", type=int, default=20)
    return out


def frames(spark: SparkSession, settings: Settings, folder: str, e: Endpoint, leak: str) -> tuple[DataFrame, DataFrame]:
    """An endpoint's internal rows (with fold and role) and public rows, both with features and a finite, capped label."""
    features = spark.read.parquet(f"{folder}/features.parquet").select("compound", "features")
    whole = lambda df: df.withColumn("label", clip_upper(F.col("label"), None if e.cap is None else forward_value(e.transform, e.cap))).where(finite(F.col("label"))).join(features, "compound")
    internal = prefer_source(whole(internal_block(spark.read.parquet(f"{folder}/internal.parquet"), e)), ["smiles"], F.col("source"), "internal", [F.col("compound")])
    internal = with_keys(internal, "smiles")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/public_{e.name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        public = with_keys(whole(public_block(spark.read.parquet(str(path)), e)), "smiles")
        public = drop_twins(public, internal, "_ik", leak)
    else:
        public = internal.limit(0)
    folded = splits.group_folds(internal, "compound", F.col("_ik") if settings.group_folds else None, settings.n_folds, settings.seed)
    role = splits.temporal(internal.select("compound"), "compound", settings.train_share)
    return folded.join(role, "compound"), public


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs what the flags ask for; a table of results by name, which is printed as JSON too."""
    args = parser().parse_args(argv)
    spark, settings = spark or SparkSession.builder.getOrCreate(), load_settings(args.config)
    chosen = [e for e in settings.endpoints if args.endpoints == "all" or e.name in args.endpoints.split(",")]
    make = lambda: learners.forest(args.trees, args.depth, seed=settings.seed)
    build = lambda e: frames(spark, settings, args.data, e, args.leak)
    out: dict = {}

    def stored(name: str, e: Endpoint, compute) -> DataFrame:
        at = f"{args.out}/{name}"
        if args.overwrite:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/endpoint={e.name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return arms.compute_or_load(spark, at, e.name, compute)

    for flag, name, compute in ((args.assess, "assess", lambda e: arms.assess_with_confidence(*build(e), make, f"{args.out}/models/{e.name}", k=settings.n_folds)), (args.assess_transfer, "assess_transfer", lambda e: arms.transfer_arms(*build(e), settings.n_folds, settings.seed))):
        if flag:
            tables = [metrics.regression(stored(name, e, lambda e=e: compute(e)), ["endpoint", "arm"]) for e in chosen]
            out[name] = [r.asDict() for t in tables for r in t.orderBy("arm").collect()]
    if args.deploy or args.deploy_transfer:
        registry = None if args.dry_run else Registry(spark, f"{args.out}/registry", create=True)
        if args.deploy:
            got = deploy_all(chosen, build, deploy_endpoint, registry, settings.pins.get("rf"), make_model=make, path=f"{args.out}/models", dry_run=args.dry_run, k=settings.n_folds)
            out["deploy"] = [vars(x) for x in got]
        if args.deploy_transfer:
            got = deploy_all(chosen, build, deploy_transfer, registry, settings.pins.get("transfer"), path=f"{args.out}/models", dry_run=args.dry_run, seed=settings.seed)
            out["deploy_transfer"] = [vars(x) for x in got]
    if args.nearshell:
        by_name = {e.name: e for e in chosen}
        load = lambda n: build(by_name[n])[::-1]
        records, errors = nearshell.run(spark, list(by_name), load, {"rf": make}, f"{args.out}/nearshell", ["internal_only", "all_nvs", "dist_060", "dist060_agree"], ["internal_only", "dist060_agree"], args.resume)
        out["nearshell"] = {"verdict": nearshell.verdict_table(records), "errors": errors}
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
