"""Learners over pyspark.ml: forests with per-tree spread, and the substitutes for boosted and transfer learners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UQ = "pred_y double, uq_std double, low double, up double"


def with_vector(df: DataFrame, column: str = "features") -> DataFrame:
    return df.withColumn("_vector", array_to_vector(F.col(column).cast("array<double>")))


def forest(trees: int = 50, depth: int = 20, share: float = 0.3, leaf: int = 2, seed: int = 42) -> RandomForestRegressor:
    """The champion forest; trees and depth are the caller's budget (depth at most 30)."""
    return RandomForestRegressor(featuresCol="_vector", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(share), minInstancesPerNode=leaf, seed=seed)


def boosted(rounds: int = 40, depth: int = 5, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(featuresCol="_vector", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed)


def boosted_classifier(rounds: int = 20, depth: int = 5, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(featuresCol="_vector", labelCol="class", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)


def tree_classifier(depth: int = 20, leaf: int = 2, seed: int = 42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol="_vector", labelCol="class", maxDepth=depth, minInstancesPerNode=leaf, seed=seed)


def forest_classifier(trees: int = 50, depth: int = 20, seed: int = 42, cut: float = 0.5) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="_vector", labelCol="class", numTrees=trees, maxDepth=depth, seed=seed).setThresholds([1 - cut, cut])


def balanced(df: DataFrame, label: str = "class") -> DataFrame:
    """The rows with weights that give both classes the same sum."""
    counts = df.groupBy(F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_k"))
    total = df.count()
    return df.join(F.broadcast(counts), F.col(label) == F.col("_c")).withColumn("weight", F.lit(total / 2.0) / F.col("_k")).drop("_c", "_k")


def _trees(model: RandomForestRegressionModel, spark, path: str) -> list[tuple[np.ndarray, ...]]:
    """Each tree's feature, threshold, left, right and prediction arrays, from the saved model's node table."""
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    nodes = nodes.select("treeID", "nodeData.*") if "nodeData" in nodes.columns else nodes
    table = nodes.select("treeID", "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("f"), F.expr("get(split.leftCategoriesOrThreshold, 0)").alias("t")).toPandas().sort_values(["treeID", "id"])
    return [(g["f"].to_numpy(np.int64), g["t"].fillna(0).to_numpy(), g["leftChild"].to_numpy(np.int64), g["rightChild"].to_numpy(np.int64), g["prediction"].to_numpy()) for _, g in table.groupby("treeID")]


def tree_spread(model: RandomForestRegressionModel, df: DataFrame, path: str, column: str = "features") -> DataFrame:
    """The rows with the trees' mean, population spread and 5 % to 95 % range; a model's node table is small and sent to the executors."""
    trees = df.sparkSession.sparkContext.broadcast(_trees(model, df.sparkSession, path))

    def one(x: np.ndarray, tree) -> np.ndarray:
        f, t, left, right, value = tree
        at = np.zeros(len(x), np.int64)
        while True:
            inner = left[at] >= 0
            if not inner.any():
                return value[at]
            go_left = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
            at = np.where(inner, np.where(go_left, left[at], right[at]), at)

    @F.pandas_udf(UQ)
    def spread(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for features in batches:
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, 1))
            p = np.stack([one(x, t) for t in trees.value]) if len(x) else np.zeros((len(trees.value), 0))
            low, up = np.quantile(p, [0.05, 0.95], axis=0) if len(x) else (p.mean(0), p.mean(0))
            yield pd.DataFrame({"pred_y": p.mean(0), "uq_std": p.std(0), "low": low, "up": up})

    return df.withColumn("_uq", spread(F.col(column).cast("array<double>"))).select(*df.columns, "_uq.*")


class Transfer:
    """A representation fitted on some rows (a boosted model's prediction beside principal components) and a linear head."""

    def __init__(self, base: list, head=None):
        self.base, self.head = base, head

    @classmethod
    def represent(cls, rows: DataFrame, seed: int = 42, k: int = 8) -> Transfer:
        from pyspark.ml.feature import PCA, VectorAssembler

        vectors = with_vector(rows)
        k = min(k, len(vectors.select("_vector").first()[0]))
        base = boosted(20, 4, seed).setPredictionCol("_base").fit(vectors)
        return cls([PCA(k=k, inputCol="_vector", outputCol="_pc").fit(vectors), base, VectorAssembler(inputCols=["_pc", "_base"], outputCol="_head")])

    def encode(self, rows: DataFrame) -> DataFrame:
        out = with_vector(rows)
        for stage in self.base:
            out = stage.transform(out)
        return out

    def with_head(self, rows: DataFrame) -> Transfer:
        """The representation as it is, under a head fitted on these rows."""
        head = LinearRegression(featuresCol="_head", labelCol="label", predictionCol="pred_y", regParam=0.1)
        return Transfer(self.base, head.fit(self.encode(rows)))

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.head.transform(self.encode(rows)).drop("_vector", "_pc", "_base", "_head")

    def save(self, path: str) -> None:
        from pyspark.ml import PipelineModel

        PipelineModel([*self.base, self.head]).write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Transfer:
        from pyspark.ml import PipelineModel

        *base, head = PipelineModel.load(path).stages
        return cls(base, head)


def transfer(public: DataFrame, train: DataFrame, test: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """test with pred_y of a representation fitted on public rows and a head on internal ones."""
    return Transfer.represent(public, seed, k).with_head(train).predict(test)


UNCERTAINTY = ("trees", "ensemble")


def uncertain(mode: str, train: DataFrame, test: DataFrame, make_model, path: str, members: int = 5, seed: int = 42) -> DataFrame:
    """test with pred_y and uq_std: of a forest's trees, or of models fitted on samples drawn with replacement (`ensemble`).

    Modes of neural networks (dropout, evidential) have no counterpart here and raise.
    """
    if mode not in UNCERTAINTY:
        raise ValueError(f"unknown uncertainty {mode!r}: one of {UNCERTAINTY}")
    if mode == "trees":
        return tree_spread(make_model().fit(with_vector(train)), test, path).drop("low", "up")
    out = with_vector(test)
    for i in range(members):
        model = make_model().setPredictionCol(f"_p{i}").fit(with_vector(train.sample(True, 1.0, seed + i)))
        out = model.transform(out)
    p = F.array(*[F.col(f"_p{i}") for i in range(members)])
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / members
    out = out.withColumn("pred_y", mean)
    spread = F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + (x - F.col("pred_y")) * (x - F.col("pred_y"))) / members)
    return out.withColumn("uq_std", spread).drop("_vector", *[f"_p{i}" for i in range(members)])


def probabilities(df: DataFrame, model) -> DataFrame:
    return model.transform(with_vector(df)).withColumn("proba", vector_to_array("probability")[1]).drop("_vector", "rawPrediction", "probability")
