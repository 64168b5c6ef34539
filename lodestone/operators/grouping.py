"""Which tasks belong together: average-linkage clusters of their rank correlations, and the training pools of each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.assembly import training_pools
from lodestone.operators.metrics import rank_association

#: The matrix is as large as the configured endpoints squared, whatever the rows.
MOST_TASKS = 500


def average_linkage(names: list[str], distances: dict[tuple[str, str], float], cut: float) -> list[list[str]]:
    """Clusters of names: the two whose members lie nearest on average are joined until that is more than `cut`.

    A pair without a distance counts as 1. Ties go to the clusters whose first names come first; clusters and their
    members come by name.
    """
    of = lambda x, y: distances.get((x, y), distances.get((y, x), 1.0))
    clusters = [[n] for n in sorted(names)]
    sums = {(i, j): of(a[0], b[0]) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j}
    live = set(range(len(clusters)))
    while len(live) > 1:
        mean, _, i, j = min((round(s / (len(clusters[i]) * len(clusters[j])), 12), (clusters[i][0], clusters[j][0]), i, j) for (i, j), s in sums.items())
        if mean > cut:
            break
        for k in live - {i, j}:
            sums[min(i, k), max(i, k)] += sums.pop((min(j, k), max(j, k)))
        del sums[i, j]
        clusters[i] = sorted(clusters[i] + clusters[j])
        live.discard(j)
    return sorted(clusters[i] for i in live)


def task_clusters(df: DataFrame, tasks: list[str], cut: float = 0.6, least: int = 10) -> list[list[str]]:
    """Clusters of task columns by 1 - |rank correlation| over the rows that have both; pairs with fewer than `least` such rows don't attract."""
    if len(tasks) > MOST_TASKS:
        raise ValueError(f"more than {MOST_TASKS} tasks")
    found = rank_association(df, tasks).where((F.col("n") >= least) & F.col("rho").isNotNull()).collect()
    return average_linkage(tasks, {(r["first"], r["second"]): 1 - abs(r["rho"]) for r in found}, cut)


def cluster_table(spark: SparkSession, clusters: list[list[str]]) -> DataFrame:
    """task, cluster (from 1), size."""
    return spark.createDataFrame([(t, i, len(c)) for i, c in enumerate(clusters, 1) for t in c], "task string, cluster bigint, size bigint")


def grouped_pools(wide: DataFrame, clusters: list[list[str]], target: str, **options) -> tuple[list[str], DataFrame, DataFrame]:
    """(tasks of the target's cluster, pretraining pool, fine-tuning pool): only tasks that belong with the target are trained beside it."""
    tasks = next((c for c in clusters if target in c), None)
    if tasks is None:
        raise KeyError(target)
    return tasks, *training_pools(wide, tasks, target, **options)
