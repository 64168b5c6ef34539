"""Ridge heads from additive sums: every subset of origins and every left-out fold is a sum or difference of small matrices.

One grouped aggregate gives, for each origin (and each fold of the internal rows), the number of rows, the sums of features
and labels, and the sums of their products. The head that rows of any subset fit, and how it does on any other rows, follow
from those sums alone: the slopes solve (X'X centred + penalty) w = X'y centred, and a head's squared errors and
correlation on other rows need only those rows' sums. So 2 ** n subsets cost one pass over the rows and 2 ** n
solutions of a small system, dealt over tasks by the subset's number.

Rows with a null label, or features that are null, of another length than most_features says, or not finite, don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ORIGINS = 20
#: A key's sums are so many numbers squared.
MOST_FEATURES = 1024


@dataclass
class Sums:
    """n, and the sums of products of (1, features, label) with each other; kept about a common centre."""

    table: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.table + other.table)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.table - other.table)

    @property
    def n(self) -> float:
        return self.table[0, 0]

    def head(self, penalty: float) -> np.ndarray | None:
        """(intercept, slopes) of the ridge head; None without rows."""
        if self.n < 0.5:
            return None
        m = self.table[0, 1:] / self.n
        centred = self.table[1:, 1:] - self.n * np.outer(m, m)
        slopes = np.linalg.solve(centred[:-1, :-1] + penalty * np.eye(len(m) - 1), centred[:-1, -1])
        return np.concatenate(([m[-1] - slopes @ m[:-1]], slopes))

    def tried(self, head: np.ndarray) -> np.ndarray:
        """n, and the sums of y, y squared, p, p squared, p y of a head's predictions p."""
        t, v = self.table, np.concatenate((head, [0.0]))
        y = np.zeros(len(t))
        y[-1] = 1.0
        return np.array([t[0, 0], t[0, -1], y @ t @ y, t[0] @ v, v @ t @ v, v @ t @ y])


def scores(s: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """Squared correlation, 1 - SSE / SST and RMSE from sums (n, y, yy, p, pp, py); None where there is no spread."""
    n, y, yy, p, pp, py = s
    if n < 0.5:
        return None, None, None
    error = max(0.0, yy - 2 * py + pp)
    a, b, both = yy - y * y / n, pp - p * p / n, py - y * p / n
    flat = a <= 1e-12 * max(yy, 1e-300)
    return None if flat or b <= 1e-12 * max(pp, 1e-300) else both * both / (a * b), None if flat else 1 - error / a, float(np.sqrt(error / n))


def gram_sums(df: DataFrame, by: Column, centre: np.ndarray, width: int, features: str = "features", label: str = "label") -> dict:
    """A key's Sums, from one pass: tasks add up products of blocks, then one row a key and matrix row is merged."""
    x, size = F.col(features).cast("array<double>"), width + 2
    sound = F.coalesce((F.size(x) == width) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))) & (F.abs(F.col(label)) < float("inf")), F.lit(False))
    rows = df.where(sound).select(by.cast("string").alias("k"), x.alias("x"), F.col(label).cast("double").alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.ones((batch.num_rows, size))
            z[:, 1:-1] = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, width)
            z[:, -1] = batch.column("y").to_numpy()
            z[:, 1:] -= centre
            coded = batch.column("k").dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy()
            for c in np.unique(code):
                key = coded.dictionary[c].as_py() if c >= 0 else None
                some = z[code == c]
                sums[key] = sums.get(key, 0) + some.T @ some
        for key, table in sums.items():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * size), pa.array(table.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array([key] * size, pa.string()), pa.array(np.arange(size, dtype=np.int32)), lists], names=["k", "i", "s"])

    parts = rows.mapInArrow(work, "k string, i int, s array<double>")
    merged = parts.select("k", "i", F.posexplode("s").alias("j", "s")).groupBy("k", "i", "j").agg(F.sum("s").alias("s"))
    out: dict = {}
    for r in merged.toArrow().to_batches():  # keys times width squared, whatever the rows
        for k, i, j, s in zip(*[c.to_pylist() for c in r.columns], strict=True):
            out.setdefault(k, np.zeros((size, size)))[i, j] = s
    return {k: Sums(v) for k, v in out.items()}


def scan(public: DataFrame, internal: DataFrame, origins: list[str] | None = None, penalty: float = 1.0, features: str = "features", label: str = "label") -> DataFrame:
    """A row for each non-empty subset of the origins: mask (bit i: i-th origin by name), combo, n_train, R2_pears, R2_det, RMSE
    of its head on all internal rows, and cv_r2det, cv_rmse of heads on the subset and the internal rows of other folds.

    public: origin, features, label; internal: fold, features, label. At most MOST_ORIGINS origins.
    """
    spark = public.sparkSession
    width = internal.agg(F.max(F.size(features))).first()[0] or 0
    if width > MOST_FEATURES:
        raise ValueError(f"{width} features; sums of {MOST_FEATURES} squared a key are kept at most")
    shape = "mask bigint, combo string, n_train bigint, R2_pears double, R2_det double, RMSE double, cv_r2det double, cv_rmse double"
    if not width:
        return spark.createDataFrame([], shape)
    chosen = public if origins is None else public.where(F.col("origin").isin(origins))
    # Products are summed about the internal means, so that differences of large sums lose little.
    means = internal.select(F.posexplode(F.array_append(F.col(features).cast("array<double>"), F.col(label).cast("double"))).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()
    centre = np.zeros(width + 1)
    for r in means:
        if r["i"] <= width and r["m"] is not None and np.isfinite(r["m"]):
            centre[r["i"]] = r["m"]
    found = chosen.groupBy("origin").agg(F.lit(1)).limit(MOST_ORIGINS + 1).collect()
    if len(found) > MOST_ORIGINS:
        raise ValueError(f"more than {MOST_ORIGINS} origins have too many subsets")
    by_origin = {k: v for k, v in gram_sums(chosen, F.col("origin"), centre, width, features, label).items() if k is not None}
    folds = gram_sums(internal, F.col("fold"), centre, width, features, label)
    names = sorted(by_origin)
    total = sum(folds.values(), Sums(np.zeros((width + 2, width + 2))))

    def solved(mask: int) -> tuple:
        train = sum((by_origin[n] for i, n in enumerate(names) if mask >> i & 1), Sums(np.zeros((width + 2, width + 2))))
        r2, det, rmse = scores(total.tried(train.head(penalty)))
        cv = np.zeros(6)
        for held in folds.values():
            cv += held.tried((train + total - held).head(penalty))
        _, cv_det, cv_rmse = scores(cv)
        return mask, "+".join(n.split(":")[-1] for i, n in enumerate(names) if mask >> i & 1), int(round(train.n)), r2, det, rmse, cv_det, cv_rmse

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [solved(m) for m in batch.column("mask").to_pylist()]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in shape.split(", ")])

    return spark.range(1, 1 << len(names)).withColumnRenamed("id", "mask").mapInArrow(work, shape)
