"""Similarity joins between a large pool and an internal query set, and what is built on them.

Nearest neighbours come from the pivot join. Pairs within a distance: pool and internal rows are dealt into parts and groups
of bounded size; each meeting is matrix products of a few rows at a time that give the near ones only, so no pair of all is
ever a row and a task holds no more than `CELLS` distances. Cosines are tested in single precision first, with room for its
errors, and made in double precision for what passes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.transforms import num
from lodestone.operators.pivots import nearest_by_pivots
from lodestone.operators.ranks import percentiles

PART_ROWS = 8_192
GROUP_ROWS = 8_192
#: Rows of a part where a table meets itself: of that many parts, or more of the most rows.
OWN_PARTS, OWN_LEAST, OWN_MOST = 12, 1_024, 65_536
#: Distances that a meeting holds at once; cosines in single precision that it tests at once, of so many rows of one side.
CELLS, TESTS, BLOCK = 2**21, 2**18, 2**10
DIGITS = 12


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, num(0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), num(0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return num(1) - F.try_divide(dot(a, b), norm(a.cast("array<double>")) * norm(b.cast("array<double>")))


def tanimoto_distance(a: Column, b: Column) -> Column:
    """1 - |intersection| / |union| of two arrays of set bits."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return num(1) - F.try_divide(both, F.size(a) + F.size(b) - both)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _distances(u: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    both = u @ v.T
    a, b = np.einsum("ij,ij->i", u, u)[:, None], np.einsum("ij,ij->i", v, v)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - both / (np.sqrt(a) * np.sqrt(b) if metric == "cosine" else a + b - both)


def _near(u: np.ndarray, v: np.ndarray, limit: float, metric: str, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of u, rows of v and distances of the pairs within the limit."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    # a vector without a direction is near none
    own = [np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1)) if metric == "cosine" else np.arange(len(x)) for x in (u, v)]
    u, v = u[own[0]], v[own[1]]
    with np.errstate(over="ignore", under="ignore"):
        a, b = np.einsum("ij,ij->i", u, u), np.einsum("ij,ij->i", v, v)
    fast = metric == "cosine" and all(((x > 1e-200) & (x < 1e200)).all() for x in (a, b))  # else squares may have lost digits
    if fast:
        x, y = (u / np.sqrt(a)[:, None]).astype(np.float32), (v / np.sqrt(b)[:, None]).astype(np.float32)
        least = np.float32(1 - limit - 10.0**-digits - (u.shape[1] + 8) * 2.0**-22)
    few = max(1, CELLS // max(1, u.shape[1]))  # pairs whose vectors are held at once
    high = min(BLOCK, CELLS)
    wide = max(1, min(TESTS, CELLS) // high)
    for i in range(0, len(u), high):
        for j in range(0, len(v), wide):
            p, q = slice(i, i + high), slice(j, j + wide)
            if not fast:
                d = np.round(_distances(u[p], v[q], metric), digits) + 0.0
                rows, columns = np.nonzero(d <= limit)
                parts = [(rows, columns, d[rows, columns])]
            else:
                near = x[p] @ y[q].T >= least
                at, parts = np.flatnonzero(near), []
                for start in range(0, len(at), few):
                    rows, columns = np.divmod(at[start : start + few], near.shape[1])
                    both = np.einsum("ij,ij->i", u[p][rows], v[q][columns])
                    d = np.round(1 - both / (np.sqrt(a[p][rows]) * np.sqrt(b[q][columns])), digits) + 0.0
                    keep = d <= limit
                    parts.append((rows[keep], columns[keep], d[keep]))
            for rows, columns, d in parts:
                for column, values in zip(found, (own[0][rows + i], own[1][columns + j], d), strict=True):
                    column.append(values)
    return tuple(np.concatenate(c) for c in found)


def _meetings(pool: DataFrame, internal: DataFrame, pool_id: str, internal_id: str, vector: str, work) -> DataFrame:
    """work over the tables (id, v) of every part of the pool and group of the internal rows."""
    kinds = pool.schema[pool_id].dataType.simpleString(), internal.schema[internal_id].dataType.simpleString()
    narrow = all(df.schema[vector].dataType.simpleString() == "array<float>" for df in (pool, internal))  # moved as they are
    v = F.col(vector).cast("array<float>" if narrow else "array<double>").alias("v")
    a, b = pool.where(F.col(vector).isNotNull()).select(F.col(pool_id).alias("id"), v), internal.where(F.col(vector).isNotNull()).select(F.col(internal_id).alias("id"), v)
    parts, groups = max(1, math.ceil(a.count() / PART_ROWS)), max(1, math.ceil(b.count() / GROUP_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = a.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("group", every(groups))
    b = b.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("part", every(parts))
    return a.groupBy("part", "group").cogroup(b.groupBy("part", "group")).applyInArrow(work, f"pool {kinds[0]}, internal {kinds[1]}, dist double")


def _table(left: pa.Table, right: pa.Table, rows: np.ndarray, columns: np.ndarray, dist: np.ndarray) -> pa.Table:
    return pa.table({"pool": left["id"].combine_chunks().take(pa.array(rows)), "internal": right["id"].combine_chunks().take(pa.array(columns)), "dist": pa.array(dist)})


def within(pool: DataFrame, internal: DataFrame, limit: float, pool_id: str = "id", internal_id: str = "id", vector: str = "v", metric: str = "cosine", digits: int = DIGITS) -> DataFrame:
    """(pool, internal, dist) of all pairs within the distance, rounded to `digits`; null vectors are near none."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(left, right, np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return _table(left, right, *_near(_matrix(left["v"]), _matrix(right["v"]), limit, metric, digits))

    return _meetings(pool, internal, pool_id, internal_id, vector, work)


def links_within(rows: DataFrame, limit: float, id_col: str = "id", vector: str = "v", metric: str = "cosine", digits: int = DIGITS) -> DataFrame:
    """(a, b), a < b: each pair of different ids with vectors within the distance, once; null vectors are near none.

    Each two parts meet once. Rows of one id are in one part, so what repeats of a pair is in one meeting.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    wide = "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"
    held = rows.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast(f"array<{wide}>").alias("v"))
    n = held.count()
    parts = max(1, math.ceil(n / min(OWN_MOST, max(OWN_LEAST, math.ceil(n / OWN_PARTS)))))
    held = held.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    mine = held.select("id", "v", F.col("part").alias("p"), F.explode(F.sequence("part", F.lit(parts - 1))).alias("q"))
    theirs = held.select(F.col("id").alias("id"), F.col("v").alias("v"), F.explode(F.sequence(F.lit(0), "part")).alias("p"), F.col("part").alias("q"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = left["id"].slice(0, 0)
            return pa.table({"a": none, "b": none})
        at, to, _ = _near(_matrix(left["v"]), _matrix(right["v"]), limit, metric, digits)
        one, other = left["id"].combine_chunks().take(pa.array(at)), right["id"].combine_chunks().take(pa.array(to))
        met = pa.table({"a": pc.min_element_wise(one, other), "b": pc.max_element_wise(one, other)}).filter(pc.not_equal(one, other))
        return met.group_by(["a", "b"]).aggregate([])

    return mine.groupBy("p", "q").cogroup(theirs.groupBy("p", "q")).applyInArrow(work, f"a {kind}, b {kind}")


def nearest(pool: DataFrame, internal: DataFrame, k: int, of: str = "pool", pool_id: str = "id", internal_id: str = "id", vector: str = "v", digits: int = DIGITS, skip_same: bool = False) -> DataFrame:
    """(pool, internal, dist, rank): for each row of one side (`of`) its k nearest of the other by cosine distance.

    Distances are rounded to `digits`; ties go to the smaller id. Vectors without a direction are near none. Ids are unique
    on each side; skip_same: both sides' ids name the same vectors, and none is its own neighbour. Searched by pivots.
    """
    sides = [(pool, pool_id), (internal, internal_id)]
    (queries, query_id), (searched, searched_id) = sides if of == "pool" else sides[::-1]
    found = nearest_by_pivots(queries, searched, k, query_id, searched_id, vector, digits, skip_same)
    names = ("id", "other") if of == "pool" else ("other", "id")
    return found.select(F.col(names[0]).alias("pool"), F.col(names[1]).alias("internal"), "dist", "rank")


def shell(near: DataFrame, limit: float) -> DataFrame:
    """Of pool rows' nearest distances: those within the limit."""
    return near.groupBy("pool").agg(F.min("dist").alias("nearest")).where(F.col("nearest") <= num(limit))


def mutual_nearest(pool: DataFrame, internal: DataFrame, k: int, **options) -> DataFrame:
    """Pairs of which each is among the other's k nearest."""
    a = nearest(pool, internal, k, "internal", **options).select("internal", "pool", "dist")
    b = nearest(pool, internal, k, "pool", **options).select("internal", "pool")
    return a.join(b, ["internal", "pool"])


def edited(near: DataFrame, pool_labels: DataFrame, internal_labels: DataFrame, most: float) -> DataFrame:
    """Of pool rows' nearest internal rows: pool rows whose label is within `most` of the mean label of those (columns id, label)."""
    labelled = near.join(internal_labels.select(F.col("id").alias("internal"), F.col("label").alias("_l")), "internal")
    means = labelled.groupBy("pool").agg(F.avg("_l").alias("neighbour_label"))
    return means.join(pool_labels.select(F.col("id").alias("pool"), "label"), "pool").where(F.abs(F.col("label") - F.col("neighbour_label")) <= num(most))


def distance_weights(dist: DataFrame, scale: float) -> DataFrame:
    return dist.groupBy("pool").agg(F.exp(-F.min("dist") / num(scale)).alias("weight"))


def correct_bias(pool: DataFrame, internal: DataFrame, mode: str, label: str = "label", anchors: DataFrame | None = None) -> DataFrame:
    """Pool labels moved to the internal median (shift), also scaled to its interquartile range (affine), or moved by the
    median difference of measured anchors (anchor: rows pool_label, internal_label of structures that both sides have)."""
    if mode not in ("shift", "affine", "anchor"):
        raise ValueError(f"unknown correction {mode!r}")
    if mode == "anchor":
        shift = percentiles(anchors.select((F.col("internal_label") - F.col("pool_label")).alias("_d")), [], "_d", [0.5]).first()
        return pool.withColumn("corrected", F.col(label) + num(shift[0][0] if shift and shift[0][0] is not None else 0.0))
    (pl, pm, ph), (il, im, ih) = (percentiles(df, [], label, [0.25, 0.5, 0.75]).first()[0] for df in (pool, internal))
    scale = (ih - il) / (ph - pl) if mode == "affine" and ph > pl else 1.0
    return pool.withColumn("corrected", (F.col(label) - num(pm)) * num(scale) + num(im))


def nested_selection(scores: DataFrame, metric: str = "r2") -> DataFrame:
    """Of rows (outer_fold, strategy, inner, outer): the strategy that is best inside, with its score outside."""
    best = Window.partitionBy("outer_fold").orderBy(F.col("inner").desc_nulls_last(), "strategy")
    return scores.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("outer_fold", "strategy", F.col("outer").alias(f"honest_{metric}"))
