"""Operator 12: embedding whitening by a tiled covariance.

An entry c becomes the whole number floor(256 * c). The fit list is every distinct vector of whole numbers once, so copies,
however many, count as one. Its rows are dealt into blocks of about BLOCK_ROWS by a hash; a key is a block of rows and a
tile, a pair of column blocks of TILE dimensions each. Under that key the two column blocks meet, are centred by the
exact means and multiplied; products are summed a tile, and the tiles (dimensions squared over two numbers, whatever the
rows) are assembled on the driver and decomposed there. Components are numbered by falling eigenvalue; each one's sign
makes its entry of largest size positive. Rows are then projected where they lie.

Rows whose vector is null, empty, or holds null or non-finite entries get no row, nor do those whose length differs from the
longest vector's. Rows that repeat an id or a vector are all returned. Components without spread (eigenvalue 0 within
rounding, as where the fit list has one vector) have no unit variance and are left out, so a table may give no rows;
an empty table gives none. deviation is exact, and null where it passes 64 bits. Only the id and the vector
are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shared import Scratch

SCALE = 256
TILE = 32
BLOCK_ROWS = 4096
#: The matrix of so many dimensions is what the driver can hold and decompose.
MOST_DIMENSIONS = 8192


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x: whole numbers of the vectors that have only finite entries."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & sound).select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("bigint")).alias("x"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.int64).reshape(len(flat), -1)


def column_sums(fit: DataFrame) -> list[int]:
    """Exact sums by dimension."""
    sums = fit.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"))
    return [int(r["s"]) for r in sums.orderBy("at").collect()]


def tile_products(fit: DataFrame, n: int, means: np.ndarray, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """i, j, u, w, s: sums over all rows of centred products of dimensions i * tile + u and j * tile + w, for i <= j."""
    columns = -(-len(means) // tile)
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(columns) for j in range(i, columns)])
    rows = fit.select(F.pmod(F.xxhash64("x"), F.lit(-(-n // block_rows))).alias("block"), "x", F.inline(keys))
    part = lambda k: F.slice("x", F.col(k) * tile + 1, F.lit(tile))

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        centred = lambda c, at: _matrix(table[c]).astype(np.float64) - means[at * tile : (at + 1) * tile]
        product = centred("left", i).T @ centred("right", j)
        k, rows = len(product), pa.ListArray.from_arrays(pa.array(np.arange(len(product) + 1, dtype=np.int32) * product.shape[1]), pa.array(product.reshape(-1)))
        return pa.table({"i": pa.array([i] * k, pa.int32()), "j": pa.array([j] * k, pa.int32()), "u": pa.array(range(k), pa.int32()), "p": rows})

    met = rows.select("block", "i", "j", part("i").alias("left"), part("j").alias("right"))
    products = met.groupBy("block", "i", "j").applyInArrow(work, "i int, j int, u int, p array<double>")
    return products.select("i", "j", "u", F.posexplode("p").alias("w", "p")).groupBy("i", "j", "u", "w").agg(F.sum("p").alias("s"))


def eigenvectors(products: DataFrame, n: int, width: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of the covariance, and their unit vectors as columns."""
    table = products.toArrow()
    at = lambda a, b: table[a].to_numpy().astype(np.int64) * tile + table[b].to_numpy()
    covariance = np.zeros((width, width))
    covariance[at("i", "u"), at("j", "w")] = table["s"].to_numpy() / n
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(width)])
    return values, vectors * signs


def projected(df: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> DataFrame:
    """Of rows id, x: id, deviation (sum of (n x - S)^2), w (the whitened entries); axes are scaled to unit variance."""
    means, total = np.array(sums, np.float64) / n, np.array(sums, object)

    def deviations(x: np.ndarray) -> pa.Array:
        rough = ((x.astype(np.float64) * n - total.astype(np.float64)) ** 2).sum(1)
        if len(x) and rough.max() >= 2.0**62:
            exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
            return pa.array([e if e < 2**63 else None for e in exact], pa.int64())
        return pa.array(((x * n - total.astype(np.int64)) ** 2).sum(1), pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            w = (x - means) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), deviations(x), lists], names=["id", "deviation", "w"])

    return df.mapInArrow(work, f"id {df.schema['id'].dataType.simpleString()}, deviation bigint, w array<double>")


def identity_gap(w: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of whitened rows (w array) minus the identity; centred first."""
    means = w.agg(*[F.avg(F.col("w")[a]) for a in range(k)]).first()
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    found = w.agg(*[F.avg((F.col("w")[a] - F.lit(means[a])) * (F.col("w")[b] - F.lit(means[b]))) for a, b in pairs]).first()
    return max(abs(c - (a == b)) for (a, b), c in zip(pairs, found, strict=True))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each sound vector and component."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = quantised(df, id_col, vector_col)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if width > MOST_DIMENSIONS:
        raise ValueError(f"{width} dimensions; the driver decomposes {MOST_DIMENSIONS} at most")
    rows = rows.where(F.size("x") == width)
    empty = spark.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    if not width:
        return empty
    fit = scratch.save(rows.select("x").distinct())
    n, sums = fit.count(), column_sums(fit)
    means = np.array(sums, np.float64) / n
    values, vectors = eigenvectors(tile_products(fit, n, means, tile, block_rows), n, width, tile)
    trace = float(values.sum())
    k = int((values[:components] > max(trace, 0.0) * width * np.finfo(float).eps).sum())
    if not k:
        return empty
    axes = vectors[:, :k] / np.sqrt(values[:k])
    gap = identity_gap(scratch.save(projected(fit.withColumn("id", F.lit(0)), n, sums, axes).select("w")), k)
    scratch.keep_only()
    facts = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.lit(float(values[c]) / trace).alias("explained")) for c in range(k)])
    out = projected(rows, n, sums, axes).select(F.col("id").alias(id_col), "deviation", "w", F.inline(facts))
    return out.select(id_col, "component", F.lit(n).cast("bigint").alias("n"), "deviation", F.expr("w[component - 1]").alias("whitened"), "explained", F.lit(gap).alias("identity_error"))
