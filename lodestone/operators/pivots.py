"""Exact nearest-neighbour join by pivots: a query meets only the cells that can hold a neighbour.

Vectors are scaled to length 1, where a cosine distance c is half the square of the straight one. A bounded sample of the
searched side gives pivots; each vector belongs to its nearest pivot's cell, which knows its radius and count. A query first
searches the nearest cells that together hold k vectors, which bounds the distance of its k-th neighbour. By the triangle
inequality a cell can then hold a better one only if the query's distance to its pivot is at most that bound plus the radius,
and, as the cell's vectors lie nearer to their own pivot than to the query's nearest, if half the difference of squared
distances over the pivots' distance is within the bound too. Only these cells are met, each with the queries that need it, and
in a cell only vectors whose distance to the pivot differs from the query's by no more than the bound are compared.

Small cells are joined to units of bounded size and large ones are cut into several, so a query moves once a unit with a cell that
it visits, however many cells these are; queries of a unit come in groups, so a meeting is bounded too. How much is
pruned depends on the data (directions that all lie equally far apart allow none); the result does not, and `visited`
tells how many cells each query met. Vectors that are null, of length 0 or not finite are near none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import Scratch

PIVOTS = 256
#: Fewer vectors than this are one cell, and are searched at once.
FEW = 4096
PART_ROWS = 16_384
GROUP_ROWS = 32_768
#: Queries whose distances to a part are held at once.
STEP = 256
DIGITS = 12
#: What rounding of straight distances may amount to.
SLACK = 1e-7


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _straight(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (u @ v.T)))


def unit_rows(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v (the vector as it is, doubles) of rows that have a direction."""
    v = F.col(f"`{vector}`").cast("array<double>")
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    return df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(length.isNotNull() & (length > 0) & (length < float("inf")))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def choose_pivots(rows: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """At most `most` different directions, drawn by a hash of the ids: the square root of the rows' number if that is less."""
    n = rows.count()
    most = most if n >= FEW else 1
    some = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(most, int(n**0.5)))).toArrow()["v"]
    return np.unique(np.round(_scaled(_matrix(some)), 12), axis=0) if n else np.zeros((0, 1))


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, v, cell, far (the distance to its pivot)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _straight(_scaled(_matrix(batch.column("v"))), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "cell", "far"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, cell int, far double")


class Cells:
    """The cells' pivots, radii and counts: a table of as many rows as pivots."""

    def __init__(self, placed: DataFrame, pivots: np.ndarray):
        self.pivots, n = pivots, len(pivots)
        self.count, self.radius = np.zeros(n, np.int64), np.zeros(n)
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect():
            self.count[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"]
        self.between = _straight(pivots, pivots)
        #: Each cell's first unit and number of units; as many cells as fit in PART_ROWS are one unit.
        self.unit, self.units, self.n_units, room = np.zeros(n, np.int64), -(-self.count // PART_ROWS), 0, 0
        for c in np.flatnonzero(self.count):
            if self.units[c] > 1 or self.count[c] > room:
                self.unit[c], room = self.n_units, PART_ROWS - self.count[c] if self.units[c] == 1 else 0
                self.n_units += int(self.units[c])
            else:
                self.unit[c], room = self.n_units - 1, room - self.count[c]
        self.of_unit = np.zeros((n, self.n_units), np.float32)
        for c in range(n):
            self.of_unit[c, self.unit[c] : self.unit[c] + self.units[c]] = 1

    def first(self, d: np.ndarray, k: int) -> np.ndarray:
        """For each query (distances to all pivots) whether a cell is among the nearest ones that hold k vectors together."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, (before < k) & (self.count[order] > 0), 1)
        return out

    def possible(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each query whether a cell may hold a vector within its bound."""
        own = d.argmin(1)
        apart = self.between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * apart), 0.0)
        limit = bound[:, None] + SLACK
        return (self.count > 0) & (d - self.radius <= limit) & (plane <= limit)


def _visits(queries: DataFrame, cells: Cells, choose) -> DataFrame:
    """A row a query and unit with a cell that it visits: id, v, bound, unit, visited (cells of the query)."""
    kind = queries.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                chosen = choose(_straight(_scaled(_matrix(batch.column("v"))), cells.pivots), bound)
                mine, unit = np.nonzero(chosen.astype(np.float32) @ cells.of_unit)
                at, visited = pa.array(mine), chosen.sum(1)[mine]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(bound[mine]), pa.array(unit.astype(np.int32)), pa.array(visited.astype(np.int32))], names=["id", "v", "bound", "unit", "visited"])

    return queries.mapInArrow(work, f"id {kind}, v array<double>, bound double, unit int, visited int")


def _search(visits: DataFrame, placed: DataFrame, cells: Cells, choose, k: int, digits: int, skip_same: bool) -> DataFrame:
    """id, other, dist: of each visit the k nearest vectors of the unit, among those in chosen cells that the bound allows."""
    groups = {r["unit"]: -(-r["n"] // GROUP_ROWS) for r in visits.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a unit

    def of(column: str, table: dict[int, int]):
        return F.coalesce(F.create_map(*[F.lit(int(x)) for pair in ({-1: 1} | table).items() for x in pair])[F.col(column)], F.lit(1))

    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    theirs = placed.withColumn("unit", of("cell", dict(enumerate(cells.unit))) + deal(of("cell", dict(enumerate(np.maximum(cells.units, 1))))))
    theirs = theirs.withColumn("group", F.explode(F.sequence(F.lit(0), of("unit", groups) - 1)))
    mine = visits.withColumn("group", deal(of("unit", groups)))
    kinds = visits.schema["id"].dataType.simpleString(), placed.schema["id"].dataType.simpleString()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others, dists = [], [], []
        if left.num_rows and right.num_rows:
            order = np.argsort(np.asarray(right["id"]), kind="stable")
            names, y, far, cell = right["id"].combine_chunks().take(pa.array(order)), _scaled(_matrix(right["v"]))[order], right["far"].to_numpy()[order], right["cell"].to_numpy()[order]
            to = _straight(_scaled(_matrix(left["v"])), cells.pivots)
            by_cell = np.argsort(to.argmin(1), kind="stable")  # queries of one cell visit much the same cells
            x, to, bound, own = _scaled(_matrix(left["v"]))[by_cell], to[by_cell], left["bound"].to_numpy()[by_cell], left["id"].combine_chunks().take(pa.array(by_cell))
            same = {v: i for i, v in enumerate(names.to_pylist())} if skip_same else {}
            for i in range(0, len(x), STEP):
                near, most = to[i : i + STEP], bound[i : i + STEP, None] + SLACK
                chosen = choose(near, bound[i : i + STEP])
                some = np.flatnonzero(chosen.any(0)[cell])
                d = np.round(1 - x[i : i + STEP] @ y[some].T, digits) + 0.0
                d[~chosen[:, cell[some]] | (np.abs(far[some][None, :] - near[:, cell[some]]) > most)] = np.inf
                if skip_same:
                    place = np.full(len(y), -1)
                    place[some] = np.arange(len(some))
                    for row, v in enumerate(own.slice(i, STEP).to_pylist()):
                        if v in same and place[same[v]] >= 0:
                            d[row, place[same[v]]] = np.inf
                keep = np.isfinite(d)
                if d.shape[1] > k:  # all that are nearer than the k-th, and of those as near the first by id
                    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    nearer, tied = d < kth, d == kth
                    keep &= nearer | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - nearer.sum(1)[:, None]))
                rows, at = np.nonzero(keep)
                ids.append(own.take(pa.array(rows + i)))
                others.append(names.take(pa.array(some[at])))
                dists.append(d[rows, at])
        if not ids:
            return pa.table({"id": left["id"].slice(0, 0), "other": right["id"].slice(0, 0), "dist": pa.array([], pa.float64())})
        return pa.table({"id": pa.chunked_array(ids), "other": pa.chunked_array(others), "dist": np.concatenate(dists)})

    key = ["unit", "group"]
    return mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(work, f"id {kinds[0]}, other {kinds[1]}, dist double")


def nearest_by_pivots(queries: DataFrame, searched: DataFrame, k: int, query_id: str = "id", searched_id: str = "id", vector: str = "v", digits: int = DIGITS, skip_same: bool = False, most: int = PIVOTS) -> DataFrame:
    """id, other, dist, rank, visited, cells: each query's k nearest by cosine distance rounded to `digits`, ties to the smaller id.

    Ids are unique on each side. skip_same: a vector is not its own neighbour (ids of both sides name the same vectors).
    """
    scratch = Scratch(queries.sparkSession)
    mine, theirs = unit_rows(queries, query_id, vector), unit_rows(searched, searched_id, vector)
    pivots = choose_pivots(theirs, most)
    kinds = mine.schema["id"].dataType.simpleString(), theirs.schema["id"].dataType.simpleString()
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], f"id {kinds[0]}, other {kinds[1]}, dist double, rank bigint, visited int, cells int")
    placed = scratch.save(in_cells(theirs, pivots))
    cells = Cells(placed, pivots)
    bounded = mine.withColumn("bound", F.lit(4.0))
    if len(pivots) > 1:
        more = k + 1 if skip_same else k
        first = lambda d, bound: cells.first(d, more)
        begun = scratch.save(_visits(bounded, cells, first))
        kth = _search(begun, placed, cells, first, k, digits, skip_same).groupBy("id").agg(F.array_sort(F.collect_list("dist")).alias("all"), F.count(F.lit(1)).alias("n"))
        # A query's bound: the straight distance that belongs to its k-th rounded cosine distance, and one step of rounding.
        bound = F.when(F.col("n") >= k, F.sqrt(F.lit(2.0) * (F.col("all")[k - 1] + F.lit(10.0**-digits)))).otherwise(F.lit(4.0))
        bounds = scratch.save(kth.select(F.col("id").alias("_id"), bound.alias("bound")))
        scratch.drop(begun)
        bounded = mine.join(bounds, F.col("id") == F.col("_id"), "left").select("id", "v", F.coalesce("bound", F.lit(4.0)).alias("bound"))
    visits = scratch.save(_visits(bounded, cells, cells.possible))
    found = _search(visits, placed, cells, cells.possible, k, digits, skip_same)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "other")).cast("bigint")
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    counts = visits.groupBy(F.col("id").alias("_id")).agg(F.max("visited").alias("visited"))
    return best.join(counts, F.col("id") == F.col("_id")).select("id", "other", "dist", "rank", "visited", F.lit(int((cells.count > 0).sum())).alias("cells"))
