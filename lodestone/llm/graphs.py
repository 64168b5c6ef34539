"""Operator 9: embedding near duplicates by navigable small-world graphs.

Equal vectors are one class, named by its smallest id. Classes are dealt to shards by hash; each shard builds a
hierarchical graph (upper layers hold a sixteenth of the layer below; neighbours are chosen so that none is closer to
another chosen one than to the node). Every class then queries every shard: it descends greedily to the lowest layer and
searches it with a beam. A query whose beam holds links only is searched again with a wider beam, beyond WIDEST over the
whole shard. Before a task asks a shard's graph, its beam is audited against brute force over the shard: vectors of
the shard are drawn until they have AUDIT_LINKS links to others (or AUDIT_MOST are drawn), and AUDIT queries are made just
inside the threshold around vectors; while either miss more than one link in a hundred the beam is doubled. The audits'
links and those found come with the result.

A shard's graph moves once for each of its tasks, of QUERY_ROWS queries, which stream past it. Vectors move in the width
that they came in; cosines are computed in double precision for all that the beams found, and only pairs of at
least THRESHOLD link. A task gives link counts and a spanning forest of its links, so a group of k copies costs k rows,
not k squared; union-find joins the forests.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different lengths
don't link. Repeated rows count as so many vectors; of an id with different vectors the one with the smallest hashes
counts. Rows with a null id are never linked and are kept. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import components, with_component
from lodestone.llm.words import mix
from lodestone.shared import Scratch

THRESHOLD = 0.95
SHARDS = 8
SHARD_ROWS = 100_000
SHARD_BYTES = 64 << 20
QUERY_ROWS = 500_000
TASKS = 2
DEGREE = 16
BUILD_BEAM = 40
BEAM = 32
WIDEST = 256
AUDIT = 16
AUDIT_LINKS = 32
AUDIT_MOST = 256
RECALL = 0.99
BATCH = 256
_SLACK = 1e-4


def _choose(x: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """For each row the neighbours kept of candidates that come nearest first (-1: none): diverse ones, then the nearest."""
    n, width = ids.shape
    vectors = x[np.maximum(ids, 0)]
    between = np.einsum("ikd,ild->ikl", vectors, vectors, optimize=True)
    chosen = np.zeros((n, width), bool)
    for k in range(width):
        rival = np.where(chosen[:, :k], between[:, k, :k], -2).max(1, initial=-2)
        chosen[:, k] = (ids[:, k] >= 0) & (ids[:, k] != own) & (rival < sims[:, k]) & (chosen.sum(1) < degree)
    rank = np.where(chosen, np.arange(width), width + np.arange(width))
    rank = np.where((ids < 0) | (ids == own[:, None]), 4 * width, rank)
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, order, 1)
    return np.where(np.take_along_axis(rank, order, 1) >= 4 * width, -1, out)


class Layer:
    """One graph over some nodes of x."""

    def __init__(self, x: np.ndarray, degree: int, links: np.ndarray | None = None):
        self.x, self.degree = x, degree
        self.links = np.full((len(x), degree), -1, np.int32) if links is None else links

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's nodes, nearest first, and their cosines, by best-first search from entry nodes (a row a query)."""
        n = len(q)
        beam = min(beam, len(self.x))
        seen = np.zeros((n, len(self.x)), bool)
        at = np.arange(n)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2.0, np.float32)
        width = min(entry.shape[1], beam)
        ids[:, :width] = entry[:, :width]
        sims[:, :width] = np.where(entry[:, :width] >= 0, np.einsum("ikd,id->ik", self.x[np.maximum(entry[:, :width], 0)], q), -2)
        seen[at[:, None], np.maximum(ids[:, :width], 0)] = True
        fresh = ids >= 0
        live = at
        while len(live):
            score = np.where(fresh[live], sims[live], -3)
            picks = np.argsort(-score, axis=1)[:, :3]
            good = np.take_along_axis(score, picks, 1) > -3
            more = good.any(1)
            live, picks, good = live[more], picks[more], good[more]
            if not len(live):
                break
            nodes = np.where(good, ids[live[:, None], picks], -1)
            fresh[live[:, None], picks] &= ~good
            near = np.where(nodes[:, :, None] >= 0, self.links[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where((near >= 0) & ~seen[live[:, None], np.maximum(near, 0)], near, -1)
            rows, columns = np.nonzero(near >= 0)
            found = np.full(near.shape, -2.0, np.float32)
            seen[live[rows], near[rows, columns]] = True
            found[rows, columns] = np.einsum("kd,kd->k", self.x[near[rows, columns]], q[live[rows]])
            all_ids = np.concatenate([ids[live], near], 1)
            all_sims = np.concatenate([sims[live], found], 1)
            all_fresh = np.concatenate([fresh[live], found > -2], 1)
            order = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.tile(np.arange(beam), (len(live), 1))
            ids[live], sims[live], fresh[live] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_sims, all_fresh))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def insert(self, nodes: np.ndarray, entry: np.ndarray) -> None:
        """Adds nodes, searching from entry nodes that are in; nodes of one batch also see each other."""
        q = self.x[nodes]
        ids, sims = self.search(q, entry, BUILD_BEAM)
        mates = q @ q.T
        np.fill_diagonal(mates, -2)
        k = min(BUILD_BEAM // 2, len(nodes))
        best = np.argpartition(-mates, k - 1, axis=1)[:, :k]
        ids = np.concatenate([ids, nodes[best]], 1)
        sims = np.concatenate([sims, np.take_along_axis(mates, best, 1)], 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        kept = _choose(self.x, nodes, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), self.degree)
        self.links[nodes, : kept.shape[1]] = kept
        rows, columns = np.nonzero(kept >= 0)
        self._back(kept[rows, columns], nodes[rows])

    def _back(self, of: np.ndarray, new: np.ndarray) -> None:
        """Links back from nodes to new ones; a full list is chosen anew."""
        order = np.argsort(of, kind="stable")
        of, new = of[order], new[order]
        turn = np.arange(len(of)) - np.searchsorted(of, of)
        for r in range(0, int(turn.max(initial=-1)) + 1, self.degree):
            part = (turn >= r) & (turn < r + self.degree)
            some, back = np.unique(of[part], return_inverse=True)
            wide = np.full((len(some), 2 * self.degree), -1, np.int64)
            wide[:, : self.degree] = self.links[some]
            wide[back, self.degree + turn[part] - r] = new[part]
            sims = np.where(wide >= 0, np.einsum("ikd,id->ik", self.x[np.maximum(wide, 0)], self.x[some]), -2)
            order = np.argsort(-sims, axis=1, kind="stable")
            self.links[some] = _choose(self.x, some, np.take_along_axis(wide, order, 1), np.take_along_axis(sims, order, 1), self.degree)


class Graph:
    """Layers from the lowest (all nodes) up; layer l holds the first counts[l] nodes of x."""

    def __init__(self, x: np.ndarray, layers: list[Layer], counts: list[int]):
        self.x, self.layers, self.counts = x, layers, counts

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        """x: unit vectors in random order, so that the first ones are the upper layers' sample."""
        counts = [len(x)]
        while counts[-1] > 4 * DEGREE:
            counts.append(max(1, counts[-1] // DEGREE))
        out = cls(x, [], counts)
        for level in range(len(counts) - 1, -1, -1):
            own = x[: counts[level]]
            layer = Layer(own, 2 * DEGREE if level == 0 else DEGREE)
            first = counts[level + 1] if level + 1 < len(counts) else 1
            if level + 1 < len(counts):
                # The upper layer's nodes come first, joined by their nearest ones.
                layer.links[:first, : out.layers[0].links.shape[1]] = out.layers[0].links[:first][:, : layer.degree]
            done = first
            while done < counts[level]:
                step = min(BATCH, max(1, done), counts[level] - done)
                nodes = np.arange(done, done + step)
                entry = out.descend(x[nodes]) if out.layers else np.zeros((step, 1), np.int64)
                layer.insert(nodes, entry)
                done += step
            out.layers.insert(0, layer)
        return out

    def descend(self, q: np.ndarray, upto: int = 0) -> np.ndarray:
        """Entry nodes for the layer below the lowest one here."""
        entry = np.zeros((len(q), 1), np.int64)
        for layer in reversed(self.layers[upto:]):
            ids, _ = layer.search(q, entry, 4)
            entry = ids
        return entry

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = self.descend(q, 1) if len(self.layers) > 1 else np.zeros((len(q), 1), np.int64)
        return self.layers[0].search(q, entry, beam)


class Forest:
    """Union-find over whole numbers below n."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, a: np.ndarray) -> np.ndarray:
        out = self.up[a]
        while True:
            after = self.up[out]
            if np.array_equal(after, out):
                self.up[a] = out
                return out
            out = after

    def union(self, a: np.ndarray) -> list[tuple[int, int]]:
        """Joins all of a; the edges that were needed."""
        roots, first = np.unique(self.roots(a), return_index=True)
        if len(roots) < 2:
            return []
        self.up[roots] = roots[0]
        return [(int(a[first[0]]), int(a[i])) for i in first[1:]]


def links_of(graph: Graph, exact: np.ndarray, q: np.ndarray, threshold: float, beam: int) -> list[np.ndarray]:
    """For each query (unit rows in double precision) the nodes whose cosine reaches the threshold, by beams as wide as needed."""
    n, out, wanted, low = len(graph.x), [np.zeros(0, np.int64)] * len(q), np.arange(len(q)), np.float32(threshold - _SLACK)
    q32 = q.astype(np.float32)
    while len(wanted):
        beam = min(beam, n)
        again = []
        for i in range(0, len(wanted), BATCH):
            part = wanted[i : i + BATCH]
            if beam == n:
                near = q32[part] @ graph.x.T >= low
                ids = [np.flatnonzero(x) for x in near]
            else:
                found, sims = graph.search(q32[part], beam)
                full = sims[:, -1] >= low
                again.append(part[full])
                ids = [f[(s >= low) & (f >= 0)] for f, s in zip(found, sims, strict=True)]
            for k, at in zip(part.tolist(), ids, strict=True):
                out[k] = at[exact[at] @ q[k] >= threshold] if len(at) else at
        wanted, beam = np.concatenate(again) if again else np.zeros(0, np.int64), 4 * beam if 4 * beam <= WIDEST else n
    return out


def planted(exact: np.ndarray, threshold: float) -> np.ndarray:
    """Up to AUDIT queries that link with a vector of the shard, by a tenth of the way from the threshold to 1."""
    x = exact[np.unique(np.linspace(0, len(exact) - 1, min(AUDIT, len(exact))).astype(int))]
    side = np.random.default_rng(22).normal(size=x.shape)
    side -= np.einsum("ij,ij->i", side, x)[:, None] * x
    side /= np.maximum(np.sqrt(np.einsum("ij,ij->i", side, side)), 1e-9)[:, None]
    cosine = threshold + (1 - threshold) / 10
    return _unit(cosine * x + math.sqrt(1 - cosine * cosine) * side)


def audit_beam(graph: Graph, exact: np.ndarray, threshold: float) -> tuple[int, int, int]:
    """The beam with which drawn vectors of the shard, and planted ones, each find RECALL of their links to others; those links, and how many were found."""
    n, step = len(exact), max(1, len(exact) // AUDIT_MOST)
    drawn, links = [], 0
    for i in range(0, n, step):
        drawn.append(i)
        links += int((exact @ exact[i] >= threshold).sum()) - 1
        if links >= AUDIT_LINKS and len(drawn) >= AUDIT:
            break
    made = planted(exact, threshold)
    own, totals, beam = exact[drawn], (links, sum(int((exact @ v >= threshold).sum()) for v in made)), BEAM
    while True:
        # A drawn vector is a link of its own, which counts on neither side.
        hits = sum(int((at != i).sum()) for i, at in zip(drawn, links_of(graph, exact, own, threshold, beam), strict=True)), sum(map(len, links_of(graph, exact, made, threshold, beam)))
        if beam >= n or all(h >= RECALL * t for h, t in zip(hits, totals, strict=True)):
            return beam, sum(totals), sum(hits)
        beam *= 2


def _flat(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


GRAPH = "ids binary, sizes binary, vectors binary, counts array<bigint>, layers array<binary>"


def build(table: pa.Table) -> pa.Table:
    """One row with a shard's graph: ids, sizes, vectors as they came, layers."""
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    ids = np.asarray(table["rep"])
    order = np.argsort(mix(ids.astype(np.uint64), 21), kind="stable")
    raw = np.ascontiguousarray(_flat(table["v"], dim)[order])
    graph = Graph.build(_unit(raw).astype(np.float32))
    layers = [layer.links.tobytes() for layer in graph.layers]
    return pa.table({"dim": [dim], "shard": [shard], "ids": [ids[order].tobytes()], "sizes": [np.asarray(table["size"])[order].tobytes()], "vectors": [raw.tobytes()], "counts": [graph.counts], "layers": pa.array([layers], pa.list_(pa.binary()))}, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("vectors", pa.binary()), ("counts", pa.list_(pa.int64())), ("layers", pa.list_(pa.binary()))]))


class Shard:
    """A shard's graph, its exact unit vectors, and what was asked of it."""

    def __init__(self, row: dict, threshold: float, kind: type):
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.exact = _unit(np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"]))
        x = self.exact.astype(np.float32)
        layers = [Layer(x[:n], 0, np.frombuffer(b, np.int32).reshape(n, -1)) for n, b in zip(row["counts"], row["layers"], strict=True)]
        self.graph, self.forest, self.threshold = Graph(x, layers, row["counts"]), Forest(len(x)), threshold
        self.beam, self.asked, self.found = audit_beam(self.graph, self.exact, threshold)

    def ask(self, reps: np.ndarray, q: np.ndarray) -> tuple[list, list, list]:
        """Rows a, b, links: a class and itself with its links here, and edges that join it with them."""
        a, b, n = [], [], []
        for k, at in enumerate(links_of(self.graph, self.exact, q, self.threshold, self.beam)):
            at = at[self.ids[at] != reps[k]]
            if len(at):
                a += [reps[k], reps[k]]
                b += [reps[k], self.ids[at[0]]]
                n += [int(self.sizes[at].sum()), 0]
                for u, v in self.forest.union(at):
                    a.append(self.ids[u])
                    b.append(self.ids[v])
                    n.append(0)
        return a, b, n


def _query(threshold: float, kind: type):
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "links", "asked", "found")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("dim", "shard", "task")], 1)
            graph_row = np.asarray(batch.column("kind")) == 0
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1) | graph_row[:-1] | graph_row[1:], [True])))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if graph_row[i]:
                    row = {c: batch.column(c)[i].as_py() for c in ("dim", "ids", "sizes", "vectors", "counts", "layers")}
                    key, shard = tuple(keys[i]), Shard(row, threshold, kind)
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, None, shard.asked, shard.found)], schema=schema)
                    continue
                if key != tuple(keys[i]):
                    continue  # no vector of this length in this shard
                reps, q = np.asarray(batch.column("rep").slice(i, j - i)), _unit(_flat(batch.column("v").slice(i, j - i), int(keys[i][0])))
                a, b, n = shard.ask(reps, q)
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), none, none], schema=schema)

    return work


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, shards: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links (other vectors linked directly), component_id, kept, and of all audits the links that were there and those found."""
    scratch = Scratch(df.sparkSession)
    raw = F.col(f"`{vector_col}`")
    single = df.schema[vector_col].dataType.elementType.simpleString() == "float"
    v = raw.cast("array<double>")
    sound = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))
    good = rows.where(F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull()).withColumn("v", F.expr("transform(v, x -> x + 0.0D)"))
    good = good.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    # Single precision came in as such, and goes on as such without a loss.
    good = scratch.save(good.withColumn("v", F.col("v").cast("array<float>")) if single else good)
    kinds = good.select("id", "h1", "h2").distinct()
    twice = kinds.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h1", "h2")).alias("k")).where("n > 1").select("id", "k")
    other = kinds.join(twice, "id").where("struct(h1, h2) <> k").select("id", "h1", "h2")
    good = good.join(other, ["id", "h1", "h2"], "left_anti")
    keys = good.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    member = scratch.save(good.join(keys, ["h1", "h2"]).select("id", "rep", "size", F.when(F.col("id") == F.col("rep"), F.col("v")).alias("v")))
    classes = scratch.save(member.where("v is not null").dropDuplicates(["rep"]).select("rep", "size", "v", F.size("v").alias("dim")))
    n, widest = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    shards = shards or max(SHARDS, math.ceil(n / SHARD_ROWS), math.ceil(n * (widest or 0) * 4 / SHARD_BYTES))
    tasks = max(TASKS, math.ceil(n / QUERY_ROWS))
    dealt = classes.withColumn("shard", F.expr(f"cast(pmod(xxhash64(rep), {shards}) as int)"))
    graphs = scratch.save(dealt.groupBy("dim", "shard").applyInArrow(build, f"dim int, shard int, {GRAPH}"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    held = graphs.select("dim", "shard", every(tasks).alias("task"), F.lit(0).alias("kind"), "ids", "sizes", "vectors", "counts", "layers")
    asked = classes.select("dim", every(shards).alias("shard"), F.expr(f"cast(pmod(xxhash64(rep, 1), {tasks}) as int)").alias("task"), F.lit(1).alias("kind"), "rep", "v")
    # A partition a task: its graph comes first, and its queries stream past it.
    both = held.unionByName(asked, allowMissingColumns=True).repartitionById(shards * tasks, F.expr(f"shard * {tasks} + task"))
    found = scratch.save(both.sortWithinPartitions("dim", "shard", "task", "kind").mapInArrow(_query(threshold, np.float32 if single else np.float64), "a bigint, b bigint, links bigint, asked bigint, found bigint"))
    scratch.drop(graphs)
    audits = found.where("asked is not null").agg(F.coalesce(F.sum("asked"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
    links = found.where("a = b").groupBy(F.col("a").alias("_rep")).agg(F.sum("links").alias("links"))
    joined = scratch.save(components(found.where("a <> b").select("a", "b"), scratch))
    named = member.select("id", "rep", "size").dropDuplicates(["id"])
    named = named.join(links, F.col("rep") == F.col("_rep"), "left").select("id", "rep", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("bigint").alias("n_links"))
    named = with_component(joined, named, "rep", "c").select(F.col("id").alias("_id"), "n_links", "c")
    out = rows.select("id").join(named, F.col("id") == F.col("_id"), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
    return out.withColumns({"audit_links": F.lit(audits[0]).cast("bigint"), "audit_found": F.lit(audits[1]).cast("bigint")})
