"""Operator 4: toxicity by cumulative-link ordinal regression.

Labels say toxic or not; grades 0..3 of labelled rows come from them and from what models that haven't seen a row think of
it: 0 where the label is 0; where it is 1, the third of the toxic rows into which the row falls by its probability under
a two-grade regression fitted on the other two thirds of the rows (cross-fitting). P(grade <= j) is
sigmoid(threshold_j - w.x) with one weight vector w for all thresholds, which are kept in order; x says which features
a text has. Features are hashed words and word prefixes whose share of the labelled toxic texts exceeds that of the others by more than Z
standard errors, however many there are. The output is the grade's expectation and the probabilities.

Fitting takes at most FIT_ROWS labelled rows (those of the smallest seeded hash of the id); all else covers all rows.
Null or empty texts have no features: their severity is that of the thresholds alone and they are not toxic. Rows
with a null label aren't fitted; repeated rows are scored each. Without labelled rows of both kinds nothing is toxic
and the severity is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import uniform
from lodestone.llm.words import NON_ALNUM, Texts, mix, pieces, span_hashes, word_spans

FIT_ROWS = 20_000
BITS = 20
PREFIXES = (5, 6, 7)
Z = 5.0
LEAST = 3
CROSS = 3
GRADES = 4


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and prefixes, and the text of each."""
    starts, ends, first = word_spans(texts, NON_ALNUM)
    rows = np.repeat(np.arange(len(texts)), np.diff(first))
    out, of = [], []
    for n in (0, *PREFIXES):
        long = np.flatnonzero(ends - starts > n)
        a = starts[long]
        h = span_hashes(texts, a, a + n if n else ends[long])
        out.append((mix(h, n) >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(rows[long])
    return np.concatenate(out), np.concatenate(of)


def distinct(numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once for each text."""
    key = np.unique(rows << BITS | numbers)
    return key & ((1 << BITS) - 1), key >> BITS


@dataclass
class Model:
    numbers: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: Texts) -> np.ndarray:
        """w.x of each text."""
        if not len(self.numbers):
            return np.zeros(len(texts))
        found, rows = features(texts)
        table = np.zeros(1 << BITS, np.int32)
        table[self.numbers] = np.arange(1, len(self.numbers) + 1)
        place = table[found]
        kept = place > 0
        n, r = distinct(found[kept], rows[kept])
        return np.bincount(r, self.weights[table[n] - 1], len(texts))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = 0), ..., P(grade = highest) in columns."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))
        edges = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], 1)
        return np.diff(edges, axis=1)


def fit_link(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int = GRADES, ridge: float = 0.5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient ascent (Adam) of the penalised likelihood.

    Thresholds are the first one plus sums of exponentials, so they can't cross.
    """
    n = len(grades)
    share = np.clip([np.mean(grades <= j) for j in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n_features), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(n)
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(np.clip(p[n_features + 1 :], -10, 10))
        cut = p[n_features] + np.concatenate(([0], np.cumsum(gaps)))
        z = np.bincount(rows, w[columns], n) if len(rows) else np.zeros(n)
        below = 1 / (1 + np.exp(-np.clip(cut[None, :] - z[:, None], -50, 50)))
        edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        slope = edges * (1 - edges)
        chance = np.maximum(edges[at, grades + 1] - edges[at, grades], 1e-12)
        g_z = -(slope[at, grades + 1] - slope[at, grades]) / chance
        g_cut = np.array([np.sum(slope[at, j + 1] * ((grades == j) - 1.0 * (grades == j + 1)) / chance) for j in range(n_grades - 1)])
        g = np.empty_like(p)
        g[:n_features] = np.bincount(columns, g_z[rows], n_features) - ridge * w if len(rows) else -ridge * w
        g[n_features] = g_cut.sum()
        g[n_features + 1 :] = np.cumsum(g_cut[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(np.clip(p[n_features + 1 :], -10, 10))
    return p[:n_features], p[n_features] + np.concatenate(([0], np.cumsum(gaps)))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT_ROWS, seed: int = 5) -> Model:
    """A model from at most `most` labelled rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    some = known.orderBy(uniform(F.col("id"), seed=seed), "id").limit(most)
    # At most `most` rows of two numbers; of an id's texts one counts, whichever hash is smallest, so that a row an id is fitted.
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    rows = rows.groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("y", "id", "one.text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, seen = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in pieces(batches):
            y = np.minimum(np.asarray(batch.column("y")), 1)
            n, r = distinct(*features(Texts(batch.column("text"))))
            for k in (0, 1):
                tally[k] += np.bincount(n[y[r] == k], minlength=1 << BITS)
                seen[k] += np.sum(y == k)
        at = np.flatnonzero(tally.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], at))), pa.array(np.concatenate((seen[:1], tally[0, at]))), pa.array(np.concatenate((seen[1:], tally[1, at])))], names=["number", "clean", "toxic"])

    sums = rows.mapInArrow(count, "number bigint, clean bigint, toxic bigint").groupBy("number").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = sums.where("number = -1").first()
    totals = (totals["clean"], totals["toxic"]) if totals else (0, 0)
    if not all(totals):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 50.0))
    shares = F.col("toxic") / totals[1] - F.col("clean") / totals[0]
    pool = (F.col("toxic") + F.col("clean")) / sum(totals)
    error = F.sqrt(F.greatest(pool * (1 - pool), F.lit(1e-12)) * (1 / totals[0] + 1 / totals[1]))
    # Features are at most 2 ** BITS, and come from at most `most` rows.
    found = sums.where((F.col("number") >= 0) & (F.col("toxic") >= LEAST) & (shares > Z * error)).select("number").collect()
    numbers = np.array(sorted(r["number"] for r in found), np.int64)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << BITS, -1, np.int32)
        table[numbers] = np.arange(len(numbers))
        for batch in pieces(batches):
            f, r = features(Texts(batch.column("text")))
            kept = table[f] >= 0
            n, r = distinct(f[kept], r[kept])
            ends = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=batch.num_rows))))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(table[n]))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("id"), lists], names=["y", "id", "has"])

    # Arrow's batches: rows of lists would each be pickled and boxed, number by number, in the driver's two processes.
    known_rows = rows.mapInArrow(present, f"y int, id {rows.schema['id'].dataType.simpleString()}, has array<int>").toArrow().sort_by("id")
    has = known_rows["has"].combine_chunks()
    ends = np.concatenate(([0], np.cumsum(np.asarray(has.value_lengths(), np.int64))))
    flat = np.asarray(has.flatten(), np.int64)
    own = [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    toxic = np.asarray(known_rows["y"]) > 0
    grades = cross_fitted_grades(own, toxic, len(numbers))
    weights, thresholds = fit_link(np.repeat(np.arange(len(own)), [len(x) for x in own]), flat, grades, len(numbers))
    return Model(numbers, weights, thresholds)


def cross_fitted_grades(own: list[np.ndarray], toxic: np.ndarray, n_features: int) -> np.ndarray:
    """0 for clean rows; 1 to 3 for toxic ones, by thirds of the probability that models fitted without the row give it."""
    score, fold = np.zeros(len(own)), np.arange(len(own)) % CROSS
    for k in range(CROSS):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(train) and len(test):
            rows = np.repeat(np.arange(len(train)), [len(own[i]) for i in train])
            columns = np.concatenate([own[i] for i in train])
            w, cut = fit_link(rows, columns, toxic[train].astype(int), n_features, 2, steps=150)
            score[test] = [w[own[i]].sum() - cut[0] for i in test]
    low, high = np.quantile(score[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (score > low) + (score > high), 0)


OUT = "severity double, p_toxic double, p_grade_1 double, p_grade_2 double, p_grade_3 double, toxic boolean"


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id (and the columns named in keep) with the expected severity, grades' probabilities and the decision."""
    keep = keep or []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            p = model.probabilities(model.scores(Texts(batch.column("_text"))))
            severity, toxic = p @ np.arange(GRADES), 1 - p[:, 0]
            arrays = [severity, toxic, p[:, 1], p[:, 2], p[:, 3], toxic >= 0.5]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + [pa.array(a) for a in arrays], names=names + [x.split()[0] for x in OUT.split(", ")])

    names = [f"_keep{i}" for i in range(1 + len(keep))]
    columns = [id_col, *keep]
    rows = df.selectExpr(*[f"`{c}` {n}" for c, n in zip(columns, names, strict=True)], f"`{text_col}` _text")
    out = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + [OUT])
    return rows.mapInArrow(work, out).selectExpr(*[f"{n} `{c}`" for n, c in zip(names, columns, strict=True)], *[x.split()[0] for x in OUT.split(", ")])


def reject(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is not toxic, as they were."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            p = model.probabilities(model.scores(Texts(batch.column(text_col))))
            yield batch.filter(pa.array(1 - p[:, 0] < 0.5))

    return df.mapInArrow(work, df.schema)
