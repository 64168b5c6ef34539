"""Operator 2: near duplicates by SuperMinHash, banding, verification and union-find.

A text's set holds the 64-bit hashes of its distinct five-word shingles (words split at ASCII white space, A-Z in lower
case; fewer words: the whole sequence; none: the empty set, linked with nothing). Texts with equal sets (by size and a
128-bit cryptographic digest of the whole ordered set) are one class; the class's smallest id stands for it from there on. In a SuperMinHash signature each element gives slot values
j + r_j at places of its own random permutation; rounds j go on only while a slot could still fall, so that most
elements cost one round, and the correlated ranks lower the variance.

32 bands of 4 of the 128 slots give buckets; at a similarity of 0.75 two sets share none with a chance of 5e-6. In a bucket all are first
held against its smallest id, then against others of its largest component, and at last every two
of different components that a bucket still holds and whose parity bitmaps allow a link: each shingle flips one of PARITY_BITS bits, so two bitmaps
differ in no more bits than the sets differ in shingles. So no link between components is lost, while groups of copies
cost a few comparisons for each member. Every link is confirmed on the full sets.

A null text counts as empty. Rows that repeat an id are returned each; an id names one text (with several texts, one of
them is compared). Rows with a null id are never linked and are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import likely_in, linked_components, shared_buckets, with_component
from lodestone.llm.words import SPACES, Texts, gram_hashes, mix, pieces, runs, span_hashes, word_spans
from lodestone.shared import Scratch

WORDS = 5
SLOTS = 128
BANDS = 32
PERCENT = 75
PARITY_BITS = 2048
_NONE = np.iinfo(np.int64).max
_LIVE = 1 << 16


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All sets one after another, each in order, and their sizes."""
    starts, ends, first = word_spans(texts, SPACES)
    hashes = span_hashes(texts, starts, ends)
    at, counts = runs(first, WORDS)
    grams = gram_hashes(hashes, at, WORDS)
    words, out, ends = np.diff(first), [], np.cumsum(counts)
    for i, (n, k) in enumerate(zip(words.tolist(), counts.tolist(), strict=True)):
        if k:
            out.append(np.unique(grams[ends[i] - k : ends[i]]))
        else:
            out.append(mix(gram_hashes(hashes, first[i : i + 1], n), n) if n else np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def _draw(elements: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Round j's place from j on, and its value."""
    x = mix(elements, 100 + j)
    return (j + ((x >> np.uint64(32)) * np.uint64(SLOTS - j) >> np.uint64(32))).astype(np.int64), ((j << 32) + (x & np.uint64(0xFFFFFFFF)).astype(np.int64))


def signatures(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SuperMinHash of each set: one row of SLOTS whole numbers, (j + r_j) * 2**32."""
    out = np.full((len(sizes), SLOTS), _NONE, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    place, value = _draw(flat, 0)
    np.minimum.at(out.reshape(-1), rows * SLOTS + place, value)
    open_rows = (out.max(1) >= 1 << 32) & (sizes > 0)
    live = np.flatnonzero(open_rows[rows])
    i = 0
    while i < len(live):
        j = min(len(live), i + _LIVE)
        if j < len(live):  # whole sets
            row = rows[live[j]]
            j = int(np.searchsorted(rows[live], row))
            j = j if j > i else int(np.searchsorted(rows[live], row, "right"))
        _later_rounds(flat[live[i:j]], rows[live[i:j]], place[live[i:j]], out)
        i = j
    return out


def _later_rounds(elements: np.ndarray, rows: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
    """Rounds from 1 on: each element's permutation by swaps, until no slot of its set can fall."""
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(elements), 1))
    own = np.arange(len(elements))
    order[own, first] = 0
    order[:, 0] = first
    for j in range(1, SLOTS):
        at, value = _draw(elements, j)
        slot = order[own, at]
        order[own, at] = order[:, j]
        order[:, j] = slot
        np.minimum.at(out.reshape(-1), rows * SLOTS + slot, value)
        some = np.unique(rows)
        done = np.zeros(rows[-1] + 1, bool)
        done[some] = out[some].max(1) < (j + 1) << 32
        keep = ~done[rows]
        if not keep.all():
            if not keep.any():
                return
            elements, rows, order = elements[keep], rows[keep], order[keep]
            own = np.arange(len(elements))


def band_keys(signature: np.ndarray) -> np.ndarray:
    wide = signature.astype(np.uint64).reshape(len(signature), BANDS, SLOTS // BANDS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(wide.shape[2]):
            key = mix(key * np.uint64(0xD1342543DE82EF95) + wide[:, :, i], 3)
    return key.view(np.int64)


def parities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each set's bitmap, of which every element flips one bit: PARITY_BITS / 64 numbers a row."""
    width = PARITY_BITS // 64
    out = np.zeros(len(sizes) * width, np.uint64)
    at = mix(flat, 13)
    rows = np.repeat(np.arange(len(sizes)), sizes) * width + ((at >> np.uint64(6)) % np.uint64(width)).astype(np.int64)
    np.bitwise_xor.at(out, rows, np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64).reshape(-1, width)


def sketches(df: DataFrame) -> DataFrame:
    """Of rows id, text: id, n_shingles, the set's digest as two numbers, and its band keys (none for the empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            flat, sizes = shingle_sets(Texts(batch.column("text")))
            keys = band_keys(signatures(flat, sizes))[sizes > 0]
            cut = np.concatenate(([0], np.cumsum(sizes))) * 8
            whole = memoryview(np.ascontiguousarray(flat)).cast("B")
            digests = b"".join(hashlib.blake2b(whole[i:j], digest_size=16).digest() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            digests = np.frombuffer(digests, np.int64).reshape(-1, 2)
            ends = np.concatenate(([0], np.cumsum((sizes > 0) * BANDS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), bands], names=["id", "n_shingles", "h1", "h2", "bands"])

    return df.mapInArrow(work, f"id {df.schema['id'].dataType.simpleString()}, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>")


def full_sets(df: DataFrame) -> DataFrame:
    """Of rows id, text: id, the set, its parity bitmap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            flat, sizes = shingle_sets(Texts(batch.column("text")))
            parity = parities(flat, sizes)
            lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(x)) for e, x in ((np.concatenate(([0], np.cumsum(sizes))), flat.view(np.int64)), (np.arange(len(sizes) + 1) * parity.shape[1], parity.reshape(-1)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "grams", "parity"])

    return df.mapInArrow(work, f"id {df.schema['id'].dataType.simpleString()}, grams array<bigint>, parity array<bigint>")


def _alike(n: str, m: str) -> str:
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable), kept (whether that is the row's own)."""
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    nodes = scratch.save(sketches(rows))
    classes = nodes.where("n_shingles > 0 and id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("rep"))
    classes = classes.select("h1", "h2", F.col("n_shingles").alias("n"), "rep")
    joined = nodes.alias("x").join(classes.alias("c"), F.expr("x.h1 = c.h1 and x.h2 = c.h2 and x.n_shingles = c.n and x.id is not null"), "left")
    member = scratch.save(joined.select("id", "n_shingles", F.coalesce("rep", "id").alias("rep"), F.expr("case when id = rep then bands end").alias("bands")))
    scratch.drop(nodes)

    entries = member.where("bands is not null").select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n"))
    shared = shared_buckets(entries, scratch)
    wanted = scratch.save(shared.select("id").distinct())
    sets = likely_in(rows, "id", wanted, "id").join(wanted, "id", "left_semi").dropDuplicates(["id"])
    sets = scratch.save(full_sets(sets))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs a, b: the links among them."""
        one = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
        both = one.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
        return both.where(f"100 * both >= {PERCENT} * (size(x) + size(y) - both)").select("a", "b")

    differ = " + ".join(f"bit_count(p.parity[{i}] ^ m.parity[{i}])" for i in range(PARITY_BITS // 64))
    close = f"{100 + PERCENT} * ({differ}) <= {100 - PERCENT} * (p.n + m.n)"
    profile = sets.select("id", "parity")
    found = linked_components(shared, _alike, verified, scratch, profile=profile, close=close)
    scratch.keep_only(member, found)
    out = with_component(found, member.drop("bands"), "rep", "component_id")
    out = out.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return out.withColumnRenamed("id", id_col)
