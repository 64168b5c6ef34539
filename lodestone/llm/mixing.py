"""Operator 7: mixing sources to target weights by Pfair scheduling, with SQL functions only.

Rows of a source are shuffled and cut into blocks. The targets are a fluid that gives each source its exact weight's
share of every place; once a source is used up, the others share its places by their weights. A block is released at the
floor of the place where the fluid reaches its start and due at the ceiling of that where it reaches its end; in each
place the released block that is due first goes. Every block keeps its window, so every prefix holds each source's
share of the given weights to less than one block, at any size; all rows are placed, none is dropped or repeated.

The windows come from whole numbers (weights are scaled to such without rounding). Placing them is a walk over blocks,
not rows, made on the driver with the plan; it holds a number of sources and a table of blocks.

A source without a positive weight gets the smallest one. Without weights, a source's target is the square root of its row
count. A null source is a source of its own. Ties are ordered by id, then the text's checksum. An empty table gives no
rows. All columns are kept, whatever their names: a made column whose name is taken gets underscores behind it.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm.cluster import bins_for, ranked, uniform
from lodestone.shared import free_names

BLOCK = 16
#: Up to so many source bins or blocks a table of them is broadcast.
MOST_BINS = 1 << 18
MOST_BLOCKS = 1 << 18
#: What mix_sources adds.
MADE = ("_position", "_place", "_block", "_release", "_due")


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block, release, due) place by place: earliest deadline first among released blocks."""
    exact = {s: Fraction(weights[s]) for s, n in blocks.items() if n}
    scale = lcm(*[w.denominator for w in exact.values()])
    whole = {s: int(w * scale) for s, w in exact.items()}
    # Sources by where the fluid ends them; blocks ended before and weight left after each end.
    ends = sorted((Fraction(blocks[s], w), w, blocks[s]) for s, w in whole.items())
    spots, ended, live = [float(e[0]) for e in ends], [0], [sum(whole.values())]
    for _, w, n in ends:
        ended.append(ended[-1] + n)
        live.append(live[-1] - w)

    def reached(s: object, j: int) -> tuple[int, int]:
        """Floor and ceiling of the place where the fluid has given j blocks of s."""
        w = whole[s]
        k = bisect_right(spots, j / w)
        while k and j * ends[k - 1][1] < ends[k - 1][2] * w:
            k -= 1
        while k < len(ends) and j * ends[k][1] >= ends[k][2] * w:
            k += 1
        place, rest = divmod(j * live[k], w)
        return ended[k] + place, ended[k] + place + (rest > 0)

    names = {s: (s is None, str(s)) for s in whole}
    order = {s: k for k, s in enumerate(sorted(whole, key=names.__getitem__))}
    by = list(order)
    waiting, ready = [], []
    for s, k in order.items():
        free, due = reached(s, 1)
        waiting.append((0, due, k, 0, free))
    heapq.heapify(waiting)
    for place in range(sum(blocks[s] for s in whole)):
        while waiting and waiting[0][0] <= place:
            release, due, k, j, free = heapq.heappop(waiting)
            heapq.heappush(ready, (due, k, j, release, free))
        due, k, j, release, free = heapq.heappop(ready)
        s = by[k]
        yield s, j, release, due
        if j + 1 < blocks[s]:
            then, due = reached(s, j + 2)
            heapq.heappush(waiting, (free, due, k, j + 1, then))


def period(shares: dict) -> list[tuple]:
    """The places 0..P-1 of whole shares: (source, block)."""
    return [(s, j) for s, j, _, _ in schedule(shares, shares)]


def mix_sources(df: DataFrame, weights: dict | None = None, seed: int = 23, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows with _position (the block's place times the block's size, plus the place in the block), _place, _block, _release and _due."""
    spark = df.sparkSession
    position, place_at, block_at, release_at, due_at, dice, rank, of, number_of = free_names(df.columns, *MADE, "_dice", "_rank", "_s", "_b")
    made = [of, number_of, place_at, release_at, due_at]
    source, own_id = F.col(f"`{source_col}`"), F.col(f"`{id_col}`")
    counts = {r[0]: r[1] for r in df.groupBy(source).count().collect()}
    weights = {s: float(weights.get(s, 0) or 0) for s in counts} if weights else {s: n**0.5 for s, n in counts.items()}
    small = min([w for w in weights.values() if w > 0], default=1.0)
    weights = {s: w if w > 0 else small for s, w in weights.items()}
    number, columns = {s: k for k, s in enumerate(counts)}, [array("q") for _ in made]
    for place, (s, j, release, due) in enumerate(schedule({s: -(-n // block) for s, n in counts.items()}, weights)):
        for c, v in zip(columns, (number[s], j, place, release, due)):
            c.append(v)
    kind = df.schema[source_col].dataType
    sources = pa.array(list(counts), to_arrow_type(kind)).take(pa.array(columns[0], pa.int64()))
    table = pa.table([sources, *[pa.array(c, pa.int64()) for c in columns[1:]]], names=made)
    plan = spark.createDataFrame(table, StructType([StructField(n, LongType() if k else kind) for k, n in enumerate(made)]))
    bins = bins_for(sum(counts.values()))
    rows = df.withColumn(dice, uniform(own_id, F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")), seed=seed))
    slim = ranked(rows, [source_col], [F.col(dice), own_id], F.floor(F.col(dice) / F.lit(float(2**52) / bins)), rank, bounded=len(counts) * bins <= MOST_BINS).withColumn(block_at, F.expr(f"{rank} div {block}"))
    on = source.eqNullSafe(F.col(of)) & (F.col(block_at) == F.col(number_of))
    out = slim.join(F.broadcast(plan) if table.num_rows <= MOST_BLOCKS else plan, on)
    out = out.withColumn(position, F.expr(f"{place_at} * {block} + {rank} % {block}"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], position, place_at, block_at, release_at, due_at)


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows in the order of the mixture, with their own columns."""
    (position,) = free_names(df.columns, MADE[0])
    return mix_sources(df, **options).orderBy(position).select(*[F.col(f"`{c}`") for c in df.columns])
