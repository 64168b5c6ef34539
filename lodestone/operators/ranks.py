"""Running sums, numbers, ranks and percentiles over a total order, without one task that sorts a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import Scratch, free_names

HEX_BINS = 3
#: Ranges of a value's order: a range of a group holds about that share of all rows' distinct values at most.
RANGES = 64


def hash_bin(hexadecimal: Column) -> Column:
    """A bin in the order of a hexadecimal hash, one of 16 ** HEX_BINS."""
    return F.conv(F.substring(hexadecimal, 1, HEX_BINS), 16, 10).cast("int")


def prefix_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], bins: Column | None = None) -> DataFrame:
    """The rows with each named sum over the rows before them in the group's order (0 for the first).

    Sums are taken within parts of the order, and added to the sums of the parts before (a table of groups times parts).
    With `bins`, an expression of the row that never falls along the order, its values are the parts. Without, rows are
    ranged over partitions and written with their partition's number, so that both branches read the same parts.
    """
    part, base, *own = free_names(df.columns, "_part", "_base_part", *[f"_base_{k}" for k in sums], *[f"_by_{c}" for c in by])
    before, keys = own[: len(sums)], own[len(sums) :]
    if bins is None:
        rows = Scratch(df.sparkSession).save(df.repartitionByRange(*[F.col(f"`{c}`") for c in by], *order).withColumn(part, F.spark_partition_id()))
    else:
        rows = df.withColumn(part, bins)
    groups = [F.col(f"`{c}`") for c in by]
    totals = rows.groupBy(*groups, part).agg(*[F.sum(c).alias(k) for c, k in zip(sums.values(), before, strict=True)])
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[c.alias(k) for c, k in zip(groups, keys, strict=True)], F.col(part).alias(base), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in before])
    inside = Window.partitionBy(*groups, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    on = [c.eqNullSafe(F.col(k)) for c, k in zip(groups, keys, strict=True)] + [F.col(part) == F.col(base)]
    # Without groups the table has a row a part, whose number doesn't grow with the rows of a part.
    out = rows.join(totals if by else F.broadcast(totals), on, "left")
    return out.withColumns({k: F.col(k) + F.col(b) for k, b in zip(sums, before, strict=True)}).drop(part, base, *before, *keys)


def value_bins(df: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """The number of a numeric value's range, in the order of values (nulls first): ranges lie between approximate quantiles
    of all rows, from one aggregate, and are told by comparisons alone, so that no row is written or sorted for them."""
    value = F.col(f"`{column}`").cast("double")
    sound = df.where(value.isNotNull() & ~F.isnan(value))
    found = sound.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 4 * ranges)).first()[0]
    edges = F.array(*[F.lit(x) for x in sorted(set(found or []))]).cast("array<double>")
    return F.when(value.isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e <= value)))


def numbered(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None, bins: Column | None = None) -> DataFrame:
    """The rows with their gapless number from 0 in the group's order, which must be total for a stable result."""
    return prefix_sums(df, by or [], order, {name: F.lit(1).cast("bigint")}, bins)


def even_parts(number: Column, total: int | Column, k: int) -> Column:
    """The part 1..k of a number from 0 when `total` rows are cut into k parts, of which the first ones have one row more."""
    n = F.lit(total) if isinstance(total, int) else total
    size, more = F.floor(n / k), n % k
    split = more * (size + 1)
    part = F.when(number < split, F.floor(number / (size + 1))).otherwise(more + F.floor((number - split) / F.greatest(size, F.lit(1))))
    return (part + 1).cast("bigint")


def average_ranks(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """The rows with the rank of a column's value, ties at their mean: counts by distinct value come first."""
    n, before, value, *keys = free_names(df.columns, "_n", "_before", "_value", *[f"_key_{c}" for c in by])
    counts = df.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{column}`").alias(value)).agg(F.count(F.lit(1)).alias(n))
    ranked = prefix_sums(counts, keys, [F.col(value)], {before: F.col(n)}, value_bins(counts, value))
    table = ranked.select(*keys, value, (F.col(before) + (F.col(n) + 1) / F.lit(2.0)).alias(name))
    on = [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip([*by, column], [*keys, value], strict=True)]
    return df.join(table, on).drop(value, *keys)


def percentiles(df: DataFrame, by: list[str], column: str, shares: list[float], name: str = "q") -> DataFrame:
    """A row a group with an array of exact percentiles, interpolated, of the values that are not null.

    By refinement: a group's values are counted by range, and only the ranges that hold a wanted place are ordered.
    """
    value, n = F.col(f"`{column}`").cast("double"), F.col("_n")
    rows = df.where(value.isNotNull())
    counts = rows.groupBy(*[F.col(f"`{c}`") for c in by], value.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    counts = Scratch(df.sparkSession).save(counts)
    counts = counts.withColumn("_bin", value_bins(counts, "_value"))
    keys, group = [f"_of_{c}" for c in by], Window.partitionBy(*[f"_of_{c}" for c in by])
    totals = counts.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col("_bin").alias("_at")).agg(F.sum("_n").alias("_in"))
    earlier = F.sum("_in").over(group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumns({"_base": F.coalesce(earlier, F.lit(0)), "_total": F.sum("_in").over(group)})
    spots = [(i, side, f(F.lit(float(share)) * (F.col("_total") - 1))) for i, share in enumerate(shares) for side, f in (("low", F.floor), ("high", F.ceil))]
    holds = lambda low, size, spot: (low <= spot) & (spot < low + size)
    wanted = totals.where(reduce(lambda a, b: a | b, [holds(F.col("_base"), F.col("_in"), spot) for _, _, spot in spots]))
    near = counts.join(wanted, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)] + [F.col("_bin") == F.col("_at")])
    inside = Window.partitionBy(*[F.col(f"`{c}`") for c in by], "_bin").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    picks = [F.max(F.when(holds(F.col("_before"), n, spot), F.col("_value"))).alias(f"_{side}{i}") for i, side, spot in spots]
    out = []
    for i, share in enumerate(shares):
        rest = F.lit(float(share)) * (F.col("_total") - 1) - F.floor(F.lit(float(share)) * (F.col("_total") - 1))
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        out.append(F.when(low == high, low).otherwise((F.lit(1.0) - rest) * low + rest * high))
    return near.groupBy(*[F.col(f"`{c}`") for c in by]).agg(*picks, F.max("_total").alias("_total")).select(*[F.col(f"`{c}`") for c in by], F.array(*out).alias(name))
