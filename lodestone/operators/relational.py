"""Joins, deduplication, reshaping and set operators over DataFrames; every choice among rows has a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.keys import text_key
from lodestone.operators.ranks import numbered, percentiles
from lodestone.shared import free_names


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prefer_source(df: DataFrame, keys: list[str], source: Column, preferred: str, order: list[Column]) -> DataFrame:
    """One row a key: of the preferred source if it has one, then the first in the order."""
    return keep_first(df, keys, [F.when(source == preferred, 0).otherwise(1).asc(), *order])


def first_values(df: DataFrame, keys: list[str], columns: list[str], ordinal: Column) -> DataFrame:
    """A row a key with each column's first value that is not null."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), ordinal)).alias(c) for c in columns])


def long_to_wide(df: DataFrame, keys: list[str], name: str, value: str, names: list[str], ordinal: Column) -> DataFrame:
    """A row a key with a column for each listed name: its first value that is not null.

    Aggregates over conditions, not a pivot, so that the partial sums before the shuffle hold one row a key.
    """
    picks = [F.min_by(value, F.when((F.col(name) == n) & F.col(value).isNotNull(), ordinal)).alias(n) for n in names]
    return df.groupBy(*keys).agg(*picks)


def wide_to_long(df: DataFrame, keys: list[str], names: list[str], name: str = "endpoint", value: str = "value", keep_null: bool = False) -> DataFrame:
    out = df.unpivot(keys, names, name, value)
    return out if keep_null else out.where(F.col(value).isNotNull())


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared column names; missing keys match each other."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("no shared columns")
    right = b.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in shared else F.col(f"`{c}`") for c in b.columns])
    on = reduce(lambda x, y: x & y, [a[f"`{c}`"].eqNullSafe(right[f"`_r_{c}`"]) for c in shared])
    return a.join(right, on, how).drop(*[f"_r_{c}" for c in shared])


def check_cardinality(left: DataFrame, joined: DataFrame, keys: list[str]) -> None:
    """Raises unless every left row was matched exactly once: counts by the left rows' keys, held against each other."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    names = [f"_k{i}" for i in range(len(keys))]
    have = count(joined, "_have").select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], "_have")
    both = count(left, "_want").join(have, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "full")
    bad = both.agg(F.count_if(F.coalesce("_have", F.lit(0)) < F.coalesce("_want", F.lit(0))).alias("lost"), F.count_if(F.coalesce("_have", F.lit(0)) > F.coalesce("_want", F.lit(0))).alias("more")).first()
    if bad["lost"] or bad["more"]:
        raise ValueError(f"the join lost rows of {bad['lost']} keys and repeated rows of {bad['more']}")


def key_level(key: Column, level: str) -> Column:
    if level not in ("exact", "skeleton"):
        raise ValueError(f"unknown level {level!r}")
    return F.substring(key, 1, 14) if level == "skeleton" else key


def drop_twins(public: DataFrame, internal: DataFrame, key: str = "_ik", level: str = "exact") -> DataFrame:
    """Public rows whose molecule key no internal row has; rows without a key stay."""
    if level == "none":
        return public
    keys = internal.select(key_level(F.col(key), level).alias("_twin")).where("_twin is not null").distinct()
    return public.join(keys, key_level(public[key], level) == F.col("_twin"), "left_anti")


def twin_mask(public: DataFrame, internal: DataFrame, key: str = "_ik", name: str = "is_twin", level: str = "exact") -> DataFrame:
    """All public rows with whether an internal row has their key at this level: the rows that drop_twins leaves out."""
    if level == "none":
        return public.withColumn(name, F.lit(False))
    keys = internal.select(key_level(F.col(key), level).alias("_twin")).where("_twin is not null").distinct()
    return public.join(keys, key_level(public[key], level) == F.col("_twin"), "left").withColumn(name, F.col("_twin").isNotNull()).drop("_twin")


def fill_from(df: DataFrame, lookup: DataFrame, key: str, column: str, value: str, where: Column, order: list[Column]) -> DataFrame:
    """Missing values of the rows in `where` from a lookup's first row a key; measured values win."""
    table = keep_first(lookup.where(F.col(value).isNotNull()), [key], order).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    out = df.join(table, df[key] == F.col("_k"), "left")
    return out.withColumn(column, F.when(where, F.coalesce(column, "_v")).otherwise(F.col(column))).drop("_k", "_v")


def join_auxiliary(df: DataFrame, aux: DataFrame, key: str, columns: list[str], blank: Column, order: list[Column]) -> DataFrame:
    """Auxiliary columns by key (first row a key), null where `blank` holds."""
    table = keep_first(aux, [key], order).select(F.col(key).alias("_k"), *columns)
    out = df.join(table, df[key] == F.col("_k"), "left").drop("_k")
    return out.withColumns({c: F.when(~blank, F.col(c)) for c in columns})


def missing_ids(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return df.join(cache.select(key).distinct(), key, "left_anti")


def check_coverage(df: DataFrame, features: DataFrame, key: str) -> None:
    """Raises with a few ids if any row lacks features."""
    if lost := [r[0] for r in missing_ids(df, features, key).select(key).limit(5).collect()]:
        raise ValueError(f"rows without features, such as {lost}")


def check_columns(have: list[str], want: list[str], name: str) -> None:
    if set(have) != set(want):
        raise ValueError(f"{name}: columns differ: {sorted(set(have) ^ set(want))[:10]}")


def align_union(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def power_set(items: DataFrame, item: str, order: str) -> DataFrame:
    """All non-empty subsets as (mask, item) rows; items are numbered by the order column. At most 20 items."""
    numbered = items.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    if (n := items.count()) > 20:
        raise ValueError(f"{n} items have too many subsets")
    masks = numbered.select(item, "_i", F.explode(F.expr(f"sequence(1, shiftleft(1, {n}) - 1)")).alias("mask"))
    return masks.where(F.expr("(shiftright(mask, _i) & 1) = 1")).select("mask", item)


def sequential_ids(df: DataFrame, order: list[Column], prefix: str = "", name: str = "compound") -> DataFrame:
    """PREFIX_<i> numbered from 0 in the order, which must be total."""
    (at,) = free_names(df.columns, "_number")
    out = numbered(df, order, at)
    return out.withColumn(name, F.concat(F.lit(prefix), F.col(at).cast("string")) if prefix else F.col(at)).drop(*[at] if at != name else [])


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Distinct keys with the number of their batch of `size`."""
    ids = sequential_ids(df.select(key).distinct(), [F.col(key)], name="_at")
    return ids.select(key, F.floor(F.col("_at") / size).cast("bigint").alias("batch"))


def origin_counts(df: DataFrame, origin: str, more_than: int) -> DataFrame:
    """Origins with more than so many rows, the largest first."""
    return df.groupBy(origin).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than).orderBy(F.desc("n"), origin)


def funnel(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(step, name, n): rows that pass all rules up to each, by one aggregate."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for k, (_, rule) in enumerate(rules, 1):
        passed = passed & F.coalesce(rule, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n{k}"))
    names = ["all", *[n for n, _ in rules]]
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), F.col(f"n{k}").alias("n")) for k, n in enumerate(names)])
    return df.agg(*counts).select(F.inline(steps))


def activity_rules(kind: Column, units: Column, value: Column, relation: Column, wanted: str, reverse: str, factors: dict[str, float], drop_censored: bool = True) -> list[tuple[str, Column]]:
    """The rules, for `funnel` or a filter, by which an activity is the wanted quantity: its type matches from the start, is not
    the reverse leg, has a unit that can be converted and a value, and (if asked) is no detection limit. Patterns ignore case."""
    rules = [
        ("wanted type", kind.rlike(f"(?i)^(?:{wanted})")),
        ("no reverse leg", ~kind.rlike(f"(?i){reverse}")),
        ("convertible unit", units.isin(*factors) & value.isNotNull()),
    ]
    return [*rules, ("uncensored", relation == "=")] if drop_censored else rules


def passing(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """The rows that pass all rules; what a rule can't tell (null) doesn't pass."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for _, r in rules], F.lit(True)))


def collapse(df: DataFrame, keys: list[str], how: dict[str, str]) -> DataFrame:
    """A row a key with each column's mean, median, min, max or first by value, as configured; medians are exact."""
    simple = {"mean": F.avg, "min": F.min, "max": F.max, "first": F.min, "sum": F.sum, "count": F.count}
    if bad := {x for x in how.values() if x not in simple and x != "median"}:
        raise ValueError(f"unknown aggregates {sorted(bad)}")
    plain = [simple[h](F.col(f"`{c}`")).alias(c) for c, h in how.items() if h != "median"]
    out = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    for c in [c for c, h in how.items() if h == "median"]:
        mid = percentiles(df, keys, c, [0.5]).select(*[F.col(f"`{k}`").alias(f"_m_{k}") for k in keys], F.col("q")[0].alias(c))
        out = out.join(mid, [F.col(f"`{k}`").eqNullSafe(F.col(f"_m_{k}")) for k in keys], "left").drop(*[f"_m_{k}" for k in keys])
    return out.select(*keys, *how)


def with_keys(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("_ik", text_key(F.col(text_col)))


def prefixed(columns: list[str], prefix: str, leave_out: tuple[str, ...] = ()) -> list[str]:
    """The columns that start with a prefix (an empty one: all), without those left out, in their order."""
    return [c for c in columns if c.startswith(prefix) and c not in leave_out]


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in a given order as doubles: what does not parse, and columns that are not there, become null."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{c}`").cast("string").try_cast("double") if c.lower() in have else F.lit(None).cast("double")).alias(c) for c in columns])


def display_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in a configured order of a column's values, the others after them by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.withColumn("_o", F.when(place > 0, place).otherwise(len(order) + 1)).orderBy("_o", column).drop("_o")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows with those of the new rows' keys replaced."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
