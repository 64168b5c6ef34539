"""What the operators share on a cluster: distributed ranks, shared buckets, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from lodestone.shared import Scratch, free_names

BIN_ROWS = 1 << 16


def bins_for(rows: int, least: int = 1024) -> int:
    """Bins for so many rows: a power of two that grows with them, so that a bin doesn't."""
    return max(least, 1 << max(0, rows // BIN_ROWS).bit_length())


def uniform(*columns: Column, seed: int = 0) -> Column:
    """A seeded number in [0, 2**52) from md5, the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def ranked(df: DataFrame, by: list[str], order: list[str], bin_of: Column, name: str, bounded: bool = False) -> DataFrame:
    """Adds a gapless rank from 0 within the groups `by` in the order `order`.

    A group may hold most rows: it is split by `bin_of`, which must not decrease in the order given, ranks
    are taken within bins, and sums of the bins' counts (a table of groups times bins) give each bin's base.
    bounded: the caller has proven that groups times bins is small, so that table is broadcast.
    """
    cut_at, base_at, base, inside, in_bin, *keys = free_names([*df.columns, name], "_bin", "_base_bin", "_base", "_inner", "_in_bin", *[f"_by_{c}" for c in by])
    groups = [F.col(f"`{c}`") for c in by]
    cut = df.withColumn(cut_at, bin_of)
    counts = cut.groupBy(*groups, cut_at).agg(F.count(F.lit(1)).alias(in_bin))
    over = Window.partitionBy(*groups).orderBy(cut_at).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[c.alias(k) for c, k in zip(groups, keys, strict=True)], F.col(cut_at).alias(base_at), F.coalesce(F.sum(in_bin).over(over), F.lit(0)).alias(base))
    inner = F.row_number().over(Window.partitionBy(*groups, cut_at).orderBy(*order)) - 1
    on = [c.eqNullSafe(F.col(k)) for c, k in zip(groups, keys, strict=True)] + [F.col(cut_at) == F.col(base_at)]
    joined = cut.withColumn(inside, inner).join(F.broadcast(bases) if bounded else bases, on, "left")
    return joined.withColumn(name, (F.col(base) + F.col(inside)).cast("bigint")).drop(cut_at, inside, base, base_at, *keys)


#: So many links at most are joined on the driver: two numbers each, whatever the input's size.
FEW_LINKS = 1 << 13
#: Types that Python orders as Spark does.
ORDERED = ("tinyint", "smallint", "int", "bigint", "string")


def joined(pairs: Iterable[tuple]) -> dict:
    """Each node of the pairs with the smallest node that they lead to."""
    up: dict = {}

    def top(x: object) -> object:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for pair in pairs:
        low, high = sorted(top(up.setdefault(x, x)) for x in pair)
        up[high] = low
    return {x: top(x) for x in up}


def components(links: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """Nodes of the links (a, b) with the smallest node that links lead to: columns node, component.

    Union-find on tables, as alternating large and small stars: in each round every node hands its larger,
    then its smaller neighbours to the smallest one; rounds grow with the logarithm of a component's size.
    Sums by node are made before rows move; joins on a hub can be split by the adaptive planner. FEW_LINKS links or
    fewer are joined on the driver, as the plans of the rounds take more of its memory than these links.
    """
    stars = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    kind = stars.schema["u"].dataType
    if kind.simpleString() in ORDERED:
        some = stars.limit(FEW_LINKS + 1).toArrow()
        if some.num_rows <= FEW_LINKS:
            found = joined(zip(*[some[c].to_pylist() for c in ("u", "v")], strict=True))
            table = pa.table([pa.array(x, to_arrow_type(kind)) for x in (list(found), list(found.values()))], names=["node", "component"])
            return links.sparkSession.createDataFrame(table, StructType([StructField(c, kind) for c in table.column_names]))
    mark = None
    for _ in range(most):
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        moved = large.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(moved.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        now = after.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        scratch.drop(stars)
        stars = after
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


BITMAP_BITS = 1 << 24
#: For keys of which there are several a row: so many bits a key, and so many in all at most.
KEY_BITS = 8
WIDE_BITS = 1 << 26


def likely_in(df: DataFrame, key: str, wanted: DataFrame, name: str, bits_of_map: int = BITMAP_BITS) -> DataFrame:
    """The rows whose key is among the wanted ones, and a few others, without moving the rows.

    The wanted keys' hashes set bits of a map of bits_of_map bits (a power of two), a table of 64 bits a row and so of as many rows at
    most whatever the number of keys, which is broadcast. An exact join must follow; this one keeps most rows that it
    would drop off the network.
    """
    word, bits, at = free_names(df.columns, "_word", "_bits", "_at")
    # Not pmod, which may be null: the optimiser would test for that before the join, and make costly keys twice.
    bit = lambda c: f"(xxhash64({c}) & {bits_of_map - 1}L)"
    mark = f"bit_or(shiftleft(1L, cast({bit(name)} & 63 as int)))"
    words = wanted.groupBy(F.expr(f"shiftright({bit(name)}, 6)").alias(word)).agg(F.expr(mark).alias(bits))
    met = df.withColumn(at, F.expr(bit(key))).join(F.broadcast(words), F.expr(f"shiftright({at}, 6)") == F.col(word))
    return met.where(f"(shiftright({bits}, cast({at} & 63 as int)) & 1) = 1").select(*[F.col(f"`{c}`") for c in df.columns])


def shared_buckets(entries: DataFrame, scratch: Scratch, probes: DataFrame | None = None, most: int = 0) -> DataFrame:
    """Of entries key, id, n: those whose key several ids have, with the key's smallest id as pivot.

    Probes have the same columns and count only under keys that an entry has: most hit none, and a bitmap of the entries'
    keys drops these before they move. It has KEY_BITS bits for each of the `most` entries there can be, so that it lets the same share of the others through at
    any size, until it is WIDE_BITS wide. Keys are counted first, as few of them come up twice.
    """
    columns, marked, made = ["key", "id", "n"], entries, []
    if probes is not None:
        wide = min(WIDE_BITS, 1 << max(16, (KEY_BITS * most).bit_length()))
        own = scratch.save(entries.select(*columns))
        hits = scratch.save(likely_in(probes.select(*columns), "key", own.select("key"), "key", wide))
        marked, made = own.withColumn("probe", F.lit(0)).unionByName(hits.withColumn("probe", F.lit(1))), [own, hits]
    counts = marked.groupBy("key").agg(F.count(F.lit(1)).alias("k"), *[F.min("probe").alias("only_probes")] * (probes is not None))
    keys = scratch.save(counts.where("k > 1" if probes is None else "k > 1 and only_probes = 0").select("key"))
    some = scratch.save(likely_in(marked.select(*columns), "key", keys, "key").join(keys, "key"))
    pivots = some.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("high")).where("pivot < high").select("key", "pivot")
    out = scratch.save(some.join(pivots, "key"))
    scratch.drop(keys, some, *made)
    return out


def with_component(found: DataFrame, frame: DataFrame, column: str, name: str) -> DataFrame:
    """The frame with the component of a column's nodes; a node without links is its own."""
    (node,) = free_names([*frame.columns, name], "_node")
    named = found.select(F.col("node").alias(node), F.col("component").alias(name))
    return frame.join(named, F.col(column) == F.col(node), "left").withColumn(name, F.coalesce(name, column)).drop(node)


def tasks_of(df: DataFrame) -> int:
    """Tasks for much work on few bytes: some for each core, but no more than shuffles have."""
    spark = df.sparkSession
    return max(1, min(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def linked_components(shared: DataFrame, alike: Callable[[str, str], str], verified: Callable[[DataFrame], DataFrame], scratch: Scratch, rounds: int = 1, profile: DataFrame | None = None, close: str = "true", link: str = "true") -> DataFrame:
    """Components (node, component) of the links among ids that share a bucket.

    alike gives SQL for whether sizes n and m let two ids link at all; verified keeps of pairs a, b the links.
    Every id is first held against the smallest id of the bucket where it shares most keys with it; then, bucket by
    bucket, against an id of the bucket's largest component; at last all pairs of different components that still share
    a bucket are verified, so no link between components is missed. A group of copies costs a few comparisons for each
    member. close is SQL for whether rows p and m of the profile (columns by id) could link, link a dearer test; both are made
    where pairs meet, before they are rows, and the dearer one under the smallest only of the keys that two ids share.
    """
    stars = shared.where("id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("keys"), "a"))
    links = scratch.save(verified(stars.withColumn("turn", best).where("turn = 1").select("a", "b")))
    found = scratch.save(components(links, scratch))

    def add(pairs: DataFrame) -> None:
        nonlocal found
        more = scratch.save(verified(pairs))
        if not more.isEmpty():
            found = scratch.save(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch))

    for turn in range(rounds + 1):
        labelled = with_component(found, shared.select("key", "id", "n"), "id", "c")
        own = labelled.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.xxhash64("id", F.lit(turn)), "id", "n")).alias("one"))
        top = own.groupBy("key").agg(F.max(F.struct("k", "c", F.col("one.id").alias("id"), F.col("one.n").alias("n"))).alias("t"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        top = scratch.save(top.select("key", F.col("t.c").alias("tc"), F.col("t.id").alias("tid"), F.col("t.n").alias("tn")))
        if top.isEmpty():
            break
        mixed = labelled.join(top, "key")
        if turn < rounds:
            pairs = mixed.where("c <> tc").where(alike("n", "tn")).select(F.col("tid").alias("a"), F.col("id").alias("b"))
        else:
            own_keys = mixed.groupBy(F.col("id").alias("_of")).agg(F.collect_list("key").alias("keys"))  # as many as an id has
            mixed = mixed.join(own_keys, F.col("id") == F.col("_of")).drop("_of")
            mixed = scratch.save(mixed.join(profile, "id") if profile is not None else mixed)
            # Few bytes and many tests: as many tasks as the session has partitions, not as few as the bytes would fill.
            dealt = mixed.repartition(tasks_of(mixed), "key")
            met = dealt.alias("p").join(mixed.where("c <> tc").repartition(tasks_of(mixed), "key").alias("m"), F.expr(f"p.key = m.key and p.c <> m.c and (p.c = p.tc or p.id < m.id) and {alike('p.n', 'm.n')} and ({close}) and p.key = array_min(array_intersect(p.keys, m.keys)) and ({link})"))
            pairs = met.select(F.least("p.id", "m.id").alias("a"), F.greatest("p.id", "m.id").alias("b"))
        add(pairs.distinct())
    return found
