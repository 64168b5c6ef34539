"""Split plans as relations: rows with a fold, or (split, id, role)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.transforms import digits
from lodestone.operators.ranks import even_parts, hash_bin, numbered
from lodestone.shared import Scratch


def dice(seed: int, group: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), group.cast("string")).cast("binary"))


def group_folds(df: DataFrame, id_col: str, group: Column | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """The rows with fold 1..k; rows of a group share it; a row without a group is one of its own.

    Groups are numbered by a seeded hash, in bins of it, and cut into k even parts; only distinct groups are sorted.
    """
    key = F.coalesce(group.cast("string"), F.concat(F.lit("id:"), F.col(id_col).cast("string"))) if group is not None else F.col(id_col).cast("string")
    rows = df.withColumn("_group", key)
    groups = Scratch(df.sparkSession).save(rows.select("_group").distinct().withColumn("_dice", dice(seed, F.col("_group"))))
    placed = numbered(groups, [F.col("_dice"), F.col("_group")], "_at", bins=hash_bin(F.col("_dice")))
    folds = placed.select(F.col("_group").alias("_g"), even_parts(F.col("_at"), groups.count(), k).alias("fold"))
    return rows.join(folds, F.col("_group") == F.col("_g")).drop("_group", "_g")


def roles(folded: DataFrame, id_col: str, k: int = 5, public: DataFrame | None = None) -> DataFrame:
    """(split, id, role) of k splits: test in one's own fold, train in the others; public ids train in all."""
    own = folded.select(F.col(id_col).alias("id"), "fold", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("split"))
    out = own.select(F.col("split").cast("bigint").alias("split"), "id", F.when(F.col("fold") == F.col("split"), "test").otherwise("train").alias("role"))
    if public is not None:
        more = public.select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("split"))
        out = out.union(more.select(F.col("split").cast("bigint"), "id", F.lit("train")))
    return out


def temporal(df: DataFrame, id_col: str, share: float = 0.7) -> DataFrame:
    """role by the number in the id: the oldest floor(share * n) rows train, the newest test; ids without one are newest."""
    n = df.count()
    ranked = numbered(df.withColumn("_d", digits(F.col(id_col).cast("string"))), [F.col("_d").asc_nulls_last(), F.col(id_col)], "_r")
    return ranked.withColumn("role", F.when(F.col("_r") < int(n * share), "train").otherwise("test")).drop("_d", "_r")


def time_blocks(df: DataFrame, order: list[Column], blocks: int = 10) -> DataFrame:
    """The rows with their block 1..blocks of the order."""
    placed = numbered(df, order, "_at")
    return placed.withColumn("block", even_parts(F.col("_at"), df.count(), blocks)).drop("_at")


def rolling_blocks(df: DataFrame, order: list[Column], blocks: int = 10, start: float = 0.5) -> DataFrame:
    """(block, n_train, n_test): expanding windows over time blocks, tested from the given share on."""
    sized = time_blocks(df, order, blocks).groupBy("block").agg(F.count(F.lit(1)).alias("n_test"))
    before = F.sum("n_test").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # `blocks` rows
    return sized.withColumn("n_train", before.cast("bigint")).where(F.col("block") > F.lit(int(blocks * start))).select("block", "n_train", "n_test")


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """The rows with fold = the group's number."""
    groups = numbered(df.select(F.col(group).alias("_g")).distinct(), [F.col("_g")], "_at")
    return df.join(groups.select("_g", (F.col("_at") + 1).alias("fold")), df[group].eqNullSafe(F.col("_g"))).drop("_g")


def deal_patterns(patterns: list[tuple[tuple[int, ...], int]], k: int) -> dict[tuple[int, ...], tuple[int, list[int]]]:
    """For patterns (rows by class of a group, how many groups have them): whole rounds of groups that every fold gets, and
    the folds (from 1) of the groups left over.

    Rounds change no balance. What is left goes, the unevenest pattern first, group by group to the fold where its classes
    are scarcest: the one with the smallest sum over classes of (fold's rows) * (group's rows) / (all rows) squared, then the
    smallest, then the first.
    """
    kinds = len(patterns[0][0]) if patterns else 0
    total = [max(1, sum(c[i] * n for c, n in patterns)) for i in range(kinds)]
    spread = lambda c: sum(x * x for x in c) * kinds - sum(c) ** 2
    have, out = [[0] * kinds for _ in range(k)], {}
    for counts, n in sorted(patterns, key=lambda p: (-spread(p[0]), [-x for x in p[0]])):
        folds = []
        for _ in range(n % k):
            cost = lambda f: (sum(have[f][i] * counts[i] / (total[i] * total[i]) for i in range(kinds)), sum(have[f]), f)  # noqa: B023, E731
            best = min(range(k), key=cost)
            folds.append(best + 1)
            have[best] = [x + y for x, y in zip(have[best], counts, strict=True)]
        out[counts] = n // k, folds
    return out


#: Distinct numbers of rows by class that groups may have; as many are dealt on the driver.
MOST_PATTERNS = 1_000_000


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds 1..k that keep groups whole, and sizes and shares of every class as even as groups allow.

    Groups are counted by class; groups of equal counts are one pattern, numbered within it by a seeded hash. Whole rounds
    of k such groups are dealt evenly, and the rest of each pattern (under k groups) by deal_patterns. A null label is a
    class of its own, rows of the null group are one group.
    """
    scratch = Scratch(df.sparkSession)
    kinds = [r[0] for r in df.select(F.col(label).cast("string").alias("c")).distinct().limit(101).collect()]
    if len(kinds) > 100:
        raise ValueError("more than 100 classes")
    kinds = sorted(kinds, key=lambda c: (c is None, c or ""))
    rows = df.groupBy(F.col(group).alias("_g")).agg(F.array(*[F.count_if(F.col(label).cast("string").eqNullSafe(F.lit(c))) for c in kinds]).alias("_counts"))
    rows = scratch.save(rows.withColumn("_dice", dice(seed, F.coalesce(F.col("_g").cast("string"), F.lit("")))))
    found = rows.groupBy("_counts").agg(F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} different groups")
    dealt = deal_patterns([(tuple(r["_counts"]), r["n"]) for r in found], k)
    plan = df.sparkSession.createDataFrame([(list(c), r, f) for c, (r, f) in dealt.items()], "_of array<bigint>, _rounds bigint, _rest array<int>")
    at = numbered(rows, [F.col("_dice"), F.col("_g")], "_at", ["_counts"], hash_bin(F.col("_dice"))).join(plan, F.col("_counts") == F.col("_of"))
    early = F.col("_at") < F.col("_rounds") * k
    fold = F.when(early, F.col("_at") % k + 1).otherwise(F.get("_rest", (F.col("_at") - F.col("_rounds") * k).cast("int"))).cast("bigint")
    return df.join(at.select("_g", fold.alias("fold")), df[group].eqNullSafe(F.col("_g"))).drop("_g")


def stored_folds(df: DataFrame, stored: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the stored table's fold, rows that it lacks)."""
    folds = stored.select(id_col, "fold").dropDuplicates([id_col])
    return df.join(folds, id_col), df.join(folds, id_col, "left_anti")


def folds_with_source(df: DataFrame, stored: DataFrame | None, id_col: str, where: str = "", group: Column | None = None, k: int = 5, seed: int = 42) -> tuple[DataFrame, str, int]:
    """(rows with fold, where the folds come from, stored ids that the rows lack).

    With a stored table, its folds are taken over and rows that it lacks have none (their fold is null), so that scores on
    both are of the same partitions; without one, the folds are planned here and are not comparable fold by fold.
    """
    if stored is None:
        return group_folds(df, id_col, group, k, seed), "independent", 0
    if "fold" not in stored.columns:
        raise ValueError("the stored table has no fold column")
    folds = stored.select(F.col(id_col).alias("_stored"), F.col("fold").cast("bigint").alias("fold")).dropDuplicates(["_stored"])
    lost = folds.join(df.select(id_col), F.col("_stored") == F.col(id_col), "left_anti").count()
    return df.join(folds, F.col(id_col) == F.col("_stored"), "left").drop("_stored"), f"stored:{where}", lost


def best_combo(counts: DataFrame, configured: list[str], origin: str = "origin") -> list[str]:
    """Configured origins that survived the size gate, in their order; all that survived if none did."""
    have = [r[0] for r in counts.select(origin).collect()]
    return [x for x in configured if x in have] or have
