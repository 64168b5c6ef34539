"""The result grid: term filters, sorting, export, and the store of scored runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.transforms import compare, finite, finite_or_null


def term_filter(terms: list[tuple[str | None, str | None, float | None]], mode: str = "all") -> Column:
    """A predicate of (field, operator, value) terms joined by AND (all) or OR (any).

    Incomplete terms are left out; a row that misses a term's field fails that term; no terms pass every row.
    """
    parts = [compare(F.col(f), op, v) for f, op, v in terms if f and op and v is not None]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), parts)


def grid_order(df: DataFrame, key: str, descending: bool | None = None) -> list[Column]:
    """Blank values last in both directions; texts by lower case, ascending unless told; numbers descending."""
    text = dict(df.dtypes)[key] == "string"
    c = F.lower(F.col(key)) if text else finite_or_null(F.col(key).cast("double"))
    down = (not text) if descending is None else descending
    return [c.desc_nulls_last() if down else c.asc_nulls_last()]


def export_rows(df: DataFrame, endpoints: list[str], visible: Column, selected: Column | None = None) -> DataFrame:
    """The exported columns of visible and selected rows; hidden columns are exported too."""
    columns = ["compound", "smiles", F.format_string("%.4f", F.col("mpo")).alias("mpo"), "score", *[f"{e}_{k}" for e in endpoints for k in ("pred", "confidence")]]
    return df.where(visible & (selected if selected is not None else F.lit(True))).select(*columns)


def csv_field(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def sdf_records(df: DataFrame, fields: list[str], block: str = "block", total: int | None = None, index: str = "idx") -> DataFrame:
    """Each record's text: its block as it was, with a line end if it lacks one, then the fields that are there and finite.

    With `total`, rows whose number isn't below it raise when they are computed.
    """
    there = lambda f: F.col(f).isNotNull() & (finite(F.col(f).cast("double")) if dict(df.dtypes)[f] in ("double", "float") else F.lit(True))
    parts = [F.when(there(f), F.concat(F.lit(f"> <{f}>\n"), F.col(f).cast("string"), F.lit("\n\n"))) for f in fields]
    if total is not None:
        df = df.where(F.when((F.col(index) >= 0) & (F.col(index) < total), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("row index "), F.col(index).cast("string"), F.lit(" is outside this run"))).cast("boolean")))
    return df.withColumn("record", F.concat(F.col(block), F.when(F.col(block).endswith("\n"), "").otherwise("\n"), F.concat_ws("", *parts), F.lit("$$$$\n")))


def live_runs(runs: DataFrame, now: Column, ttl_seconds: float, most: int, time: str = "ts") -> DataFrame:
    """The newest runs that are young enough. Only `most` rows are ever gathered."""
    young = runs.where((now.cast("timestamp").cast("double") - F.col(time).cast("timestamp").cast("double")) <= F.lit(float(ttl_seconds)))
    return young.orderBy(F.desc(time), "run_id").limit(most)


def status(df: DataFrame, shown: Column) -> DataFrame:
    return df.agg(F.count_if(shown).alias("visible"), F.count(F.lit(1)).alias("total"))


def nested(df: DataFrame, endpoints: list[str]) -> DataFrame:
    """The flat row's predictions as a map of endpoint to value, favourable and confidence."""
    pairs = [x for e in endpoints for x in (F.lit(e), F.struct(F.col(f"{e}_pred").alias("value"), F.col(f"{e}_favorable").alias("favorable"), F.col(f"{e}_confidence").alias("confidence")))]
    return df.withColumn("preds", F.create_map(*pairs))


def newest_first(df: DataFrame, group: str, time: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(time))
    return df.withColumn("age", F.row_number().over(w).cast("bigint"))
