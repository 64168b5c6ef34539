"""Sinks: contract-checked parquet, CSV, JSON, HTML tables, and tables that are topped up or replaced by key."""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.transforms import finite
from lodestone.operators.relational import check_columns, missing_ids

CONTRACT = ["compound", "smiles", "value", "origin"]


def check_contract(df: DataFrame) -> None:
    """Raises unless the columns are the contract's, values finite, and both keys unique: one aggregate a key."""
    check_columns(df.columns, CONTRACT, "contract")
    bad = df.agg(F.count_if(~finite(F.col("value"))).alias("n")).first()["n"]
    twice = [k for k in ("compound", "smiles") if df.groupBy(k).count().where("count > 1").limit(1).count()]
    if bad or twice:
        raise ValueError(f"{bad} values that are not finite; keys not unique: {twice}")


def write_contract(df: DataFrame, path: str, mode: str = "error") -> None:
    check_contract(df)
    df.select(*CONTRACT).write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, files: int | None = None, mode: str = "error") -> None:
    out = df.coalesce(files) if files else df
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def _folder(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, at: str) -> bool:
    """Whether a folder holds a whole result: the writer's mark stands in it."""
    path, fs = _folder(spark, f"{at}/_SUCCESS")
    return fs.exists(path)


def commit(df: DataFrame, at: str, form: str = "parquet", replace: bool = False, **options) -> None:
    """Writes the frame into a hidden folder beside its place and moves it there whole, in place of what stood there unfinished.

    A reader sees no result or a whole one; of two writers at once the first to move wins, the other's copy is dropped.
    replace: a whole result that stands there goes when the new one is written.
    """
    spark = df.sparkSession
    path, fs = _folder(spark, at)
    staged, _ = _folder(spark, f"{path.getParent()}/_staged-{uuid.uuid4().hex}")
    try:
        df.write.format(form).options(**options).save(str(staged))
        if not committed(spark, str(staged)):
            raise OSError(f"the writer left no mark of success for {at}")
        if replace or not committed(spark, at):
            fs.delete(path, True)
            fs.mkdirs(path.getParent())
            if not fs.rename(staged, path) and not committed(spark, at):
                raise OSError(f"could not move a finished result to {at}")
    finally:
        fs.delete(staged, True)


def top_up(spark: SparkSession, table: str, wanted: DataFrame, key: str, compute) -> int:
    """Computes and appends only the keys that the table lacks (it may not exist yet); the number of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    new = missing_ids(wanted, spark.read.parquet(table), key) if there else wanted
    new = new.dropDuplicates([key])
    n = new.count()
    if n:
        out = compute(new)
        if there:
            check_columns(out.columns, spark.read.parquet(table).columns, table)
        out.write.mode("append").parquet(table)
    return n


def write_ordered(df: DataFrame, at: str, line: Column, order: list[Column], header: str | None = None) -> None:
    """One text row a row, in the order over all part files by name, whole or not there at all.

    Rows are ranged by the order, so files hold consecutive stretches and none holds more than a partition; the header is
    the first file's first line.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value"))
    if header is not None:
        top = df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1)
        parts = top.union(parts)
    commit(parts, at, "text")


def replace_partitions(df: DataFrame, table: str, by: list[str]) -> None:
    """Writes the frame's partitions and leaves the table's others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(table)


def as_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))


def write_json(value: dict, path: str) -> None:
    with open(path, "w") as out:
        json.dump(value, out, indent=1, sort_keys=True)


def html_table(rows: list[dict], columns: list[str], block: str) -> str:
    """A small report's rows with each block's best (bold) and worst (italic) values marked by `<column>_best` and `_worst`."""

    def cell(r: dict, c: str) -> str:
        text = f"{r[c]:.3f}" if isinstance(r[c], float) else html.escape(str(r[c]))
        text = f"<b>{text}</b>" if r.get(f"{c}_best") else f"<i>{text}</i>" if r.get(f"{c}_worst") else text
        return f"<td>{text}</td>"

    head = "".join(f"<th>{html.escape(c)}</th>" for c in [block, *columns])
    body = "".join(f"<tr>{''.join(cell(r, c) for c in [block, *columns])}</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"
