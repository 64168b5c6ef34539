"""Providers: molecule keys and features of structure texts.

Chemistry is pluggable; the defaults work on any text. An exact key is the md5 of the trimmed, lower-cased text; a
skeleton key that of its letters only, cut to 14 characters. Features are hashed character n-grams and simple counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(text: Column, level: str = "exact") -> Column:
    if level == "exact":
        return F.md5(F.lower(F.trim(text)).cast("binary"))
    if level == "skeleton":
        return F.substring(F.md5(F.regexp_replace(F.lower(text), "[^a-z]", "").cast("binary")), 1, 14)
    raise ValueError(f"unknown level {level!r}")


def keys_for(df: DataFrame, cache: DataFrame | None, id_col: str = "compound", text_col: str = "smiles", level: str = "exact") -> DataFrame:
    """The rows with `_ik`: the cache's key (the latest file's, column ordinal) where it has one, else the computed one."""
    computed = text_key(F.col(text_col))
    if cache is not None:
        ordinal = F.col("ordinal") if "ordinal" in cache.columns else F.lit(0)
        known = cache.groupBy(F.col(id_col).alias("_id")).agg(F.max_by("_ik", ordinal).alias("_known"))
        df = df.join(known, F.col(id_col) == F.col("_id"), "left")
        computed = F.coalesce("_known", computed)
    key = F.substring(computed, 1, 14) if level == "skeleton" else computed
    return df.withColumn("_ik", key).drop("_id", "_known")


def hashed_ngrams(text: Column, dim: int = 64, n: int = 3) -> Column:
    """Counts of character n-grams by hash bucket, as array<double>: one pass over a batch's code points."""

    @F.pandas_udf("array<double>")
    def count(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            grams = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
            for i in range(n):
                grams = grams * np.uint64(1099511628211) + codes[i : i + len(grams)]
            grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
            out.append(np.bincount((grams % np.uint64(dim)).astype(np.int64), minlength=dim).astype(float))
        return pd.Series(out)

    return count(text)


def descriptors(text: Column) -> dict[str, Column]:
    """Named numeric descriptors of a text."""
    length = F.length(text).cast("double")
    return {"DS_length": length, "DS_digits": F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double"), "DS_upper": F.length(F.regexp_replace(text, "[^A-Z]", "")).cast("double")}


FEATURE_TYPES = ("H236", "H237")


def featurise(df: DataFrame, kind: str, text_col: str = "smiles", dim: int = 64) -> DataFrame:
    """The rows with `features`: n-grams (H236), with descriptors behind them (H237)."""
    if kind not in FEATURE_TYPES:
        raise ValueError(f"unknown feature type {kind!r}")
    parts = [hashed_ngrams(F.col(text_col), dim)] + ([F.array(*descriptors(F.col(text_col)).values())] if kind == "H237" else [])
    return df.withColumn("features", F.concat(*parts))


def align_features(features: Column, have: list[str], want: list[str]) -> Column:
    """The features in another column list's order; raises for names that are missing."""
    place = {n: i for i, n in enumerate(have)}
    if missing := [n for n in want if n not in place]:
        raise ValueError(f"features lack {missing[:5]}")
    return F.transform(F.array(*[F.lit(place[n] + 1) for n in want]), lambda i: F.element_at(features, i))


#: Providers of a chemistry toolkit: name -> (pandas function of a series of structures, Spark type). None ships here.
PROVIDERS: dict[str, tuple] = {}


def provide(name: str, function, kind: str) -> None:
    """Registers a toolkit's function under a name such as weight, depiction or properties."""
    PROVIDERS[name] = (function, kind)


def provided(name: str, structure: Column) -> Column:
    """A registered provider's result for a structure column, by Arrow batches; raises where none is registered."""
    if name not in PROVIDERS:
        raise LookupError(f"no provider of {name!r} is registered")
    function, kind = PROVIDERS[name]

    @F.pandas_udf(kind)
    def run(structures: pd.Series) -> pd.Series:
        return function(structures)

    return run(structure)
