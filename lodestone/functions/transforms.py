"""Scalar functions as Column builders: modelling space, units, clearance scaling, calls, confidences, display."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
EPS = 1e-3


def num(x: float) -> Column:
    return F.lit(float(x))


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < num(INF)), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def clip_upper(c: Column, cap: float | None) -> Column:
    """The value, or the cap where that is lower; missing stays missing."""
    return c if cap is None else F.when(c.isNotNull(), F.least(c, num(cap)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, num(low)), num(high)))


def log10(c: Column) -> Column:
    """Null at and below 0, where the logarithm is not finite."""
    return F.when(c > 0, F.log10(c))


def logit(f: Column) -> Column:
    return F.when((f > 0) & (f < 1), F.log10(F.try_divide(f, num(1) - f)))


def forward(kind: str, c: Column) -> Column:
    """Raw to modelling space; what would not be finite is null."""
    if kind == "log10":
        return log10(c)
    if kind == "logit_pct":
        return F.when((c > 0) & (c < 100), F.log10(F.try_divide(c, num(100) - c)))
    if kind == "identity":
        return c
    raise ValueError(f"unknown transform {kind!r}")


def inverse(kind: str, c: Column) -> Column:
    """Modelling to raw space."""
    if kind == "log10":
        return F.pow(num(10), c)
    if kind == "logit_pct":
        return num(100) / (num(1) + F.pow(num(10), -c))
    if kind == "identity":
        return c
    raise ValueError(f"unknown transform {kind!r}")


def forward_value(kind: str, x: float) -> float:
    """The transform of one setting, such as a cap."""
    return {"log10": lambda: math.log10(x), "logit_pct": lambda: math.log10(x / (100 - x)), "identity": lambda: x}[kind]()


def clipped_logit(fraction: Column, eps: float = EPS) -> Column:
    """Logit of a fraction kept off 0 and 1."""
    f = clip(fraction, eps, 1 - eps)
    return F.log10(f / (num(1) - f))


def extract(kind: str, c: Column) -> Column:
    """The extraction path's transforms: percents are clipped rather than dropped."""
    return clipped_logit(c / num(100)) if kind == "logit_pct" else forward(kind, c)


# Microsomal protein a gram of liver times liver weight a kilogram, by species.
LIVER = {"human": (32.0, 20.0), "mouse": (45.0, 87.5), "rat": (44.8, 40.0)}


def harmonise(op: str, y: Column, offset: float = 0.0, species: str = "human") -> Column:
    """A source's value in this library's modelling space."""
    if op == "identity":
        return y
    if op == "log10":
        return log10(y)
    if op == "log10_offset":
        return y + num(offset)
    if op == "pctbound_to_logit_fu":
        return clipped_logit((num(100) - y) / num(100))
    if op == "log_pctunbound_to_logit_fu":
        return clipped_logit(F.pow(num(10), y) / num(100))
    if op == "log_clint_bw_to_invitro":
        protein, weight = LIVER[species]
        return y - num(math.log10(protein * weight / 1000))
    raise ValueError(f"unknown operation {op!r}")


def to_micromolar(unit: str, v: Column, weight: Column | None = None) -> Column:
    """Concentrations in micromoles a litre."""
    if unit == "logS":
        return F.pow(num(10), v) * num(1e6)
    if unit == "log10_nM":
        return F.pow(num(10), v) / num(1e3)
    if unit == "nM":
        return v / num(1e3)
    if unit == "ug.mL-1":
        return F.try_divide(v * num(1e3), weight)
    if unit == "log10_ug.mL-1":
        return F.try_divide(F.pow(num(10), v) * num(1e3), weight)
    raise ValueError(f"unknown unit {unit!r}")


def by_unit(unit: Column, v: Column, weight: Column, units: tuple[str, ...] = ("nM", "ug.mL-1")) -> Column:
    """One CASE over units; other units give null."""
    out = F.when(unit == units[0], to_micromolar(units[0], v, weight))
    for u in units[1:]:
        out = out.when(unit == u, to_micromolar(u, v, weight))
    return out


def by_factor(unit: Column, v: Column, factors: dict[str, float]) -> Column:
    """The value times its unit's factor; a unit without one gives null."""
    table = F.create_map(*[x for k, f in factors.items() for x in (F.lit(k), num(f))])
    return v * F.try_element_at(table, unit)


def matches(c: Column, pattern: str) -> Column:
    """Whether the text of a value matches a pattern; a missing value doesn't."""
    return F.coalesce(c.cast("string").rlike(pattern), F.lit(False))


def solubility_kind(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("kinetic"), "kinetic").when(t.contains("thermodynamic"), "thermodynamic").otherwise("mixed")


def first_number(text: Column, pattern: str = r"(\d+\.?\d*)") -> Column:
    """The first number in a text as double, else null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")


def digits(text: Column) -> Column:
    return first_number(text, r"(\d+)")


def censored_number(text: Column, cap: float | None = None) -> Column:
    """The number of '<2.5', '>9' or '3', at most the cap; other texts give null."""
    return clip_upper(F.regexp_replace(F.trim(text), "^[<>]+", "").try_cast("double"), cap)


def hit_call(text: Column, cutoff: float) -> Column:
    """Whether a potency is below the cutoff; null if missing or a lower bound below the cutoff."""
    v = censored_number(text)
    return F.when(v.isNull() | (F.trim(text).startswith(">") & (v < num(cutoff))), F.lit(None).cast("boolean")).otherwise(v < num(cutoff))


def bound_call(text: Column, cutoff: float) -> Column:
    """As hit_call with bounds resolved: '<b' below the cutoff is a hit, '>b' above it none, other bounds undecidable."""
    v, t = censored_number(text), F.trim(text)
    undecided = F.lit(None).cast("boolean")
    low = F.when(v <= num(cutoff), F.lit(True)).otherwise(undecided)
    high = F.when(v >= num(cutoff), F.lit(False)).otherwise(undecided)
    return F.when(v.isNull(), undecided).when(t.startswith("<"), low).when(t.startswith(">"), high).otherwise(v < num(cutoff))


_COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def compare(c: Column, op: str, value: Column | float) -> Column:
    """A comparison that a missing or NaN value fails."""
    value = num(value) if isinstance(value, int | float) else value
    return F.coalesce(_COMPARE[op](finite_or_null(c), value), F.lit(False))


def favorable(raw: Column, cutoff: float | None, sign: str) -> Column:
    """Null without a finite value or a cutoff."""
    if cutoff is None:
        return F.lit(None).cast("boolean")
    return F.when(finite(raw), _COMPARE[sign](raw, num(cutoff)))


def binarise(c: Column, cutoff: float) -> Column:
    """1 at and above the cutoff, else (missing too) 0."""
    return compare(c, ">=", cutoff).cast("int")


def skeleton(key: Column, n: int = 14) -> Column:
    return F.substring(key, 1, n)


def short_origin(origin: Column) -> Column:
    return F.element_at(F.split(origin, ":"), -1)


def confidence(std: Column, rmse: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """exp(-expected error / rmse); the expected error is a + b std, not below 0, or std itself."""
    error = std if a is None else F.greatest(a + b * std, num(0))
    return F.when(std.isNotNull(), F.exp(-F.try_divide(error, rmse)))


def margin(p: Column) -> Column:
    return F.abs(num(2) * p - num(1))


def sigmoid(x: Column, center: float = 0.0, slope: float = 1.0) -> Column:
    return num(1) / (num(1) + F.exp(-num(slope) * (x - num(center))))


def desirability(kind: str, sign: str, raw: Column, center: float, slope: float = 2.0) -> Column:
    """0..1 along the favourable side of a centre, in modelling space."""
    way = 1.0 if sign.startswith(">") else -1.0
    return sigmoid(forward(kind, raw), forward_value(kind, center), way * slope)


def alpha(t: Column, low: float, span: float, around_half: bool = False) -> Column:
    """Opacity of a cell's colour."""
    x = num(2) * F.abs(t - num(0.5)) if around_half else t
    return num(low) + num(span) * x


def favourable_place(kind: str, sign: str, raw: Column, cutoff: float | None, slope: float = 2.0, sharpness: float = 1.0) -> Column:
    """0..1 along the favourable axis, a half at the cutoff; null without a cutoff or where a value has no place in modelling space."""
    if cutoff is None or not sign:
        return F.lit(None).cast("double")
    return finite_or_null(desirability(kind, sign, raw, cutoff, slope * sharpness))


def short_number(v: Column) -> Column:
    """Fewer decimals for larger numbers; a dash for none. Halves of the shortest decimal form go up."""
    text = lambda n: F.format_string(f"%.{n}f", v)
    return F.when(~finite(v), "—").when(F.abs(v) >= 100, text(0)).when(F.abs(v) >= 10, text(1)).when(F.abs(v) >= 1, text(2)).otherwise(text(3))


REGISTERED = {"to_log10": lambda c: forward("log10", c), "from_log10": lambda c: inverse("log10", c), "to_logit_pct": lambda c: forward("logit_pct", c), "from_logit_pct": lambda c: inverse("logit_pct", c)}


def register(spark) -> None:
    """The transforms as SQL functions of a session (SQL bodies, which the optimiser inlines)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION to_log10(v DOUBLE) RETURNS DOUBLE RETURN CASE WHEN v > 0 THEN log10(v) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION from_log10(v DOUBLE) RETURNS DOUBLE RETURN pow(10.0D, v)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION to_logit_pct(v DOUBLE) RETURNS DOUBLE RETURN CASE WHEN v > 0 AND v < 100 THEN log10(v / (100.0D - v)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION from_logit_pct(v DOUBLE) RETURNS DOUBLE RETURN 100.0D / (1.0D + pow(10.0D, -v))")
