"""A formula over endpoint columns, compiled to a Column: a whitelist of Python expression nodes, never evaluated.

Bare names are endpoints' raw values; d(endpoint[, centre[, slope]]) is desirability, c(endpoint) confidence,
sigmoid(x[, centre[, slope]]); mean, clamp, min, max, exp, log, abs and pow do as they say. A missing argument makes
the result missing, and a result that is not finite is null.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import Endpoint
from lodestone.functions.transforms import desirability, finite_or_null, num


class FormulaError(ValueError):
    pass


def _all_there(args: list[Column], value: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in args]), value)


def compile_formula(text: str, endpoints: dict[str, Endpoint], values: dict[str, Column], confidences: dict[str, Column] | None = None, slope: float = 2.0) -> Column:
    confidences = confidences or {}
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {text!r}") from e

    def number(node: ast.AST) -> float:
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -number(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return float(node.value)
        raise FormulaError("a number is wanted here")

    def name(node: ast.AST) -> str:
        if isinstance(node, ast.Name) and node.id in endpoints:
            return node.id
        raise FormulaError("an endpoint is wanted here")

    def call(node: ast.Call) -> Column:
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise FormulaError("only plain calls")
        f, args = node.func.id, node.args
        if f == "d" and 1 <= len(args) <= 3:
            e = endpoints[name(args[0])]
            center = number(args[1]) if len(args) > 1 else e.cutoff
            if center is None:
                raise FormulaError(f"{e.name} has no cutoff")
            return desirability(e.transform, e.sign, values[e.name], center, number(args[2]) if len(args) > 2 else slope)
        if f == "c" and len(args) == 1:
            k = name(args[0])
            if k not in confidences:
                raise FormulaError(f"no confidence of {k}")
            return confidences[k]
        if f == "sigmoid" and 1 <= len(args) <= 3:
            center = number(args[1]) if len(args) > 1 else 0.0
            return num(1) / (num(1) + F.exp(-num(number(args[2]) if len(args) > 2 else 1.0) * (go(args[0]) - num(center))))
        xs = [go(a) for a in args]
        if f == "mean" and xs:
            return _all_there(xs, reduce(lambda a, b: a + b, xs) / num(len(xs)))
        if f in ("min", "max") and xs:
            return xs[0] if len(xs) == 1 else _all_there(xs, (F.least if f == "min" else F.greatest)(*xs))
        if f == "clamp" and len(xs) == 3:
            return _all_there(xs, F.least(F.greatest(xs[0], xs[1]), xs[2]))
        if f == "pow" and len(xs) == 2:
            return F.pow(*xs)
        if f in ("exp", "log", "abs") and len(xs) == 1:
            return F.when(xs[0] > 0, F.log(xs[0])) if f == "log" else {"exp": F.exp, "abs": F.abs}[f](xs[0])
        raise FormulaError(f"unknown call {f}/{len(args)}")

    def go(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp):
            a, b = go(node.left), go(node.right)
            if isinstance(node.op, ast.Div):
                return F.try_divide(a, b)
            ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Pow: lambda: F.pow(a, b)}
            if type(node.op) in ops:
                return ops[type(node.op)]()
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return -go(node.operand) if isinstance(node.op, ast.USub) else go(node.operand)
        elif isinstance(node, ast.Constant):
            return num(number(node))
        elif isinstance(node, ast.Name):
            return values[name(node)]
        elif isinstance(node, ast.Call):
            return call(node)
        raise FormulaError(f"not allowed: {ast.dump(node)[:60]}")

    return finite_or_null(go(tree))


def default_formula(endpoints: list[Endpoint]) -> str:
    """The mean desirability of the endpoints that have a cutoff."""
    return f"mean({', '.join(f'd({e.name})' for e in endpoints if e.cutoff is not None)})"
