"""Reward formulas and judge conditions as Columns.

A formula is parsed on the driver, checked against an allow-list and compiled to built-in expressions, so it
runs inside generated code. Nothing is evaluated as Python. Lines before the last may give names to values;
the last is the result. A value that is missing, or a division by zero, makes the result null.
"""

from __future__ import annotations

import ast
import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NODES, MAX_CONSTANT = 200, 1e6


def _all_there(fold: Callable[..., Column]) -> Callable[..., Column]:
    """A function of several values that is null as soon as one of them is."""

    def build(*xs: Column) -> Column:
        there = functools.reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])
        return F.when(there, fold(*xs) if len(xs) > 1 else xs[0])

    return build


def _total(*xs: Column) -> Column:
    return functools.reduce(lambda a, b: a + b, xs, F.lit(0.0))


_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)).cast("double"),
    # the sign of the divisor, as in Python
    ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b)),
}
_COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}
#: Functions of numbers, and of the members of a list.
_CALLS: dict[str, Callable[..., Column]] = {"abs": F.abs, "min": _all_there(F.least), "max": _all_there(F.greatest)}
_OF_LISTS: dict[str, Callable[..., Column]] = {
    "min": _CALLS["min"],
    "max": _CALLS["max"],
    "sum": _total,
    "len": lambda *xs: F.lit(float(len(xs))),
    "mean": lambda *xs: _total(*xs) / len(xs) if xs else F.lit(0.0),
}
_NAMES = {*_CALLS, *_OF_LISTS, "round"}
_NODES = (
    ast.Module, ast.Expr, ast.Assign, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.Call, ast.Name, ast.Constant, ast.List, ast.Tuple,
    ast.USub, ast.UAdd, ast.Not, ast.And, ast.Or, ast.Load, ast.Store, *_BINARY, *_COMPARE,
)


class FormulaError(ValueError):
    """A formula that uses something outside the language."""


def parse(formula: str) -> list[ast.stmt]:
    """The checked statements of a formula."""
    try:
        tree = ast.parse(formula.strip())
    except SyntaxError as wrong:
        raise FormulaError(f"not a formula: {formula!r}") from wrong
    nodes = list(ast.walk(tree))
    if len(nodes) > MAX_NODES:
        raise FormulaError(f"more than {MAX_NODES} nodes")
    for node in nodes:
        if not isinstance(node, _NODES):
            raise FormulaError(type(node).__name__)
        if isinstance(node, ast.Constant):
            if not isinstance(node.value, (bool, int, float)):
                raise FormulaError("only numbers and booleans are constants")
            if not isinstance(node.value, bool) and abs(node.value) > MAX_CONSTANT:
                raise FormulaError(f"constant beyond {MAX_CONSTANT:g}")
        elif isinstance(node, ast.Call) and (not isinstance(node.func, ast.Name) or node.func.id not in _NAMES or node.keywords):
            raise FormulaError("unknown function")
        elif isinstance(node, ast.Assign) and (len(node.targets) != 1 or not isinstance(node.targets[0], ast.Name) or node.targets[0].id.startswith("_")):
            raise FormulaError("only plain names can be assigned")
    if not tree.body or not isinstance(tree.body[-1], ast.Expr):
        raise FormulaError("the last line must be the value")
    if not all(isinstance(s, ast.Assign) for s in tree.body[:-1]):
        raise FormulaError("lines before the last must give names")
    return tree.body


def names(formula: str) -> list[str]:
    """Names that a formula reads, sorted: the columns it needs."""
    nodes = [n for line in parse(formula) for n in ast.walk(line) if isinstance(n, ast.Name)]
    given = {n.id for n in nodes if isinstance(n.ctx, ast.Store)}
    return sorted({n.id for n in nodes if isinstance(n.ctx, ast.Load)} - given - _NAMES)


def _is_flag(node: ast.expr) -> bool:
    return isinstance(node, (ast.Compare, ast.BoolOp)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not) or isinstance(node, ast.Constant) and isinstance(node.value, bool)


def compile_formula(formula: str, columns: dict[str, Column]) -> Column:
    """The Column of a formula over named columns; an unknown name is an error at compile time."""
    known = dict(columns)

    def number(node: ast.expr) -> Column:
        return build(node).cast("double") if _is_flag(node) else build(node)

    def flag(node: ast.expr) -> Column:
        return build(node) if _is_flag(node) or isinstance(node, ast.Name) else build(node) != 0

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(node.value if isinstance(node.value, bool) else float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in known:
                raise FormulaError(f"unknown name {node.id}")
            return known[node.id]
        if isinstance(node, ast.BinOp):
            return _BINARY[type(node.op)](number(node.left), number(node.right))
        if isinstance(node, ast.UnaryOp):
            return ~flag(node.operand) if isinstance(node.op, ast.Not) else -number(node.operand) if isinstance(node.op, ast.USub) else number(node.operand)
        if isinstance(node, ast.BoolOp):
            fold = (lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b)
            return functools.reduce(fold, map(flag, node.values))
        if isinstance(node, ast.Compare):
            sides = [build(node.left), *map(build, node.comparators)]
            return functools.reduce(lambda a, b: a & b, [_COMPARE[type(op)](a, b) for op, a, b in zip(node.ops, sides, sides[1:])])
        if isinstance(node, ast.IfExp):
            test = build(node.test).cast("boolean")
            return F.when(test, number(node.body)).when(~test, number(node.orelse))
        if isinstance(node, ast.Call):
            return call(node.func.id, node.args)
        raise FormulaError(type(node).__name__)

    def call(name: str, args: list[ast.expr]) -> Column:
        if len(args) == 1 and isinstance(args[0], (ast.List, ast.Tuple)) and name in _OF_LISTS:
            return _OF_LISTS[name](*map(number, args[0].elts))
        if name == "round" and args:
            digits = args[1] if len(args) == 2 else ast.Constant(0)
            if len(args) > 2 or not isinstance(digits, ast.Constant):
                raise FormulaError("round takes a value and a constant number of digits")
            return F.bround(number(args[0]), int(digits.value))
        if name == "abs" and len(args) == 1 or name in ("min", "max") and len(args) > 1:
            return _CALLS[name](*map(number, args))
        raise FormulaError(f"{name} cannot be called like this")

    *lines, last = parse(formula)
    for line in lines:
        known[line.targets[0].id] = build(line.value)
    return build(last.value)
