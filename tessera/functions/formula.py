"""Formulas: `=concat(upper(a), '/', b)` compiled to Column expressions.

A formula is calls, column names and literals (strings, integers, null, true, false); there are no
operators. It is checked on the driver (functions, numbers of arguments, size), then compiled, so
that nothing but Spark's own expressions runs.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH, MAX_NODES, MAX_LENGTH = 20, 500, 10_000
_WORDS = {"null": None, "true": True, "false": False}


class FormulaError(ValueError):
    def __init__(self, message: str, column: int | None = None):
        self.column = column
        super().__init__(message if column is None else f"{message} (at character {column + 1})")


def as_text(column: Column, kind: T.DataType | None = None) -> Column:
    """How a formula prints a value: booleans as True/False, doubles with their fraction."""
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    return column.cast("string")


def _slice(x: Column, start: int, length: int) -> Column:
    """Characters start .. start+length, where negative places count from the end and are cut at 0."""
    if length < 0:
        raise FormulaError("substr needs a length of 0 or more")
    place = lambda i: F.lit(i) if i >= 0 else F.greatest(F.length(x) + i, F.lit(0))
    if start >= 0:
        return F.substr(x, F.lit(start + 1), F.lit(length))
    return F.substr(x, place(start) + 1, F.greatest(place(start + length) - place(start), F.lit(0)))


@dataclass(frozen=True)
class Function:
    least: int
    most: int | None
    build: Callable[[Sequence[Column]], Column]
    #: places of arguments that must be integer literals
    literals: tuple[int, ...] = ()


def _concat(args: Sequence[Column]) -> Column:
    return args[0] if len(args) == 1 else F.concat_ws("", *args)


FUNCTIONS: dict[str, Function] = {
    "concat": Function(1, None, _concat),
    "upper": Function(1, 1, lambda a: F.upper(a[0])),
    "lower": Function(1, 1, lambda a: F.lower(a[0])),
    "trim": Function(1, 1, lambda a: F.regexp_replace(a[0], r"(?U)^\s+|\s+$", "")),
    "substr": Function(3, 3, lambda a: _slice(*a), literals=(1, 2)),
    "coalesce": Function(1, None, lambda a: F.coalesce(*a)),
}


def _tree(source: str) -> ast.expr:
    text = source.removeprefix("=")
    if len(text) > MAX_LENGTH:
        raise FormulaError(f"formula is longer than {MAX_LENGTH} characters")
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"cannot read formula: {e.msg}", (e.offset or 1) - 1) from None


def _check(node: ast.expr, functions: Mapping[str, Function], depth: int = 1) -> tuple[int, set[str]]:
    """Number of nodes and the columns used; raises FormulaError."""
    if depth > MAX_DEPTH:
        raise FormulaError(f"formula nests deeper than {MAX_DEPTH}", node.col_offset)
    if isinstance(node, ast.Name):
        return 1, set() if node.id in _WORDS else {node.id}
    if isinstance(node, ast.Constant) and (node.value is None or isinstance(node.value, str | int | bool)):
        return 1, set()
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and type(node.operand.value) is int:
        return 1, set()
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        name = node.func.id
        if name not in functions:
            raise FormulaError(f"unknown function {name}", node.col_offset)
        f = functions[name]
        if len(node.args) < f.least or (f.most is not None and len(node.args) > f.most):
            raise FormulaError(f"{name} takes {f.least}{'' if f.most == f.least else ' or more'} arguments, not {len(node.args)}", node.col_offset)
        for k in f.literals:
            if _literal(node.args[k]) is None:
                raise FormulaError(f"argument {k + 1} of {name} must be an integer literal", node.args[k].col_offset)
        nodes, used = 1, set()
        for a in node.args:
            n, u = _check(a, functions, depth + 1)
            nodes, used = nodes + n, used | u
        if nodes > MAX_NODES:
            raise FormulaError(f"formula has more than {MAX_NODES} parts")
        return nodes, used
    raise FormulaError("a formula has calls, column names and literals only", node.col_offset)


def _literal(node: ast.expr) -> int | None:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        return -node.operand.value
    return node.value if isinstance(node, ast.Constant) and type(node.value) is int else None


def columns_of(source: str, functions: Mapping[str, Function] = FUNCTIONS) -> set[str]:
    return _check(_tree(source), functions)[1]


def validate(source: str, functions: Mapping[str, Function] = FUNCTIONS, columns: Sequence[str] | None = None) -> list[str]:
    """What is wrong with a formula, as messages."""
    try:
        used = columns_of(source, functions)
    except FormulaError as e:
        return [str(e)]
    return [f"unknown column {c}" for c in sorted(used - set(columns))] if columns is not None else []


def compile_formula(source: str, schema: T.StructType, functions: Mapping[str, Function] = FUNCTIONS) -> Column:
    tree = _tree(source)
    _check(tree, functions)
    kinds = {f.name: f.dataType for f in schema.fields}

    def kind_of(node: ast.expr) -> T.DataType:
        if isinstance(node, ast.Name) and node.id not in _WORDS:
            return kinds[node.id]
        if isinstance(node, ast.Call):
            if node.func.id == "coalesce":
                known = {k for a in node.args if not isinstance(k := kind_of(a), T.NullType)}
                return known.pop() if len(known) == 1 else T.StringType() if known else T.NullType()
            return T.StringType()
        value = _WORDS.get(node.id) if isinstance(node, ast.Name) else getattr(node, "value", -1)
        return T.NullType() if value is None else T.BooleanType() if isinstance(value, bool) else T.StringType() if isinstance(value, str) else T.LongType()

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            if node.id in _WORDS:
                return F.lit(_WORDS[node.id])
            if node.id not in kinds:
                raise FormulaError(f"unknown column {node.id}", node.col_offset)
            return F.col(f"`{node.id}`")
        if isinstance(node, ast.Call):
            f = functions[node.func.id]
            args = []
            same = node.func.id == "coalesce" and not isinstance(kind_of(node), T.StringType)
            for k, a in enumerate(node.args):
                if k in f.literals:
                    args.append(_literal(a))
                else:
                    args.append(build(a) if same else as_text(build(a), kind_of(a)))
            return f.build(args)
        return F.lit(_literal(node) if isinstance(node, ast.UnaryOp) else node.value)

    return build(tree)


def with_formula(df: DataFrame, name: str, source: str, functions: Mapping[str, Function] = FUNCTIONS) -> DataFrame:
    return df.withColumn(name, compile_formula(source, df.schema, functions))
