"""Row predicates written as Python-style expressions, compiled to Column.

Grammar: comparisons (chains too), and / or / not (also & | ~), in and not in with lists, columns on both sides,
`backticked names`, arithmetic, .isin(), .isna(), .isnull(), .notna(), .notnull(), .between(), .str.contains(),
.str.startswith(), .str.endswith(), .str.lower(), .str.upper(), .str.len().

Nulls follow dataframe rules instead of SQL's: a comparison with null is false, `!=` with null is true, and
`not` turns false into true, so that rows with nulls pass negations. `in` matches null if the list names None.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import java_pattern


class PredicateError(ValueError):
    pass


_TICKS = re.compile(r"`([^`]+)`")
_COMPARE = {
    ast.Eq: lambda a, b: F.coalesce(a == b, F.lit(False)),
    ast.NotEq: lambda a, b: ~F.coalesce(a == b, F.lit(False)),
    ast.Lt: lambda a, b: F.coalesce(a < b, F.lit(False)),
    ast.LtE: lambda a, b: F.coalesce(a <= b, F.lit(False)),
    ast.Gt: lambda a, b: F.coalesce(a > b, F.lit(False)),
    ast.GtE: lambda a, b: F.coalesce(a >= b, F.lit(False)),
}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Mod: lambda a, b: a % b}


def member(column: Column, values: list) -> Column:
    known = [v for v in values if v is not None]
    out = F.coalesce(column.isin(known), F.lit(False)) if known else F.lit(False)
    return out | column.isNull() if None in values else out


def _constant(node: ast.expr):
    try:
        return ast.literal_eval(node)
    except ValueError:
        raise PredicateError("only literals can be listed here") from None


class _Compiler:
    def __init__(self, names: dict[str, str], columns: list[str]):
        self.names, self.columns = names, columns

    def name(self, node: ast.Name) -> Column:
        name = self.names.get(node.id, node.id)
        if name not in self.columns:
            raise PredicateError(f"unknown column {name}")
        return F.col(f"`{name}`")

    def value(self, node: ast.expr) -> Column:
        match node:
            case ast.Name(id="True" | "true"):
                return F.lit(True)
            case ast.Name():
                return self.name(node)
            case ast.Constant():
                return F.lit(node.value)
            case ast.UnaryOp(op=ast.USub()):
                return -self.value(node.operand)
            case ast.BinOp(op=op) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](self.value(node.left), self.value(node.right))
            case ast.Call(func=ast.Attribute(attr="lower" | "upper" | "len" | "strip" as what, value=ast.Attribute(attr="str", value=base))):
                f = {"lower": F.lower, "upper": F.upper, "len": F.length, "strip": F.trim}[what]
                return f(self.value(base))
        return self.test(node)

    def test(self, node: ast.expr) -> Column:
        match node:
            case ast.BoolOp(op=op):
                out = self.test(node.values[0])
                for v in node.values[1:]:
                    out = out & self.test(v) if isinstance(op, ast.And) else out | self.test(v)
                return out
            case ast.BinOp(op=ast.BitAnd()):
                return self.test(node.left) & self.test(node.right)
            case ast.BinOp(op=ast.BitOr()):
                return self.test(node.left) | self.test(node.right)
            case ast.UnaryOp(op=ast.Not() | ast.Invert()):
                return ~self.test(node.operand)
            case ast.Compare():
                out, left = None, node.left
                for op, right in zip(node.ops, node.comparators, strict=True):
                    part = self.compare(left, op, right)
                    out, left = part if out is None else out & part, right
                return out
            case ast.Call(func=ast.Attribute()):
                return self.call(node)
            case ast.Name():
                return F.coalesce(self.name(node).cast("boolean"), F.lit(False))
            case ast.Constant(value=bool()):
                return F.lit(node.value)
        raise PredicateError(f"not a predicate: {ast.unparse(node)}")

    def compare(self, left: ast.expr, op: ast.cmpop, right: ast.expr) -> Column:
        if isinstance(op, ast.In | ast.NotIn):
            out = member(self.value(left), list(_constant(right)))
            return ~out if isinstance(op, ast.NotIn) else out
        if isinstance(right, ast.List | ast.Tuple) and isinstance(op, ast.Eq | ast.NotEq):  # == [..] means in
            return self.compare(left, ast.In() if isinstance(op, ast.Eq) else ast.NotIn(), right)
        if type(op) not in _COMPARE:
            raise PredicateError(f"unsupported comparison {type(op).__name__}")
        return _COMPARE[type(op)](self.value(left), self.value(right))

    def call(self, node: ast.Call) -> Column:
        what, base = node.func.attr, node.func.value
        options = {k.arg: _constant(k.value) for k in node.keywords}
        if isinstance(base, ast.Attribute) and base.attr == "str":
            column, text = self.value(base.value), _constant(node.args[0])
            if what == "contains":
                case = options.get("case", True)
                if options.get("regex", True):
                    found = F.regexp_like(column, F.lit(("" if case else "(?i)") + java_pattern(text)))
                else:
                    found = F.contains(column if case else F.lower(column), F.lit(text if case else text.lower()))
            elif what in ("startswith", "endswith"):
                found = getattr(F, what)(column, F.lit(text))
            else:
                raise PredicateError(f"unsupported .str.{what}()")
            return F.coalesce(found, F.lit(bool(options.get("na", False))))
        column = self.value(base)
        if what == "isin":
            return member(column, list(_constant(node.args[0])))
        if what in ("isna", "isnull"):
            return column.isNull()
        if what in ("notna", "notnull"):
            return column.isNotNull()
        if what == "between":
            return F.coalesce(column.between(self.value(node.args[0]), self.value(node.args[1])), F.lit(False))
        raise PredicateError(f"unsupported .{what}()")


def compile_predicate(text: str, columns: list[str]) -> Column:
    names: dict[str, str] = {}

    def ticked(m: re.Match) -> str:
        names[f"_column_{len(names)}"] = m[1]
        return f"_column_{len(names) - 1}"

    try:
        tree = ast.parse(_TICKS.sub(ticked, text.strip()), mode="eval").body
    except SyntaxError as e:
        raise PredicateError(f"cannot read {text!r}: {e.msg}") from None
    return _Compiler(names, columns).test(tree)
