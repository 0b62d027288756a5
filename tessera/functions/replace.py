"""Value replacement rules as Column expressions, composed left to right over one column.

Rule shapes: a mapping {old: new} (all at once), a scalar or list (blank those values, then fill forward), or a list of
rules with `blank_out`, `map`, `match`/`from`/`to`, `normalize`, `coerce` and `flags`. A negated match never touches nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import flagged, java_pattern, java_replacement


class ReplacementError(ValueError):
    pass


_NORMAL = {
    "strip": lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""),
    "lower": F.lower,
    "upper": F.upper,
    "collapse_ws": lambda c: F.regexp_replace(c, r"(?U)\s+", " "),
}


def normalized(column: Column, ops) -> Column:
    column = column.cast("string")
    for op in [ops] if isinstance(ops, str) else ops or []:
        if op not in _NORMAL:
            raise ReplacementError(f"unknown normalize operation {op}")
        column = _NORMAL[op](column)
    return column


def coerced(column: Column, kind: str | None) -> Column:
    """string; float (null where it is no number); int (null too where it has a fraction)."""
    if kind is None:
        return column
    match str(kind).lower():
        case "string" | "str":
            return column.cast("string")
        case "float":
            return column.cast("string").try_cast("double")
        case "int" | "integer":
            number = column.cast("string").try_cast("double")
            return F.when(number % 1 == 0, number.cast("bigint"))
    raise ReplacementError(f"unknown coerce {kind}")


def _literal(value, rule: Mapping) -> Column:
    """A rule's own value goes through the same normalising and coercing as the cells it is compared with."""
    out = F.lit(value)
    return _shape(out, rule) if value is not None else out


def _shape(column: Column, rule: Mapping) -> Column:
    out = normalized(column, rule["normalize"]) if rule.get("normalize") else column
    return coerced(out, rule.get("coerce"))


@dataclass(frozen=True)
class State:
    """The column so far, its type, and the order and groups that fills need."""

    column: Column
    kind: T.DataType
    order: tuple[str, ...] = ()


def _put(state: State, test: Column, to) -> Column:
    """Replaces where test holds; a value of another kind turns the column into text."""
    new = F.lit(to)
    column = state.column
    if to is not None and isinstance(to, str) != isinstance(state.kind, T.StringType):
        column, new = column.cast("string"), F.lit(str(to))
    return F.when(F.coalesce(test, F.lit(False)), new).otherwise(column)


def _negatable(test: Column, column: Column, negate: bool) -> Column:
    return column.isNotNull() & ~F.coalesce(test, F.lit(False)) if negate else test


def _ignore_case(rule: Mapping) -> bool:
    flags = rule.get("flags") or []
    return any(str(f).lower() in ("i", "ignorecase") for f in ([flags] if isinstance(flags, str) else flags))


def _text(rule: Mapping, column: Column, value) -> tuple[Column, Column]:
    left, right = _shape(column, rule).cast("string"), _literal(str(value), rule).cast("string")
    return (F.lower(left), F.lower(right)) if _ignore_case(rule) else (left, right)


def _equals(rule: Mapping, state: State, negate: bool) -> Column:
    wanted = rule.get("from")
    if wanted is None:
        return _put(state, state.column.isNull() if not negate else state.column.isNotNull(), rule.get("to"))
    shaped = rule.get("normalize") or rule.get("coerce") or _ignore_case(rule)
    a, b = _text(rule, state.column, wanted) if shaped else (state.column.cast("string"), F.lit(_printed(wanted)))
    return _put(state, _negatable(a == b, state.column, negate), rule.get("to"))


def _printed(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _affix(find: Callable[[Column, Column], Column]):
    def rule_of(rule: Mapping, state: State, negate: bool) -> Column:
        a, b = _text(rule, state.column, rule["from"])
        return _put(state, _negatable(find(a, b), state.column, negate), rule.get("to"))

    return rule_of


def _in(rule: Mapping, state: State, negate: bool) -> Column:
    values = rule["from"] if isinstance(rule["from"], list | tuple | set) else [rule["from"]]
    pairs = [_text(rule, state.column, v) for v in values if v is not None]
    test = pairs[0][0].isin(*[b for _, b in pairs]) if pairs else F.lit(False)
    if None in values:
        test = F.coalesce(test, F.lit(False)) | state.column.isNull()
    return _put(state, _negatable(test, state.column, negate), rule.get("to"))


def _regex(rule: Mapping, state: State, negate: bool) -> Column:
    pattern = flagged("^(?:" + java_pattern(str(rule["from"])) + ")", rule.get("flags"))
    return _put(state, _negatable(F.regexp_like(_shape(state.column, rule).cast("string"), F.lit(pattern)), state.column, negate), rule.get("to"))


def _regex_sub(rule: Mapping, state: State, negate: bool) -> Column:
    pattern, text = flagged(java_pattern(str(rule["from"])), rule.get("flags")), _shape(state.column, rule).cast("string")
    if rule.get("to") is None:
        return F.when(~F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)), state.column)
    return F.regexp_replace(text, pattern, java_replacement(str(rule["to"])))


def _transform(rule: Mapping, state: State, negate: bool) -> Column:
    return _shape(state.column, rule)


def _map(rule: Mapping, state: State, negate: bool) -> Column:
    return mapped(state, rule["map"], rule)


def mapped(state: State, mapping: Mapping, rule: Mapping | None = None) -> Column:
    """All values at once, on the original column; later keys win where normalising makes keys equal."""
    rule = rule or {}
    same_kind = all(v is None or isinstance(v, str) == isinstance(state.kind, T.StringType) for v in mapping.values())
    out = state.column if same_kind else state.column.cast("string")
    for old, new in mapping.items():
        if old is None:
            test = state.column.isNull()
        elif rule.get("normalize") or rule.get("coerce") or _ignore_case(rule):
            a, b = _text(rule, state.column, old)
            test = a == b
        else:
            test = state.column.cast("string") == _printed(old)
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(new if same_kind or new is None else str(new))).otherwise(out)
    return out


def filled(column: Column, how) -> Column:
    """none, a value, or {constant: value}. Fills from neighbouring rows are made over ranges, see below."""
    if isinstance(how, Mapping):
        return F.coalesce(column, F.lit(how.get("constant")))
    return column if how is None or how == "none" else F.coalesce(column, F.lit(how))


def _blank_out(rule: Mapping, state: State, negate: bool) -> Column:
    values = rule["blank_out"]
    values = list(values) if isinstance(values, list | tuple | set) else [values]
    known = [_printed(v) for v in values if v is not None]
    blank = state.column.cast("string").isin(known) if known else F.lit(False)
    return filled(coerced(F.when(~F.coalesce(blank, F.lit(False)), state.column), rule.get("coerce")), rule.get("fill"))


#: rule kinds; more can be added, each (rule, state, negate) -> Column
RULES: dict[str, Callable[[Mapping, State, bool], Column]] = {
    "equals": _equals,
    "contains": _affix(lambda a, b: F.contains(a, b)),
    "startswith": _affix(lambda a, b: F.startswith(a, b)),
    "endswith": _affix(lambda a, b: F.endswith(a, b)),
    "in": _in,
    "regex": _regex,
    "regex_sub": _regex_sub,
    "transform": _transform,
    "map": _map,
    "blank_out": _blank_out,
}


def kind_of(rule: Mapping) -> tuple[str, bool]:
    if "blank_out" in rule or "map" in rule:
        return ("blank_out" if "blank_out" in rule else "map"), False
    if not {"match", "from"} & set(rule) and {"normalize", "coerce"} & set(rule):
        return "transform", False
    name = str(rule.get("match", "equals")).lower()
    return (name[4:], True) if name.startswith("not_") else (name, False)


def is_rules(spec) -> bool:
    return isinstance(spec, list) and bool(spec) and all(isinstance(r, Mapping) for r in spec)


def needs_order(spec) -> bool:
    """Whether a column's replacements fill from neighbouring rows."""
    if isinstance(spec, Mapping):
        return False
    if is_rules(spec):
        return any("blank_out" in r and r.get("fill", "forward") in ("forward", "ffill", "backward", "bfill") for r in spec)
    return True


def _fill_over_ranges(df: DataFrame, fills: Mapping[str, tuple[Column, bool]], order: tuple[str, ...]) -> DataFrame:
    """Fills columns (name -> value with gaps, whether forward) in row order without bringing all rows to one task: within ranges
    of the order, then across their ends.

    Rows are sorted once for all columns, ascending and nulls last, whatever the keys' kinds, and keep their places in that order as numbers, by
    which all else goes; backward fills run the same places the other way.
    """
    from ..operators.shared import fixed, fresh

    part, place = (fresh(x, df.columns) for x in ("__range", "__place"))
    inner = {name: (fresh(f"__v{i}", df.columns), fresh(f"__end{i}", df.columns)) for i, name in enumerate(fills)}
    by = [F.col(f"`{c}`").asc_nulls_last() for c in order]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in fills]
    gaps = df.withColumns({inner[name][0]: value for name, (value, _) in fills.items()})
    ranged = gaps.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()})
    placed = fixed(ranged.select(*rest, *[value for value, _ in inner.values()], part, place))
    ends, carry, filled = [], [], {}
    so_far, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    for name, (_, forward) in fills.items():
        value, end = inner[name]
        along = F.asc if forward else F.desc  # for a frame that ends with the last row, Spark would read the rows that are left anew at each row
        at = F.when(F.col(value).isNotNull(), F.col(place))
        ends.append((F.max_by if forward else F.min_by)(value, at).alias(end))
        carry.append(F.last(end, True).over(Window.orderBy(along(part)).rowsBetween(*before)).alias(end))
        filled[name] = F.coalesce(F.last(value, True).over(Window.partitionBy(part).orderBy(along(place)).rowsBetween(*so_far)), F.col(end))
    carried = placed.groupBy(part).agg(*ends).select(part, *carry)  # one row per range
    return placed.join(F.broadcast(carried), part).withColumns(filled).select(*[F.col(f"`{c}`") for c in df.columns])


def _steps(spec) -> list[Mapping]:
    if isinstance(spec, Mapping):
        return [{"map": spec}]
    return list(spec) if is_rules(spec) else [{"blank_out": spec, "fill": "forward"}]


_FORWARD, _BACKWARD = ("forward", "ffill"), ("backward", "bfill")


def _replaced(df: DataFrame, todo: dict[str, list[Mapping]], order: tuple[str, ...]) -> DataFrame:
    """Applies the rules of several columns, each column's in turn; columns that wait for a fill are filled together."""
    while any(todo.values()):
        fills = {}
        for name, rules in todo.items():
            while rules and name not in fills:
                rule = rules.pop(0)
                kind, negate = kind_of(rule)
                if kind not in RULES:
                    raise ReplacementError(f"{name}: unknown rule {kind}")
                state = State(F.col(f"`{name}`"), df.schema[name].dataType, order)
                how = rule.get("fill", "forward") if kind == "blank_out" else None
                if how in (*_FORWARD, *_BACKWARD):
                    if not order:
                        raise ReplacementError(f"{name}: filling needs an order of rows")
                    fills[name] = _blank_out({**rule, "fill": None}, state, False), how in _FORWARD
                else:
                    df = df.withColumn(name, RULES[kind](rule, state, negate))
        if fills:
            df = _fill_over_ranges(df, fills, order)
    return df


def apply_replacements(df: DataFrame, replacements: Mapping[str, object], order: tuple[str, ...] = ()) -> DataFrame:
    """The replacements of each column, in turn; columns that are not there are skipped."""
    todo = {name: _steps(spec) for name, spec in (replacements or {}).items() if name in df.columns and spec is not None}
    if not set(todo) & set(order):
        return _replaced(df, todo, order)
    for name, rules in todo.items():  # a column that rows are ordered by changes before the columns after it are filled
        df = _replaced(df, {name: rules}, order)
    return df


def replaced_counts(before: DataFrame, replacements: Mapping[str, object], order: tuple[str, ...] = ()) -> DataFrame:
    """(column, rule, kind, replaced): how many cells each rule changes, of all rows, in the order in which rules apply.

    A cell counts where its text differs afterwards, becomes null or stops being null. One pass for all rules of all columns that need no
    neighbouring rows; a rule that fills from them settles its column first.
    """
    from ..operators.shared import fresh

    counts, df, steps = [], before, 0
    for name, spec in (replacements or {}).items():
        if name not in df.columns or spec is None:
            continue
        for k, rule in enumerate(_steps(spec)):
            kept = fresh(f"__before{steps}", before.columns)
            df = apply_replacements(df.withColumn(kept, F.col(f"`{name}`").cast("string")), {name: [rule]}, order)
            df = df.withColumn(kept, ~F.col(kept).eqNullSafe(F.col(f"`{name}`").cast("string")))
            counts.append((name, k, kind_of(rule)[0], kept))
            steps += 1
    if not counts:
        return before.sparkSession.createDataFrame([], "column string, rule int, kind string, replaced long")
    one = df.agg(*[F.count_if(F.col(c)).alias(c) for *_, c in counts])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(k).alias("rule"), F.lit(kind).alias("kind"), F.col(c).alias("replaced")) for n, k, kind, c in counts])))


def unmatched(df: DataFrame, name: str, mapping: Mapping, top: int = 10) -> DataFrame:
    """(value, count): the commonest values that a mapping does not name; ties by value."""
    known = [_printed(k) for k in mapping if k is not None]
    rest = df.where(F.col(f"`{name}`").isNotNull() & ~F.col(f"`{name}`").cast("string").isin(known))
    return rest.groupBy(F.col(f"`{name}`").alias("value")).count().orderBy(F.desc("count"), "value").limit(top)


def translate_values(column: Column, mapping: Mapping[str, str]) -> Column:
    """The mapped value, or the original where none is given."""
    return mapped(State(column, T.StringType()), mapping)
