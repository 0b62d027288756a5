"""Derived columns: constants, copies, formulas, interpolation; order-dependent, idempotent, deferrable."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formula, interpolate
from .shared import quoted


class MissingColumns(ValueError):
    pass


def _actual(name: str, columns: list[str]) -> str | None:
    return name if name in columns else next((c for c in columns if c.lower() == name.lower()), None)


def mode_of(value: object, columns: list[str], keys: Mapping[str, object] = ()) -> str:
    """constant, literal (==...), formula (=...), interpolation ({...}), copy, or string."""
    if not isinstance(value, str):
        return "constant"
    if value.startswith("=="):
        return "literal"
    if value.startswith("="):
        return "formula"
    if interpolate.is_interpolated(value):
        return "interpolation"
    return "copy" if value not in keys and _actual(value, columns) else "string"


def sources_of(value: object, columns: list[str]) -> set[str]:
    """Columns a derived column reads."""
    match mode_of(value, columns):
        case "formula":
            return formula.columns_of(value)
        case "interpolation":
            return set(interpolate.columns_of(value))
        case "copy":
            return {_actual(value, columns)}
    return set()


def split_copies(extra: Mapping[str, object], columns: list[str]) -> tuple[dict, dict]:
    """(copies, the rest)."""
    copies = {k: v for k, v in extra.items() if mode_of(v, columns, extra) == "copy"}
    return copies, {k: v for k, v in extra.items() if k not in copies}


def add_extra_columns(df: DataFrame, extra: Mapping[str, object], defer_missing: bool = False) -> tuple[DataFrame, dict[str, object]]:
    """df with the columns it can have now, and those left for later.

    Columns that are there are not touched. With defer_missing, formulas and interpolations whose inputs are not there wait;
    otherwise they raise MissingColumns. Copies of columns that never come are string constants.
    """
    waiting = dict(extra)
    while True:
        moved = False
        for name, value in list(waiting.items()):
            if name in df.columns:
                del waiting[name]
                continue
            mode = mode_of(value, df.columns, extra)
            if mode in ("formula", "interpolation"):
                needed = sources_of(value, df.columns)
                found = {c: _actual(c, df.columns) for c in needed}
                if None in found.values():
                    continue
                if any(k != v for k, v in found.items()):
                    known = df.withColumns({k: quoted(v) for k, v in found.items() if k != v})
                else:
                    known = df
                column = formula.compile_formula(value, known.schema) if mode == "formula" else interpolate.interpolate(value, known.schema)
                df = known.withColumn(name, column).select(*[quoted(c) for c in df.columns], quoted(name))
            elif mode == "copy":
                df = df.withColumn(name, quoted(_actual(value, df.columns)))
            else:
                df = df.withColumn(name, F.lit(value[1:] if mode == "literal" else value))
            del waiting[name]
            moved = True
        if not moved or not waiting:
            break
    if waiting and not defer_missing:
        raise MissingColumns("; ".join(f"{k} needs {', '.join(sorted(sources_of(v, df.columns) - set(df.columns)))}" for k, v in waiting.items()))
    return df, waiting
