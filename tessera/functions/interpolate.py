"""`{column}` interpolation as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = re.compile(r"\{\{|\}\}|\{([A-Za-z_][^{}]*)\}")


def is_interpolated(text: str) -> bool:
    return any(m[1] for m in _PART.finditer(text))


def columns_of(text: str) -> list[str]:
    return list(dict.fromkeys(m[1].strip() for m in _PART.finditer(text) if m[1]))


def printed(column: Column, kind: T.DataType) -> Column:
    """Null as '', whole floats without a fraction, booleans as True and False."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        text = F.when(whole, column.cast("bigint").cast("string")).otherwise(column.cast("string"))
    elif isinstance(kind, T.BooleanType):
        text = F.when(column, "True").when(~column, "False")
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(""))


def interpolate(text: str, schema: T.StructType) -> Column:
    kinds = {f.name: f.dataType for f in schema.fields}
    parts, at = [], 0
    for m in _PART.finditer(text):
        parts.append(F.lit(text[at : m.start()] + ("" if m[1] else m[0][0])))
        if m[1]:
            name = m[1].strip()
            parts.append(printed(F.col(f"`{name}`"), kinds[name]))
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
