"""Fixed values as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..config.project import Entity
from .registry import SourceError, register


def _kind(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool} and kinds:
        return T.BooleanType()
    if kinds <= {int} and kinds:
        return T.LongType()
    if kinds <= {int, float} and kinds:
        return T.DoubleType()
    return T.StringType()


def table_of(spark: SparkSession, rows: list[list], columns: list[str]) -> DataFrame:
    """Typed by its values; columns of mixed kinds are text, columns without values too."""
    fields = [T.StructField(c, _kind([r[i] for r in rows])) for i, c in enumerate(columns)]
    cast = {"string": lambda v: v if isinstance(v, str) else str(v), "double": float}
    ready = [tuple(None if v is None else cast.get(f.dataType.simpleString(), lambda x: x)(v) for v, f in zip(r, fields, strict=True)) for r in rows]
    return spark.createDataFrame(ready, T.StructType(fields))


@register("fixed", category="values", help="rows written in the configuration")
def read_fixed(spark: SparkSession, entity: Entity, options: dict) -> DataFrame:
    """Rows as lists, scalars or mappings. Lists are as wide as columns, or as ids, keys and columns together."""
    values = entity.values if entity.values is not None else []
    plain = list(dict.fromkeys([*entity.keys, *entity.columns])) or ["value"]
    head = [c for c in (entity.system_id, entity.public_id) if c and c not in plain]
    if isinstance(values, Mapping):
        raise SourceError(f"{entity.name}: values must be a list")
    if values and all(isinstance(v, Mapping) for v in values):
        columns = list(dict.fromkeys([*[c for c in head + plain if any(c in v for v in values)], *[k for v in values for k in v]]))
        return table_of(spark, [[v.get(c) for c in columns] for v in values], columns)
    rows = [list(v) if isinstance(v, list | tuple) else [v] for v in values]
    widths = {len(r) for r in rows}
    if len(widths) > 1:
        raise SourceError(f"{entity.name}: rows are {sorted(widths)} wide")
    options_ = [list(entity.columns) or ["value"], plain, head[:1] + plain, head + plain, head[1:] + plain]
    columns = next((c for c in options_ if not widths or len(c) == next(iter(widths))), None)
    if columns is None:
        raise SourceError(f"{entity.name}: rows have {next(iter(widths))} values for columns {plain}")
    return table_of(spark, rows, columns)
