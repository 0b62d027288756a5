"""Transformers: steps over some columns of a table, by name, with options; new ones can be registered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..config.registry import Registry
from ..operators.shared import quoted
from . import geo
from .replace import translate_values

#: (df, columns, **options) -> df
TRANSFORMERS = Registry("transformer")


class TransformError(ValueError):
    pass


@TRANSFORMERS.register("translate")
def translate(df: DataFrame, columns: Sequence[str], mapping: Mapping) -> DataFrame:
    return df.withColumns({c: translate_values(quoted(c), mapping) for c in columns})


@TRANSFORMERS.register("geo_split")
def geo_split(df: DataFrame, columns: Sequence[str], sep: str = ",", lat_suffix: str = "_lat", lon_suffix: str = "_lon") -> DataFrame:
    if len(columns) != 1:
        raise TransformError("geo_split takes one column")
    return geo.geo_split(df, columns[0], sep, lat_suffix, lon_suffix)


@TRANSFORMERS.register("geo_convert_crs")
def geo_convert_crs(df: DataFrame, columns: Sequence[str], dst_crs: int | str, src_crs: int | str | None = None, src_crs_label_column: str | None = None, lon_column: str = "lon", lat_column: str = "lat") -> DataFrame:
    """x and y to lon_column and lat_column. The label column, where the table has it, is followed row by row."""
    if len(columns) != 2:
        raise TransformError("geo_convert_crs takes two columns, x and y")
    by_row = bool(src_crs_label_column) and src_crs_label_column in df.columns
    if not by_row and src_crs is None:
        raise TransformError("geo_convert_crs needs src_crs or a column of labels")
    names = lon_column or columns[0], lat_column or columns[1]
    return geo.convert_crs(df, *columns, src_crs_label_column if by_row else src_crs, dst_crs, source_column=by_row, names=names)


def transform(df: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Applies steps {name, columns, ...options} in turn; columns is a name or a list of names that the table has."""
    for step in steps:
        options = {k: v for k, v in step.items() if k not in ("name", "columns")}
        columns = [step["columns"]] if isinstance(step["columns"], str) else list(step["columns"])
        lacking = [c for c in columns if c not in df.columns]
        if lacking:
            raise TransformError(f"{step['name']}: no column {', '.join(lacking)}")
        df = TRANSFORMERS[step["name"]](df, columns, **options)
    return df
