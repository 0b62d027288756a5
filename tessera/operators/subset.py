"""Projection, renames, duplicates, empty rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, pick, quoted


class SubsetError(ValueError):
    pass


def select_columns(df: DataFrame, columns: Sequence[str], raise_if_missing: bool = False, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """The columns in this order, once each; missing ones raise or are skipped. aliases: new name -> source column."""
    for new, old in (aliases or {}).items():
        if new not in df.columns and old in df.columns:
            df = df.withColumn(new, quoted(old))
    wanted = list(dict.fromkeys(columns))
    missing = [c for c in wanted if c not in df.columns]
    if missing and raise_if_missing:
        raise SubsetError(f"columns not found: {', '.join(missing)}")
    return pick(df, [c for c in wanted if c in df.columns])


def translate_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames columns; one whose new name is already there stays as it is."""
    taken = set(df.columns)
    moves = {}
    for old in df.columns:
        new = names.get(old)
        if new and new != old and new not in taken:
            moves[old] = new
            taken.add(new)
    return df.withColumnsRenamed(moves)


def translation_map(fields: Sequence[Mapping], from_field: str, to_field: str) -> dict[str, str]:
    return {f[from_field]: f[to_field] for f in fields if f.get(from_field) and f.get(to_field)}


def rename_last(columns: Sequence[str], old: str, new: str) -> list[str]:
    """The names with the last `old` renamed, for toDF()."""
    at = max((i for i, c in enumerate(columns) if c == old), default=None)
    return [new if i == at else c for i, c in enumerate(columns)]


def drop_duplicates(df: DataFrame, columns: Sequence[str] | bool | None = True, order: Sequence[str] = ()) -> DataFrame:
    """One row for each value of the columns (null equals null): the first in order.

    All columns: a plain distinct. Without an order the least row of all columns is taken, so that the result does not
    depend on partitioning. Columns that are not there: nothing is dropped.
    """
    if not columns:
        return df
    if columns is True or set(columns) >= set(df.columns):
        return df.distinct()
    columns = [columns] if isinstance(columns, str) else list(columns)
    if not set(columns) <= set(df.columns):
        return df
    by = [quoted(c).asc_nulls_last() for c in order if c in df.columns]
    if not by:
        by = [quoted(c).asc_nulls_last() for c in df.columns if c not in columns and not isinstance(df.schema[c].dataType, T.MapType)] or [F.lit(1)]
    place = fresh("__place", df.columns)
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*[quoted(c) for c in columns]).orderBy(*by))).where(F.col(place) == 1).drop(place)


def fd_violations(df: DataFrame, determinant: Sequence[str], dependent: Sequence[str] | None = None) -> DataFrame:
    """Determinant values with more than one distinct dependent row (nulls compare equal), and how many."""
    others = [c for c in dependent or df.columns if c not in determinant]
    keys = [quoted(c) for c in determinant]
    if not others:
        return df.select(*keys, F.lit(0).cast("long").alias("n_variants")).limit(0)
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*[quoted(c) for c in others])).alias("n_variants")).where("n_variants > 1")


class FunctionalDependencyError(SubsetError):
    pass


def check_fd(df: DataFrame, determinant: Sequence[str], strict: bool = True, samples: int = 5) -> list[tuple]:
    """A few violating keys; raises if strict. Keys that are not there count as satisfied."""
    if not determinant or not set(determinant) <= set(df.columns):
        return []
    bad = [tuple(r)[:-1] for r in fd_violations(df, determinant).orderBy(*[quoted(c) for c in determinant]).limit(samples).collect()]
    if bad and strict:
        raise FunctionalDependencyError(f"{', '.join(determinant)} does not determine the other columns, e.g. for {bad}")
    return bad


def drop_empty_rows(df: DataFrame, subset: bool | Sequence[str] | Mapping[str, Sequence] = True) -> DataFrame:
    """Drops rows whose subset is all null. Empty strings (or the values given for a column) count as null, and become null in rows that stay."""
    if not subset:
        return df
    if isinstance(subset, Mapping):
        empties = {c: [v for v in vs if v is not None] for c, vs in subset.items()}
    else:
        empties = dict.fromkeys(df.columns if subset is True else [subset] if isinstance(subset, str) else subset, [""])
    empties = {c: v for c, v in empties.items() if c in df.columns}
    if not empties:
        return df
    for c, values in empties.items():
        if values and (isinstance(df.schema[c].dataType, T.StringType) or any(not isinstance(v, str) for v in values)):
            df = df.withColumn(c, F.when(~F.coalesce(quoted(c).cast("string").isin([str(v) for v in values]), F.lit(False)), quoted(c)))
    return df.dropna("all", subset=list(empties))
