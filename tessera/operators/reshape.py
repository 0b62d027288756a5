"""Unpivot, union and typed union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config.project import Entity, Unnest
from .shared import quoted


class ReshapeError(ValueError):
    pass


def common_type(kinds: Sequence[T.DataType]) -> T.DataType:
    """One type that holds all: the same, a wider number, or text."""
    kinds = [k for k in dict.fromkeys(kinds) if not isinstance(k, T.NullType)]
    if not kinds:
        return T.StringType()
    if len(kinds) == 1:
        return kinds[0]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType()
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType()
    return T.StringType()


def unnest(df: DataFrame, spec: Unnest) -> DataFrame:
    """One row for each value column, nulls kept; columns neither ids nor values are dropped. Done already: unchanged."""
    if spec.value_name in df.columns:
        return df
    missing = [c for c in (*spec.id_vars, *spec.value_vars) if c not in df.columns]
    if missing:
        raise ReshapeError(f"unnest: no column {', '.join(missing)}")
    ids = list(spec.id_vars)
    values = list(spec.value_vars) or [c for c in df.columns if c not in ids]
    kind = common_type([df.schema[c].dataType for c in values])
    typed = df.select(*[quoted(c) for c in ids], *[quoted(c).cast(kind).alias(c) for c in values])
    return typed.unpivot([quoted(c) for c in ids], [quoted(c) for c in values], spec.var_name, spec.value_name)


def after_unnest(columns: Sequence[str], spec: Unnest | None) -> list[str]:
    """Column names once unnested."""
    if spec is None or spec.value_name in columns:
        return list(columns)
    return [*[c for c in columns if c in spec.id_vars], spec.var_name, spec.value_name]


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; missing columns are null, and columns of differing types meet in one that holds both."""
    if len(parts) == 1:
        return parts[0]
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    kinds = {n: common_type([p.schema[n].dataType for p in parts if n in p.columns]) for n in names}
    typed = [p.select(*[(quoted(n).cast(kinds[n]) if n in p.columns else F.lit(None).cast(kinds[n])).alias(n) for n in names]) for p in parts]
    out = typed[0]
    for p in typed[1:]:
        out = out.unionByName(p)
    return out


def aligned(df: DataFrame, part: Entity, parent_columns: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """An appended part under its parent's names: by mapping, by position (ids left out), or as it is."""
    if part.column_mapping:
        missing = [c for c in part.column_mapping if c not in df.columns]
        if missing:
            raise ReshapeError(f"append: no column {', '.join(missing)}")
        return df.withColumnsRenamed(dict(part.column_mapping))
    if part.align_by_position:
        theirs = [c for c in df.columns if c not in identity]
        ours = [c for c in parent_columns if c not in identity]
        if len(theirs) != len(ours):
            raise ReshapeError(f"append by position: {len(theirs)} columns for {len(ours)}")
        return df.select(*[quoted(c) for c in df.columns if c in identity], *[quoted(a).alias(b) for a, b in zip(theirs, ours, strict=True)])
    return df


def merged(entity: Entity, sources: Mapping[str, DataFrame], entities: Mapping[str, Entity]) -> DataFrame:
    """Rows of all branches, with `<entity>_branch` and one sparse id column for each branch's source."""
    names = {b.name: (entities[b.source].public_id if b.source in entities and entities[b.source].public_id else f"{b.source}_id") for b in entity.branches}
    parts = []
    for b in entity.branches:
        df = sources[b.source]
        system = entities[b.source].system_id if b.source in entities else "system_id"
        wanted = [c for c in entity.columns or df.columns if c in df.columns and c not in (system, names[b.name])]
        ids = [(quoted(system) if n == b.name else F.lit(None)).cast("long").alias(names[n]) for n in names]
        parts.append(df.select(F.lit(b.name).alias(entity.branch_column), *[quoted(c) for c in wanted], *ids))
    return union(parts)
