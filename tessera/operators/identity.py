"""Surrogate ids: dense, in row order, stable once assigned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fixed, fresh, quoted


def numbered(df: DataFrame, name: str, order: list[str], start: int | F.Column = 1) -> DataFrame:
    """Dense numbers in the given order without a single-task sort: places within sorted ranges plus the ranges before.

    Rows are written once, sorted within their ranges, each with its range and place: a lost executor cannot renumber them, and their
    numbers are a sum that needs no further shuffle. Rows that the order leaves equal keep the places they were written at.
    """
    by = [quoted(c).asc_nulls_last() for c in order]
    place, part, before = (fresh(x, [*df.columns, name]) for x in ("__place", "__range", "__before"))
    ranged = fixed((df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df).withColumn(place, F.monotonically_increasing_id()))
    ranged = ranged.withColumn(part, F.shiftright(place, 33))  # fixed value: the upper bits are the partition, the lower ones the row's place in it
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = sizes.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    out = ranged.join(F.broadcast(sizes), part)  # as many rows as there were partitions
    return out.withColumn(name, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before) + start).drop(part, before, place)


def add_system_id(df: DataFrame, order: list[str] | None = None, name: str = "system_id") -> DataFrame:
    """Puts `name` first: 1..n in order; where the column is there, only its nulls get numbers, from the largest on."""
    rest = [c for c in df.columns if c != name]
    order = [c for c in order or [] if c != name]
    if name not in df.columns:
        return numbered(df, name, order).select(name, *[quoted(c) for c in rest])
    df = df.withColumn(name, quoted(name).cast("long"))
    top = df.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).first()["m"]
    missing = numbered(df.where(quoted(name).isNull()).drop(name), name, order or rest, F.lit(top + 1))
    return df.where(quoted(name).isNotNull()).select(name, *[quoted(c) for c in rest]).unionByName(missing.select(name, *[quoted(c) for c in rest]))


def add_public_id(df: DataFrame, name: str | None) -> DataFrame:
    return df if not name or name in df.columns else df.withColumn(name, F.lit(None).cast("long"))


def canonical_order(columns: list[str], system_id: str, public_id: str | None, fk_ids: list[str], extra: list[str]) -> list[str]:
    """system_id, public_id, foreign ids, extra columns, then the rest; each part sorted."""
    head = [c for c in (system_id, public_id) if c in columns]
    fks = sorted(c for c in set(fk_ids) if c in columns and c not in head)
    extras = sorted(c for c in set(extra) if c in columns and c not in head + fks)
    return [*head, *fks, *extras, *sorted(c for c in columns if c not in {*head, *fks, *extras})]
