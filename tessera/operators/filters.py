"""Row filters by stage; new kinds can be registered."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicate import PredicateError, compile_predicate
from .shared import quoted

STAGES = ("extract", "after_link", "after_unnest")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool
    help: str


@dataclass(frozen=True)
class FilterKind:
    apply: Callable[[DataFrame, Mapping, Mapping[str, DataFrame]], DataFrame]
    fields: tuple[Field, ...]
    help: str


KINDS: dict[str, FilterKind] = {}


def register(name: str, fields: Sequence[Field], help: str):
    def add(f):
        if name in KINDS:
            raise FilterError(f"filter {name} is already registered")
        KINDS[name] = FilterKind(f, tuple(fields), help)
        return f

    return add


@register("query", [Field("query", "string", True, "predicate over the entity's columns")], "Keeps rows for which a predicate holds")
def _query(df: DataFrame, spec: Mapping, store: Mapping[str, DataFrame]) -> DataFrame:
    text = (spec.get("query") or "").strip()
    if not text:
        return df
    try:
        return df.where(compile_predicate(text, df.columns))
    except PredicateError as e:
        raise FilterError(f"query filter {text!r}: {e}") from e


@register(
    "exists_in",
    [
        Field("column", "column", True, "column of this entity"),
        Field("other_entity", "entity", True, "entity whose values count"),
        Field("other_column", "column", False, "its column; the same name if left out"),
        Field("drop_duplicates", "columns", False, "columns made distinct afterwards"),
    ],
    "Keeps rows whose value is found in another entity; null is found where null is",
)
def _exists_in(df: DataFrame, spec: Mapping, store: Mapping[str, DataFrame]) -> DataFrame:
    from .subset import drop_duplicates

    column, other, theirs = spec.get("column"), spec.get("other_entity"), spec.get("other_column") or spec.get("column")
    if not column or not other:
        raise FilterError("exists_in needs column and other_entity")
    if column not in df.columns:
        raise FilterError(f"exists_in: no column {column}")
    if other not in store:
        raise FilterError(f"exists_in: no entity {other}")
    if theirs not in store[other].columns:
        raise FilterError(f"exists_in: {other} has no column {theirs}")
    values = store[other].select(quoted(theirs).alias("__value")).distinct()
    out = df.join(values, quoted(column).eqNullSafe(F.col("__value")), "left_semi")
    return drop_duplicates(out, spec.get("drop_duplicates"))


def apply_filters(df: DataFrame, filters: Sequence[Mapping], store: Mapping[str, DataFrame], stage: str = "extract") -> DataFrame:
    """The filters of one stage, in order; a filter without a stage belongs to `extract`."""
    for spec in filters or ():
        if spec.get("stage", "extract") not in STAGES:
            raise FilterError(f"unknown stage {spec.get('stage')}")
        if spec.get("stage", "extract") == stage:
            if spec.get("type") not in KINDS:
                raise FilterError(f"unknown filter {spec.get('type')}")
            df = KINDS[spec["type"]].apply(df, spec, store)
    return df
