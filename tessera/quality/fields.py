"""Checks of single fields of an entity's raw configuration, by name; a field is a dotted path."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from .validators import Issue

_ABSENT = object()


@dataclass(frozen=True)
class Seen:
    """What a check sees: the field's value, if it is there, the entity's configuration, and all entities' names."""

    value: Any
    there: bool
    entity: Mapping
    entities: frozenset[str] = frozenset()
    options: Mapping = field(default_factory=dict)

    @property
    def reference(self) -> bool:
        """A value that is only looked up later."""
        return isinstance(self.value, str) and self.value.startswith("@value")


#: name -> (whether the field passes, what to say if it does not); more can be added
FIELD_CHECKS: dict[str, tuple[Callable[[Seen], bool], str]] = {}


def field_check(message: str):
    def add(f: Callable[[Seen], bool]):
        FIELD_CHECKS[f.__name__] = (f, message)
        return f

    return add


def look_up(config: Any, path: str) -> Any:
    for part in path.split("."):
        if not isinstance(config, Mapping) or part not in config:
            return _ABSENT
        config = config[part]
    return config


@field_check("must be empty")
def is_empty(s: Seen) -> bool:
    return s.value is None or (isinstance(s.value, str | list | dict) and not s.value)


@field_check("is missing")
def exists(s: Seen) -> bool:
    return s.there


@field_check("must be absent")
def is_absent(s: Seen) -> bool:
    return not s.there


@field_check("must be a list of strings")
def is_string_list(s: Seen) -> bool:
    return s.reference or isinstance(s.value, list) and all(isinstance(x, str) for x in s.value)


@field_check("must be a text that is not blank")
def not_empty_string(s: Seen) -> bool:
    return isinstance(s.value, str) and s.value.strip() != ""


@field_check("must not be empty")
def not_empty(s: Seen) -> bool:
    return bool(s.value)


@field_check("is of another type than it must be")
def of_type(s: Seen) -> bool:
    """Option `types`: type objects, or None for null."""
    return any(s.value is None if t is None else isinstance(s.value, t) for t in s.options.get("types", ()))


@field_check("must name an entity of the project")
def is_existing_entity(s: Seen) -> bool:
    return isinstance(s.value, str) and s.value in s.entities


@field_check("should end with _id")
def ends_with_id(s: Seen) -> bool:
    return isinstance(s.value, str) and s.value.endswith("_id")


@field_check("should be one of the values it may take")
def is_of_categorical_values(s: Seen) -> bool:
    """Option `values`. Only texts are judged."""
    return not isinstance(s.value, str) or s.value in s.options.get("values", ())


@field_check("is not among the columns")
def is_in_columns(s: Seen) -> bool:
    columns = s.entity.get("columns", [])
    return not isinstance(columns, list) or not isinstance(s.value, str) or s.value in columns


@field_check("does not have the expected value")
def has_value(s: Seen) -> bool:
    """Option `expected`."""
    return s.value == s.options.get("expected")


@field_check("has keys that are not among the columns")
def keys_subset_of_columns(s: Seen) -> bool:
    """Judged only where both are given as lists: without columns, keys come from the source."""
    keys, columns = s.entity.get("keys"), s.entity.get("columns")
    return not (isinstance(keys, list) and isinstance(columns, list) and columns) or set(keys) <= set(columns)


def check_fields(entities: Mapping[str, Mapping], rules: Iterable[Mapping]) -> list[Issue]:
    """Rules are {field, check, severity (error), options of the check}, each applied to every entity's raw configuration."""
    out, names = [], frozenset(entities)
    for rule in rules:
        test, message = FIELD_CHECKS[rule["check"]]
        for name, config in entities.items():
            found = look_up(config, rule["field"])
            there = found is not _ABSENT
            if not test(Seen(found if there else None, there, config, names, rule)):
                out.append(Issue(rule["check"].upper(), name, f"{rule['field']} {message}", rule.get("severity", "error"), rule["field"]))
    return out
