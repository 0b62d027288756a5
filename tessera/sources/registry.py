"""Where an entity's rows come from: a registry of readers by driver or type."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config.directives import managed_path
from ..config.project import Entity, Project


class SourceError(ValueError):
    pass


@dataclass(frozen=True)
class Option:
    """A field of a driver's form."""

    name: str
    kind: str = "string"
    required: bool = False
    default: object = None
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Driver:
    read: Callable[[SparkSession, Entity, dict], DataFrame]
    options: tuple[Option, ...]
    category: str
    help: str


DRIVERS: dict[str, Driver] = {}


def register(*names: str, options: tuple[Option, ...] = (), category: str = "file", help: str = ""):
    def add(f):
        for n in names:
            if n in DRIVERS:
                raise SourceError(f"driver {n} is already registered")
            DRIVERS[n] = Driver(f, options, category, help)
        return f

    return add


def checked_options(name: str, given: Mapping) -> dict:
    """Options under their own names, defaults filled in; missing required ones raise."""
    driver, out = DRIVERS[name], dict(given)
    for o in driver.options:
        for a in o.aliases:
            if a in out and o.name not in out:
                out[o.name] = out.pop(a)
        if o.name not in out and o.default is not None:
            out[o.name] = o.default
        if o.required and not out.get(o.name):
            raise SourceError(f"{name} needs {o.name}")
    return out


def source_options(project: Project, entity: Entity, folder: str = ".") -> tuple[str, dict]:
    """The name of an entity's reader, and its options with file names resolved."""
    if entity.data_source:
        source = project.data_sources.get(entity.data_source)
        if source is None:
            raise SourceError(f"{entity.name}: no data source {entity.data_source}")
        name, options = source.driver, {**source.options, **entity.options}
    else:
        name, options = entity.type, dict(entity.options)
    if name in DRIVERS and options.get("filename"):
        options["filename"] = managed_path(options["filename"], options.pop("location", None), folder, project.options.get("data_folder", folder))
    return name, options


def read_source(spark: SparkSession, project: Project, entity: Entity, tables: Mapping[str, DataFrame], folder: str = ".") -> DataFrame:
    """Data source driver, else the type's reader, else a table built before (or the default entity)."""
    from . import files, relational, values  # noqa: F401  they register themselves

    name, options = source_options(project, entity, folder)
    if name in DRIVERS:
        return DRIVERS[name].read(spark, entity, checked_options(name, options))
    for table in (entity.source, project.options.get("default_entity")):
        if table and table in tables:
            return tables[table]
    raise SourceError(f"{entity.name}: no source {entity.source or entity.data_source or entity.type}")


def test_connection(spark: SparkSession, name: str, options: Mapping, entity: Entity | None = None, rows: int = 10) -> dict:
    """Reads a few rows: success, message, columns, sample."""
    from . import files, relational, values  # noqa: F401

    try:
        df = DRIVERS[name].read(spark, entity or Entity.of("test", {"type": name}), checked_options(name, options))
        return {"success": True, "message": "ok", "columns": df.columns, "sample": [r.asDict() for r in df.limit(rows).collect()]}
    except Exception as e:  # noqa: BLE001  whatever the driver raises is the message
        return {"success": False, "message": str(e).splitlines()[0], "columns": [], "sample": []}
