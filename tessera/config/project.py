"""Projects as data: entities, their sources and steps, read from plain dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace


class ProjectError(ValueError):
    pass


def _list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, list | tuple | set) else [value]


@dataclass(frozen=True)
class Constraints:
    cardinality: str | None = None
    allow_unmatched_left: bool | None = None
    allow_unmatched_right: bool | None = None
    allow_row_decrease: bool | None = None
    require_unique_left: bool = False
    require_unique_right: bool = False
    allow_null_keys: bool | None = None

    CARDINALITIES = ("one_to_one", "many_to_one", "one_to_many", "many_to_many")

    @classmethod
    def of(cls, spec: Mapping | None) -> Constraints | None:
        if not spec:
            return None
        unknown = set(spec) - set(cls.__dataclass_fields__)
        if unknown:
            raise ProjectError(f"unknown constraints {sorted(unknown)}")
        if spec.get("cardinality") not in (None, *cls.CARDINALITIES):
            raise ProjectError(f"unknown cardinality {spec['cardinality']}")
        return cls(**spec)


@dataclass(frozen=True)
class ForeignKey:
    entity: str
    local_keys: tuple[str, ...] = ()
    remote_keys: tuple[str, ...] = ()
    how: str = "inner"
    #: local name -> remote column
    extra_columns: Mapping[str, str] = field(default_factory=dict)
    constraints: Constraints | None = None
    defer_dependency: bool = False
    drop_remote_id: bool = False

    HOW = ("inner", "left", "right", "outer", "cross")

    @classmethod
    def of(cls, spec: Mapping) -> ForeignKey:
        if not spec.get("entity"):
            raise ProjectError("a foreign key needs an entity")
        local, remote = tuple(_list(spec.get("local_keys"))), tuple(_list(spec.get("remote_keys")))
        how = spec.get("how", "inner")
        if how not in cls.HOW:
            raise ProjectError(f"foreign key to {spec['entity']}: unknown join {how}")
        if how != "cross" and (not local or len(local) != len(remote or local)):
            raise ProjectError(f"foreign key to {spec['entity']}: local_keys and remote_keys must go together")
        extra = spec.get("extra_columns") or {}
        if not isinstance(extra, Mapping):
            extra = {c: c for c in _list(extra)}
        return cls(spec["entity"], local, remote or local, how, dict(extra), Constraints.of(spec.get("constraints")), bool(spec.get("defer_dependency")), bool(spec.get("drop_remote_id")))


@dataclass(frozen=True)
class Unnest:
    id_vars: tuple[str, ...]
    value_vars: tuple[str, ...]
    var_name: str
    value_name: str

    @classmethod
    def of(cls, spec: Mapping | None) -> Unnest | None:
        if not spec:
            return None
        if not spec.get("var_name") or not spec.get("value_name"):
            raise ProjectError("unnest needs var_name and value_name")
        return cls(tuple(_list(spec.get("id_vars"))), tuple(_list(spec.get("value_vars"))), spec["var_name"], spec["value_name"])


@dataclass(frozen=True)
class Branch:
    name: str
    source: str
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class DataSource:
    name: str
    driver: str
    options: Mapping = field(default_factory=dict)


#: what an appended part takes from its parent unless it says otherwise
_NOT_INHERITED = {"append", "append_mode", "type", "source", "data_source", "query", "values", "foreign_keys", "unnest", "branches", "depends_on", "filters"}


@dataclass(frozen=True)
class Entity:
    name: str
    type: str = "entity"
    source: str | None = None
    data_source: str | None = None
    query: str | None = None
    values: object = None
    options: Mapping = field(default_factory=dict)
    system_id: str = "system_id"
    public_id: str | None = None
    keys: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    extra_columns: Mapping = field(default_factory=dict)
    replacements: Mapping = field(default_factory=dict)
    filters: tuple[Mapping, ...] = ()
    drop_duplicates: object = False
    check_fd: bool = False
    strict_fd: bool = True
    drop_empty_rows: object = False
    foreign_keys: tuple[ForeignKey, ...] = ()
    unnest: Unnest | None = None
    append: tuple[Mapping, ...] = ()
    append_mode: str = "all"
    branches: tuple[Branch, ...] = ()
    depends_on: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    align_by_position: bool = False
    column_mapping: Mapping = field(default_factory=dict)
    auto_detect_columns: bool = True
    raw: Mapping = field(default_factory=dict, compare=False, repr=False)

    TYPES = ("entity", "sql", "fixed", "csv", "tsv", "xlsx", "openpyxl", "parquet", "merged")

    @classmethod
    def of(cls, name: str, spec: Mapping) -> Entity:
        duplicates = spec.get("drop_duplicates", False)
        fd, strict = False, True
        if isinstance(duplicates, Mapping):
            fd = bool(duplicates.get("check_functional_dependency", False))
            strict = bool(duplicates.get("strict_functional_dependency", True))
            duplicates = duplicates.get("columns", True)
        if isinstance(duplicates, str):
            duplicates = [duplicates]
        known = {f for f in cls.__dataclass_fields__ if f not in ("name", "raw")}
        plain = {k: v for k, v in spec.items() if k in known and v is not None}
        for k in ("keys", "columns", "depends_on", "order_by"):
            plain[k] = tuple(dict.fromkeys(_list(spec.get(k))))
        if any(not isinstance(c, str) for c in plain["columns"]):
            raise ProjectError(f"{name}: columns must be names")
        return cls(
            **plain
            | {
                "name": name,
                "drop_duplicates": duplicates,
                "check_fd": fd,
                "strict_fd": strict,
                "filters": tuple(spec.get("filters") or ()),
                "foreign_keys": tuple(ForeignKey.of(f) for f in spec.get("foreign_keys") or ()),
                "unnest": Unnest.of(spec.get("unnest")),
                "append": tuple(spec.get("append") or ()),
                "branches": tuple(Branch(b.get("name") or b["source"], b["source"], tuple(_list(b.get("keys")))) for b in spec.get("branches") or ()),
                "raw": dict(spec),
            }
        )

    def appended(self) -> list[Entity]:
        """The parts appended to this entity, each with what it inherits."""
        out = []
        for k, part in enumerate(self.append):
            inherited = {key: v for key, v in self.raw.items() if key not in _NOT_INHERITED}
            kind = part.get("type") or ("entity" if part.get("source") else "sql" if part.get("query") else "fixed")
            out.append(Entity.of(f"{self.name}__append_{k}", {**inherited, **part, "type": kind}))
        return out

    @property
    def branch_column(self) -> str:
        return f"{self.name}_branch"


@dataclass(frozen=True)
class Project:
    name: str
    entities: Mapping[str, Entity]
    data_sources: Mapping[str, DataSource] = field(default_factory=dict)
    options: Mapping = field(default_factory=dict)
    metadata: Mapping = field(default_factory=dict)

    @classmethod
    def of(cls, spec: Mapping) -> Project:
        options = spec.get("options") or {}
        sources = {n: DataSource(n, s.get("driver", n), {k: v for k, v in {**s, **(s.get("options") or {})}.items() if k not in ("driver", "options")}) for n, s in (options.get("data_sources") or {}).items()}
        metadata = spec.get("metadata") or {}
        entities = {n: Entity.of(n, e) for n, e in (spec.get("entities") or {}).items()}
        return cls(metadata.get("name", "project"), entities, sources, options, metadata)

    def with_entity(self, name: str, spec: Mapping) -> Project:
        return replace(self, entities={**self.entities, name: Entity.of(name, spec)})

    def dependencies(self, name: str, deferred: bool = False) -> set[str]:
        """Entities that must come first; deferred: also those only needed for links that may wait."""
        e = self.entities[name]
        out = set(e.depends_on) | {b.source for b in e.branches} | {f.entity for f in e.foreign_keys if deferred or not f.defer_dependency}
        out |= {f["other_entity"] for f in e.filters if f.get("other_entity")}
        for part in (e, *e.appended()):
            if part.type == "entity" and part.source:
                out.add(part.source)
        return {d for d in out if d in self.entities and d != name}


def order_of(project: Project, targets: Sequence[str] | None = None) -> list[str]:
    """Entities needed for the targets, dependencies first, by name among equals; raises on cycles of needed ones."""
    wanted = closure(project, targets) if targets else set(project.entities)
    left = {n: project.dependencies(n) & wanted for n in wanted}
    out: list[str] = []
    while left:
        ready = sorted(n for n, d in left.items() if not d)
        if not ready:
            raise ProjectError(f"entities depend on each other: {', '.join(' -> '.join(c) for c in cycles(project))}; mark a foreign key defer_dependency")
        out += ready
        left = {n: d - set(ready) for n, d in left.items() if n not in ready}
    return out


def closure(project: Project, targets: Sequence[str]) -> set[str]:
    unknown = [t for t in targets if t not in project.entities]
    if unknown:
        raise ProjectError(f"unknown entities {unknown}")
    out, todo = set(), list(targets)
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo += project.dependencies(n, deferred=True)
    return out


def cycles(project: Project) -> list[list[str]]:
    """One cycle for each group of entities that need each other."""
    found, state = [], {}

    def visit(n: str, path: list[str]) -> None:
        state[n] = 1
        for d in sorted(project.dependencies(n)):
            if state.get(d) == 1:
                found.append([*path[path.index(d) :], d] if d in path else [n, d, n])
            elif d not in state:
                visit(d, [*path, d])
        state[n] = 2

    for n in sorted(project.entities):
        if n not in state:
            visit(n, [n])
    return found


def depths(project: Project) -> dict[str, int]:
    out: dict[str, int] = {}
    for n in order_of(project):
        out[n] = 1 + max((out[d] for d in project.dependencies(n)), default=-1)
    return out
