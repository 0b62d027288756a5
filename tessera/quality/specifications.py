"""Checks of a project's configuration, before any data is read."""

from __future__ import annotations

from collections.abc import Callable

from ..config.project import Entity, ForeignKey, Project, ProjectError, cycles
from ..functions import formula
from ..functions.predicate import PredicateError, compile_predicate
from ..operators.extra_columns import mode_of, sources_of
from ..operators.filters import KINDS, STAGES
from .validators import Issue

#: (project, entity) -> messages; new checks can be added
CHECKS: dict[str, Callable[[Project, Entity], list[str]]] = {}


def register(f: Callable[[Project, Entity], list[str]]):
    CHECKS[f.__name__] = f
    return f


def is_empty(value) -> bool:
    return value is None or value == "" or value == [] or value == {}


def is_string_list(value) -> bool:
    return isinstance(value, list | tuple) and all(isinstance(x, str) for x in value)


def ends_with_id(value) -> bool:
    return isinstance(value, str) and value.endswith("_id")


def identity(e: Entity) -> list[str]:
    return [e.system_id, *([e.public_id] if e.public_id else [])]


def available(project: Project, e: Entity, stage: str = "extract", links: int | None = None) -> set[str]:
    """Columns an entity has at a stage, as far as the configuration tells; empty if it cannot tell."""
    if e.type == "merged":
        out = {e.branch_column, *e.columns}
        for b in e.branches:
            source = project.entities.get(b.source)
            out |= {source.public_id if source and source.public_id else f"{b.source}_id"}
    else:
        out = {*e.keys, *e.columns}
        if not out:
            return set()
    out |= {*identity(e), *e.extra_columns}
    for fk in e.foreign_keys:
        out |= set(fk.local_keys) if stage == "extract" and fk.local_keys else set()
    if stage in ("after_link", "after_unnest"):
        for fk in e.foreign_keys[:links]:
            remote = project.entities.get(fk.entity)
            out |= {*fk.extra_columns, (remote.public_id if remote and remote.public_id else f"{fk.entity}_id")}
    if e.unnest and stage == "after_unnest":
        out = (out - set(e.unnest.value_vars)) | {e.unnest.var_name, e.unnest.value_name}
    return out


@register
def base_fields(project: Project, e: Entity) -> list[str]:
    out = [] if e.type in Entity.TYPES else [f"unknown type {e.type}"]
    if not is_string_list(e.keys) or not is_string_list(e.columns):
        out.append("keys and columns must be names")
    return out


@register
def by_type(project: Project, e: Entity) -> list[str]:
    match e.type:
        case "entity":
            return ["an entity of type entity has no data_source or query"] if e.data_source or e.query else []
        case "sql":
            return [f"sql needs {k}" for k, v in (("data_source", e.data_source), ("query", e.query)) if not v]
        case "fixed":
            return _fixed(e)
        case "merged":
            return _merged(project, e)
    return []


def _fixed(e: Entity) -> list[str]:
    if e.data_source or e.query or e.source:
        return ["fixed has no source, data_source or query"]
    if not isinstance(e.values, list):
        return ["fixed needs a list of values"]
    rows = [r if isinstance(r, list | tuple | dict) else [r] for r in e.values]
    if len({isinstance(r, dict) for r in rows}) > 1:
        return ["values mix lists and mappings"]
    widths = {len(r) for r in rows if not isinstance(r, dict)}
    return [f"rows of values are {sorted(widths)} wide"] if len(widths) > 1 else []


def _merged(project: Project, e: Entity) -> list[str]:
    out = [] if e.branches else ["merged needs branches"]
    names = [b.name for b in e.branches]
    out += [f"branch {n} is named twice" for n in sorted({n for n in names if names.count(n) > 1})]
    out += [f"branch {b.name}: no entity {b.source}" for b in e.branches if b.source not in project.entities]
    if e.source or e.query or e.data_source:
        out.append("merged has no source, data_source or query")
    return out if e.public_id else [*out, "merged needs a public_id"]


@register
def system_id_values(project: Project, e: Entity) -> list[str]:
    if e.type != "fixed":
        return ["only fixed values may list system_id"] if e.system_id in e.columns else []
    if e.system_id not in e.columns or not isinstance(e.values, list):
        return []
    at = list(e.columns).index(e.system_id)
    ids = [(r.get(e.system_id) if isinstance(r, dict) else r[at] if len(r) == len(e.columns) else None) for r in e.values if isinstance(r, list | tuple | dict)]
    out = []
    if any(i is None for i in ids):
        out.append("SYSTEM_ID_NULL: some rows have no system_id")
    known = [i for i in ids if i is not None]
    if any(not isinstance(i, int) or isinstance(i, bool) for i in known):
        out.append("SYSTEM_ID_NOT_INTEGER: some system_ids are no integers")
    elif any(i < 1 for i in known):
        out.append("SYSTEM_ID_NOT_POSITIVE: some system_ids are below 1")
    if len(set(map(str, known))) < len(known):
        out.append("SYSTEM_ID_NOT_UNIQUE: some system_ids repeat")
    return out


@register
def public_id(project: Project, e: Entity) -> list[str]:
    if not e.public_id:
        return []
    out = [] if ends_with_id(e.public_id) else [f"public_id {e.public_id} does not end with _id"]
    source = project.entities.get(e.source or "")
    if source and source.public_id == e.public_id:
        out.append(f"public_id {e.public_id} is that of its source {e.source}")
    return out


@register
def unnest_fields(project: Project, e: Entity) -> list[str]:
    there = available(project, e)
    if not e.unnest or not there:
        return []
    return [f"unnest: no column {c}" for c in (*e.unnest.id_vars, *e.unnest.value_vars) if c not in there]


@register
def duplicates(project: Project, e: Entity) -> list[str]:
    d = e.drop_duplicates
    if isinstance(d, bool) or is_string_list(d):
        return []
    return ["drop_duplicates must be true, false or columns"]


@register
def foreign_keys(project: Project, e: Entity) -> list[str]:
    out = []
    for n, fk in enumerate(e.foreign_keys):
        remote = project.entities.get(fk.entity)
        if remote is None:
            out.append(f"foreign key to unknown entity {fk.entity}")
            continue
        there = available(project, e, "after_unnest" if e.unnest else "after_link", n) | available(project, e)
        if there:
            out += [f"foreign key to {fk.entity}: no column {c}" for c in fk.local_keys if c not in there]
        theirs = available(project, remote, "after_unnest" if remote.unnest else "after_link")
        if theirs:
            out += [f"foreign key to {fk.entity}: it has no column {c}" for c in (*fk.remote_keys, *fk.extra_columns.values()) if c not in theirs]
    return out


@register
def extra_columns(project: Project, e: Entity) -> list[str]:
    out = [f"extra column {n} is also a column" for n in e.extra_columns if n in e.columns]
    out += [f"extra column {n} also comes with a foreign key" for n in e.extra_columns for fk in e.foreign_keys if n in fk.extra_columns]
    there = available(project, e, "after_unnest" if e.unnest else "after_link")
    for name, value in e.extra_columns.items():
        mode = mode_of(value, sorted(there), e.extra_columns)
        if mode == "formula":
            problems = formula.validate(value)
            out += [f"extra column {name}: {p}" for p in problems]
            if problems:
                continue
        if there and e.type in ("fixed", "merged") and mode in ("formula", "interpolation"):
            low = {c.lower() for c in there}
            out += [f"extra column {name}: no column {c}" for c in sorted(sources_of(value, sorted(there))) if c.lower() not in low]
    return out


@register
def append(project: Project, e: Entity) -> list[str]:
    out = [] if e.append_mode in ("all", "distinct") else [f"unknown append_mode {e.append_mode}"]
    for k, part in enumerate(e.append):
        if sum(x in part for x in ("source", "values", "query")) != 1:
            out.append(f"append {k}: exactly one of source, values and query")
        if part.get("source") and part["source"] not in project.entities:
            out.append(f"append {k}: no entity {part['source']}")
        if part.get("query") and not (part.get("data_source") or e.data_source):
            out.append(f"append {k}: query needs data_source")
        if part.get("align_by_position") and part.get("column_mapping"):
            out.append(f"append {k}: either by position or by mapping")
        if part.get("align_by_position") and part.get("columns") and len(part["columns"]) != len(e.columns):
            out.append(f"append {k}: {len(part['columns'])} columns for {len(e.columns)}")
    return out


@register
def references(project: Project, e: Entity) -> list[str]:
    out = [f"depends on unknown entity {d}" for d in e.depends_on if d not in project.entities]
    if e.type == "entity" and e.source and e.source not in project.entities:
        out.append(f"unknown source {e.source}")
    if e.data_source and e.data_source not in project.data_sources:
        out.append(f"unknown data source {e.data_source}")
    return out


@register
def filters(project: Project, e: Entity) -> list[str]:
    out = []
    for f in e.filters:
        kind, stage = f.get("type"), f.get("stage", "extract")
        if kind not in KINDS:
            out.append(f"unknown filter {kind}")
            continue
        if stage not in STAGES:
            out.append(f"filter {kind}: unknown stage {stage}")
            continue
        if stage == "after_unnest" and not e.unnest:
            out.append(f"filter {kind}: there is no unnest")
        out += [f"filter {kind} needs {x.name}" for x in KINDS[kind].fields if x.required and not f.get(x.name)]
        there = available(project, e, stage)
        if kind == "query" and f.get("query") and there:
            try:
                compile_predicate(f["query"], sorted(there))
            except PredicateError as x:
                out.append(f"filter query: {x}")
            except Exception:  # noqa: BLE001  literals need a session; names were fine
                pass
        if kind == "exists_in" and f.get("other_entity") and f["other_entity"] not in project.entities:
            out.append(f"filter exists_in: no entity {f['other_entity']}")
    return out


@register
def sql_columns(project: Project, e: Entity) -> list[str]:
    """What a query's named columns must fulfil, as far as that shows without running it."""
    if e.type not in ("sql", "sqlite", "postgres", "postgresql", "access", "ucanaccess", "jdbc"):
        return []
    columns = e.raw.get("columns") or []
    out = ["columns repeat a name"] if isinstance(columns, list) and len(columns) != len(set(columns)) else []
    if e.raw.get("auto_detect_columns", True) is False:
        lacking = [k for k in e.keys if k not in e.columns]
        out += ["no columns are named, and none are detected"] if not e.columns else []
        out += [f"keys {', '.join(lacking)} are not among the named columns"] if lacking else []
    return out


def frozen_state(e: Entity) -> dict | None:
    """The configuration that a materialized entity had before, under its own key or among its `materialized` fields."""
    return e.raw.get("source_state") or (e.raw.get("materialized") or {}).get("source_state")


@register
def materialized(project: Project, e: Entity) -> list[str]:
    said = e.raw.get("materialized") or {}
    if not said.get("enabled"):
        return ["a materialized entity is of type fixed or parquet"] if frozen_state(e) and e.type not in ("fixed", "parquet", "csv") else []
    out = [] if e.type == "fixed" else [f"a materialized entity is of type fixed, not {e.type}"]
    out += [] if e.raw.get("values") else ["a materialized entity has its values, or a file of them"]
    out += [] if frozen_state(e) else ["a materialized entity keeps its former configuration in materialized.source_state"]
    return out + ([] if said.get("materialized_at") else ["MATERIALIZED_AT_MISSING: a materialized entity should tell when it was frozen"])


def can_materialize(project: Project, name: str) -> list[str]:
    """Why an entity cannot be frozen, as messages."""
    e = project.entities.get(name)
    if e is None:
        return [f"no entity {name}"]
    out = ["it is materialized already"] if frozen_state(e) else []
    return [*out, "fixed values need no materializing"] if e.type == "fixed" and not out else out


def link_problem(fk: ForeignKey, local: list[str], remote: list[str] | None, pending: set[str]) -> str | None:
    """Why a link cannot be made now: None (it can), "deferred" (later) or a message."""
    if remote is None or set(fk.local_keys) & pending:
        return "deferred"
    missing = [c for c in fk.local_keys if c not in local] + [f"{fk.entity}.{c}" for c in (*fk.remote_keys, *fk.extra_columns.values()) if c not in remote]
    return f"no column {', '.join(missing)}" if missing else None


def check_project(project: Project, kind: str | None = None) -> list[Issue]:
    out = []
    if kind and project.metadata.get("type") != kind:
        out.append(Issue("METADATA_TYPE", "", f"metadata.type is {project.metadata.get('type')}, not {kind}"))
    if not project.entities:
        out.append(Issue("NO_ENTITIES", "", "the project has no entities"))
    for c in cycles(project):
        out.append(Issue("CYCLE", c[0], " -> ".join(c)))
    for name, e in project.entities.items():
        for code, check in CHECKS.items():
            try:
                for m in check(project, e):
                    own = m.split(":")[0] if m.startswith(("SYSTEM_ID_", "MATERIALIZED_AT_")) else code.upper()
                    out.append(Issue(own, name, m, "warning" if own == "MATERIALIZED_AT_MISSING" else "error"))
            except ProjectError as x:
                out.append(Issue(code.upper(), name, str(x)))
    return out
