"""Conformance of a project to a target model: which entities, ids, columns and links are expected."""

from __future__ import annotations

import html
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..config.project import Project
from .validators import Issue


@dataclass(frozen=True)
class TargetKey:
    entity: str
    required: bool = False
    via: str | None = None


@dataclass(frozen=True)
class TargetEntity:
    name: str
    role: str | None = None
    required: bool = False
    description: str | None = None
    domains: tuple[str, ...] = ()
    target_table: str | None = None
    public_id: str | None = None
    identity_columns: tuple[str, ...] = ()
    columns: Mapping[str, Mapping] = field(default_factory=dict)
    unique_sets: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[TargetKey, ...] = ()


@dataclass(frozen=True)
class TargetModel:
    name: str
    version: str
    entities: Mapping[str, TargetEntity]
    public_id_suffix: str | None = None
    description: str | None = None

    @classmethod
    def of(cls, spec: Mapping) -> TargetModel:
        entities = {}
        for name, e in (spec.get("entities") or {}).items():
            e = e or {}
            if e.get("role") not in (None, "fact", "lookup", "classifier", "bridge"):
                raise ValueError(f"{name}: unknown role {e['role']}")
            entities[name] = TargetEntity(
                name, e.get("role"), bool(e.get("required")), e.get("description"), tuple(e.get("domains") or ()), e.get("target_table"), e.get("public_id"),
                tuple(e.get("identity_columns") or ()), {c: v or {} for c, v in (e.get("columns") or {}).items()},
                tuple(tuple(s) for s in e.get("unique_sets") or ()), tuple(TargetKey(f["entity"], bool(f.get("required")), f.get("via")) for f in e.get("foreign_keys") or ()),
            )
        model = spec["model"]
        return cls(model["name"], str(model["version"]), entities, (spec.get("naming") or {}).get("public_id_suffix"), model.get("description"))


def check_model(model: TargetModel) -> list[Issue]:
    """The model's own consistency."""
    out = []
    for n, e in model.entities.items():
        if model.public_id_suffix and e.public_id and not e.public_id.endswith(model.public_id_suffix):
            out.append(Issue("INVALID_PUBLIC_ID_SUFFIX", n, f"public_id {e.public_id} does not end with {model.public_id_suffix}"))
        out += [Issue("UNKNOWN_FOREIGN_KEY_ENTITY", n, f"unknown entity {f.entity}") for f in e.foreign_keys if f.entity not in model.entities]
        out += [Issue("UNKNOWN_IDENTITY_COLUMN", n, f"unknown identity column {c}") for c in e.identity_columns if c not in e.columns]
        out += [Issue("UNKNOWN_UNIQUE_SET_COLUMN", n, f"unknown column {c} in a unique set") for s in e.unique_sets for c in s if c not in e.columns]
    return out


def _target_columns(project: Project, name: str) -> set[str]:
    e = project.entities[name]
    out = {*e.keys, *e.columns, *e.extra_columns, *([e.public_id] if e.public_id else [])}
    for fk in e.foreign_keys:
        out |= set(fk.extra_columns)
        remote = project.entities.get(fk.entity)
        out.add(remote.public_id if remote and remote.public_id else f"{fk.entity}_id")
    if e.unnest:
        out = (out - set(e.unnest.value_vars)) | {e.unnest.var_name, e.unnest.value_name}
    return out


def conformance(model: TargetModel, project: Project) -> list[Issue]:
    out = []
    for n, t in model.entities.items():
        e = project.entities.get(n)
        if e is None:
            if t.required:
                out.append(Issue("MISSING_REQUIRED_ENTITY", n, f"required entity {n} is missing"))
            continue
        if t.public_id and not e.public_id:
            out.append(Issue("MISSING_PUBLIC_ID", n, f"public_id {t.public_id} is missing"))
        elif t.public_id and e.public_id != t.public_id:
            out.append(Issue("UNEXPECTED_PUBLIC_ID", n, f"public_id is {e.public_id}, expected {t.public_id}"))
        if model.public_id_suffix and e.public_id and not e.public_id.endswith(model.public_id_suffix):
            out.append(Issue("PUBLIC_ID_NAMING_VIOLATION", n, f"public_id {e.public_id} does not end with {model.public_id_suffix}"))
        there = _target_columns(project, n)
        out += [Issue("MISSING_REQUIRED_COLUMN", n, f"required column {c} is missing", column=c) for c, spec in t.columns.items() if spec.get("required") and c not in there]
        linked = {fk.entity for fk in e.foreign_keys} | {b.source for b in e.branches}
        for key in t.foreign_keys:
            if key.via and key.required:
                bridge = project.entities.get(key.via)
                if bridge is None:
                    out.append(Issue("MISSING_BRIDGE_ENTITY", n, f"bridge {key.via} to {key.entity} is missing"))
                elif key.entity not in {fk.entity for fk in bridge.foreign_keys} and key.entity not in linked:
                    out.append(Issue("BRIDGE_MISSING_TARGET_FK", key.via, f"bridge {key.via} has no foreign key to {key.entity}"))
            elif key.required and key.entity not in linked:
                out.append(Issue("MISSING_REQUIRED_FOREIGN_KEY_TARGET", n, f"foreign key to {key.entity} is missing"))
        if t.role == "classifier" and e.type not in ("fixed", "sql"):
            out.append(Issue("CLASSIFIER_WRONG_SOURCE_TYPE", n, f"a classifier is fixed or sql, not {e.type}", "warning"))
    return out + _induced(model, project)


def _induced(model: TargetModel, project: Project) -> list[Issue]:
    """Entities that are missing though a chain of required links from a present one needs them."""
    todo = [(n, n) for n, t in model.entities.items() if n in project.entities and not t.required]
    seen, out = {n for n, _ in todo}, []
    while todo:
        name, cause = todo.pop(0)
        for key in model.entities[name].foreign_keys if name in model.entities else ():
            if not key.required or key.entity in seen:
                continue
            seen.add(key.entity)
            target = model.entities.get(key.entity)
            if target is not None and target.required:
                continue
            if key.entity not in project.entities:
                out.append(Issue("MISSING_INDUCED_REQUIRED_ENTITY", key.entity, f"{key.entity} is needed because {cause} is there"))
            todo.append((key.entity, cause))
    return out


def compare_models(first: TargetModel, second: TargetModel, project: Project) -> dict[str, list[Issue]]:
    """Issues under the first model only, the second only, and both."""
    a, b = set(conformance(first, project)), set(conformance(second, project))
    by_name = lambda s: sorted(s, key=lambda i: (i.entity, i.code, i.message))
    return {"only_first": by_name(a - b), "only_second": by_name(b - a), "both": by_name(a & b)}


def scaffold(model: TargetModel, domains: list[str] | None = None, entities: list[str] | None = None) -> dict:
    """A project to start from: entities of the domains (or named), required ones, and what they must link to."""
    chosen = {n for n, t in model.entities.items() if t.required or (entities and n in entities) or (domains and set(domains) & set(t.domains)) or not (domains or entities)}
    todo = list(chosen)
    while todo:
        for key in model.entities[todo.pop()].foreign_keys:
            for n in filter(None, (key.entity, key.via)):
                if key.required and n in model.entities and n not in chosen:
                    chosen.add(n)
                    todo.append(n)
    out = {}
    for n in sorted(chosen):
        t = model.entities[n]
        e: dict = {"type": "fixed" if t.role == "classifier" else "entity", "public_id": t.public_id, "keys": list(t.identity_columns), "columns": list(t.columns)}
        if t.role == "classifier":
            e["values"] = []
        links = [{"entity": k.entity, "local_keys": [], "remote_keys": []} for k in t.foreign_keys if k.entity in chosen and not k.via]
        out[n] = e | ({"foreign_keys": links} if links else {})
    return {"metadata": {"name": f"{model.name}-project"}, "entities": out}


def documentation(model: TargetModel, form: str = "markdown") -> str:
    """The model as Markdown or HTML."""
    if form == "html":
        rows = []
        for n, t in sorted(model.entities.items()):
            cells = "".join(f"<tr><td>{html.escape(c)}</td><td>{html.escape(str(s.get('type') or ''))}</td><td>{'yes' if s.get('required') else ''}</td><td>{html.escape(s.get('description') or '')}</td></tr>" for c, s in t.columns.items())
            rows.append(f"<h2>{html.escape(n)}</h2><p>{html.escape(t.description or '')}</p><table><tr><th>column</th><th>type</th><th>required</th><th>description</th></tr>{cells}</table>")
        return f"<!DOCTYPE html><html><head><title>{html.escape(model.name)}</title></head><body><h1>{html.escape(model.name)} {html.escape(model.version)}</h1>{''.join(rows)}</body></html>"
    out = [f"# {model.name} {model.version}", model.description or ""]
    for n, t in sorted(model.entities.items()):
        out += ["", f"## {n}", "", t.description or "", "", f"Role: {t.role or '-'}; public id: {t.public_id or '-'}; required: {'yes' if t.required else 'no'}"]
        if t.columns:
            out += ["", "| column | type | required | description |", "| --- | --- | --- | --- |"]
            out += [f"| {c} | {s.get('type') or ''} | {'yes' if s.get('required') else ''} | {s.get('description') or ''} |" for c, s in t.columns.items()]
        if t.foreign_keys:
            out += ["", "Links: " + ", ".join(f"{k.entity}{' via ' + k.via if k.via else ''}{' (required)' if k.required else ''}" for k in t.foreign_keys)]
    return "\n".join(out) + "\n"


def documentation_tables(spark: SparkSession, model: TargetModel) -> dict[str, DataFrame]:
    """The model as tables `entities`, `columns` and `links`: written by any sink, as a workbook one sheet each."""
    entities, columns, links = [], [], []
    for n, t in sorted(model.entities.items()):
        entities.append((n, t.role, t.public_id, bool(t.required), ", ".join(t.domains), ", ".join(t.identity_columns), t.description))
        columns += [(n, c, s.get("type"), bool(s.get("required")), s.get("description")) for c, s in t.columns.items()]
        links += [(n, k.entity, k.via, bool(k.required)) for k in t.foreign_keys]
    return {
        "entities": spark.createDataFrame(entities, "entity string, role string, public_id string, required boolean, domains string, identity string, description string"),
        "columns": spark.createDataFrame(columns, "entity string, column string, type string, required boolean, description string"),
        "links": spark.createDataFrame(links, "entity string, other string, via string, required boolean"),
    }
