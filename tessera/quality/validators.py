"""Checks of built tables against their configuration. Issues carry a code; counts come from aggregates."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config.project import Entity, ForeignKey, Project
from ..operators.extra_columns import sources_of
from ..operators.reshape import after_unnest
from ..operators.shared import fresh, quoted


@dataclass(frozen=True)
class Issue:
    code: str
    entity: str
    message: str
    severity: str = "error"
    column: str | None = None
    suggestion: str | None = None


def missing_columns(entity: Entity, df: DataFrame) -> list[Issue]:
    there = set(df.columns)
    consumed = set(entity.unnest.value_vars) if entity.unnest and entity.unnest.value_name in there else set()
    wanted = after_unnest([*entity.keys, *entity.columns], entity.unnest) if consumed else [*entity.keys, *entity.columns]
    return [Issue("COLUMN_NOT_FOUND", entity.name, f"column {c} does not exist in the data", column=c, suggestion="remove the column") for c in wanted if c not in there | consumed]


def orphans(local: DataFrame, local_keys: list[str], remote: DataFrame, remote_keys: list[str]) -> DataFrame:
    """Distinct local key values, none of them null, that the remote side lacks."""
    present = F.lit(True)
    for k in local_keys:
        present = present & quoted(k).isNotNull()
    ours = local.where(present).select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(local_keys)]).distinct()
    theirs = remote.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(remote_keys)])
    return ours.join(theirs, [f"k{i}" for i in range(len(local_keys))], "left_anti").select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(local_keys)])


@dataclass(frozen=True)
class Probe:
    """A question to the data: a frame of a few rows (n, sample), and what its rows say."""

    rows: DataFrame
    issues: Callable[[list[tuple[int | None, tuple | None]]], list[Issue]]


def _asked(df: DataFrame, n, sample=None) -> DataFrame:
    return df.select(n.cast("long").alias("n"), (F.lit(None) if sample is None else sample).cast("string").alias("sample"))


def _shown(columns: list[str]) -> F.Column:
    return F.to_json(F.struct(*[quoted(c).alias(f"k{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})


def answers(probes: list[Probe]) -> list[list[tuple[int | None, tuple | None]]]:
    """The rows of all probes, read by one job."""
    out: list[list] = [[] for _ in probes]
    whole = None
    for i, probe in enumerate(probes):
        part = probe.rows.withColumn("at", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    for row in whole.collect() if whole is not None else ():  # a few rows for each probe
        out[row["at"]].append((row["n"], None if row["sample"] is None else tuple(json.loads(row["sample"]).values())))
    return out


def _is_there(df: DataFrame, none: Issue) -> Probe:
    return Probe(_asked(df.limit(1), F.lit(1)), lambda rows: [] if rows else [none])


def non_unique_keys(entity: Entity, df: DataFrame, samples: int = 5) -> list[Probe]:
    keys = [k for k in entity.keys if k in df.columns]
    if not keys or len(keys) < len(entity.keys):
        return []
    count = fresh("count", keys)
    repeated = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)
    found = repeated.orderBy(F.desc(count), *[quoted(k) for k in keys]).limit(samples)

    def issues(rows):
        rows = sorted(rows, key=lambda r: (-r[0], str(r[1])))
        return [Issue("NON_UNIQUE_KEYS", entity.name, f"keys {', '.join(keys)} repeat, e.g. {[r[1] for r in rows]}", suggestion="drop duplicates")] if rows else []

    return [Probe(_asked(found, F.col(count), _shown(keys)), issues)]


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def foreign_key_issues(entity: Entity, fk: ForeignKey, df: DataFrame, remote: DataFrame) -> tuple[list[Issue], list[Probe]]:
    """What the columns say at once, else what to ask the data."""
    out = [Issue("FK_LOCAL_COLUMN_MISSING", entity.name, f"foreign key to {fk.entity}: no column {c}", column=c) for c in fk.local_keys if c not in df.columns]
    if out or any(c not in remote.columns for c in fk.remote_keys):
        return out, []
    for a, b in zip(fk.local_keys, fk.remote_keys, strict=True):
        if _numeric(df.schema[a].dataType) != _numeric(remote.schema[b].dataType):
            out.append(Issue("FK_TYPE_MISMATCH", entity.name, f"{a} is {df.schema[a].dataType.simpleString()}, {fk.entity}.{b} is {remote.schema[b].dataType.simpleString()}", "warning", a))
    if out:
        return out, []
    keys = list(fk.local_keys)
    lost = orphans(df, keys, remote, list(fk.remote_keys))
    some = _asked(lost.orderBy(*[quoted(k) for k in keys]).limit(5), F.lit(None), _shown(keys))
    there = _asked(remote.limit(1), F.lit(-1))
    count = _asked(lost.agg(F.count(F.lit(1)).alias("c")), F.col("c"))

    def issues(rows):
        if not any(n == -1 for n, _ in rows):
            return [Issue("FK_REMOTE_EMPTY", entity.name, f"{fk.entity} has no rows", "warning")]
        n = sum(n for n, _ in rows if n is not None and n > 0)
        shown = sorted((s for _, s in rows if s is not None), key=str)
        return [Issue("FK_DATA_INTEGRITY", entity.name, f"{n} keys are not in {fk.entity}, e.g. {shown}")] if n else []

    return [], [Probe(count.unionByName(some).unionByName(there), issues)]


def unresolved_columns(entity: Entity, df: DataFrame) -> list[Issue]:
    out = []
    for name, value in entity.extra_columns.items():
        if name not in df.columns:
            lacking = sorted(sources_of(value, df.columns) - set(df.columns))
            out.append(Issue("EXTRA_COLUMN_UNRESOLVED", entity.name, f"{name} needs {', '.join(lacking) or 'its inputs'}", column=name))
    return out


def validate(project: Project, tables: Mapping[str, DataFrame], strategy: str = "full", preview: int = 1000) -> list[Issue]:
    """All checks of all tables, with one job for each table. strategy preview looks at the first `preview` rows only (a feature of
    the report, not of the data)."""
    found = []
    for name, whole in tables.items():
        entity = project.entities.get(name)
        if entity is None:
            continue
        df = whole.limit(preview) if strategy == "preview" else whole
        try:
            own, due = [], [_is_there(df, Issue("EMPTY_RESULT", name, "no rows", "warning")), *non_unique_keys(entity, df)]
            for fk in entity.foreign_keys:
                if fk.entity in tables and fk.how != "cross":
                    at_once, later = foreign_key_issues(entity, fk, df, tables[fk.entity])
                    own, due = own + at_once, due + later
            said = [probe.issues(rows) for probe, rows in zip(due, answers(due), strict=True)]
            found += missing_columns(entity, df) + unresolved_columns(entity, df)
            found += said[0] or [*own, *[issue for issues in said[1:] for issue in issues]]  # an empty table has no further faults
        except Exception as e:  # noqa: BLE001  one table's failure is reported, the others are still checked
            found.append(Issue("VALIDATION_FAILED", name, str(e).splitlines()[0]))
    return found


@dataclass(frozen=True)
class Suggestion:
    """How an issue may be mended. change: from an entity's configuration to the mended one; none where a person must decide."""

    issue: Issue
    text: str
    change: Callable[[dict], dict] | None = None

    @property
    def automatic(self) -> bool:
        return self.change is not None


#: code of an issue (or its beginning) -> (entity, issue) -> suggestion; new ones can be added
FIXES: dict[str, Callable[[Entity, Issue], Suggestion]] = {}


def fix(*codes: str):
    def add(f):
        FIXES.update(dict.fromkeys(codes, f))
        return f

    return add


@fix("COLUMN_NOT_FOUND")
def remove_column(entity: Entity, i: Issue) -> Suggestion:
    left = {"columns": [c for c in entity.columns if c != i.column], "keys": [c for c in entity.keys if c != i.column]}
    return Suggestion(i, f"remove {i.column} from {entity.name}", lambda raw: {**raw, **left})


@fix("FK_LOCAL_COLUMN_MISSING")
def add_column(entity: Entity, i: Issue) -> Suggestion:
    return Suggestion(i, f"add {i.column} to the columns of {entity.name}", lambda raw: {**raw, "columns": list(dict.fromkeys([*(raw.get("columns") or []), i.column]))})


@fix("NON_UNIQUE_KEYS")
def make_distinct(entity: Entity, i: Issue) -> Suggestion:
    return Suggestion(i, f"keep the first row of each key of {entity.name}", lambda raw: {**raw, "drop_duplicates": list(entity.keys)})


@fix("SYSTEM_ID_")
def number_values(entity: Entity, i: Issue) -> Suggestion:
    if entity.type != "fixed" or entity.system_id not in entity.columns:
        return Suggestion(i, f"mend the ids of {entity.name} where they come from")
    at = list(entity.columns).index(entity.system_id)
    rows = [[*r[:at], n, *r[at + 1 :]] for n, r in enumerate(entity.values, 1)]
    return Suggestion(i, f"number the values of {entity.name}", lambda raw: {**raw, "values": rows})


@fix("EXTRA_COLUMN_UNRESOLVED", "VALUE_REFERENCE", "FK_TYPE_MISMATCH", "FK_DATA_INTEGRITY")
def by_hand(entity: Entity, i: Issue) -> Suggestion:
    return Suggestion(i, f"look at {i.column or entity.name}: what it refers to must be named, typed or given otherwise")


def suggest_fixes(project: Project, issues: list[Issue]) -> list[Suggestion]:
    """A suggestion for each issue that a strategy knows."""
    out = []
    for i in issues:
        strategy = next((f for code, f in FIXES.items() if i.code == code or code.endswith("_") and i.code.startswith(code)), None)
        if strategy and i.entity in project.entities:
            out.append(strategy(project.entities[i.entity], i))
    return out


def apply_fixes(project: Project, issues: list[Issue]) -> Project:
    """The project with all automatic suggestions followed, one after the other."""
    for i in issues:
        for s in suggest_fixes(project, [i]):
            if s.change:
                project = project.with_entity(i.entity, s.change(dict(project.entities[i.entity].raw)))
    return project


def preview_fixes(project: Project, issues: list[Issue]) -> list[dict]:
    """What each suggestion would change: entity, text, automatic, and the fields before and after."""
    out = []
    for s in suggest_fixes(project, issues):
        raw = dict(project.entities[s.issue.entity].raw)
        new = s.change(raw) if s.change else raw
        changed = {k: {"before": raw.get(k), "after": v} for k, v in new.items() if raw.get(k) != v}
        out.append({"code": s.issue.code, "entity": s.issue.entity, "text": s.text, "automatic": s.automatic, "changes": changed})
    return out
