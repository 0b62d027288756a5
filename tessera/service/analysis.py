"""Interactive services: preview, ad-hoc SQL, suggestions, materialising, lineage."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config.project import Entity, Project, ProjectError, cycles, depths, order_of
from ..operators.link import Remote, join_stats
from ..operators.shared import quoted, scratch
from ..plans.pipeline import Result, normalize
from ..quality.specifications import can_materialize, frozen_state
from ..sources.relational import TableInfo
from .snapshots import Snapshots, addresses

# ad-hoc SQL


class QueryError(ValueError):
    pass


# fixed values: verbs that a read-only query may not start a statement with
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "MERGE", "GRANT", "REVOKE", "CALL", "EXECUTE", "REPLACE", "SET", "USE", "CACHE", "REFRESH", "LOAD", "MSCK", "ANALYZE")


def _plan(spark: SparkSession, text: str):
    """Spark's own parser; the one place that reaches behind the public interface."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise QueryError(f"cannot read query: {str(e).splitlines()[0]}") from None


def check_query(spark: SparkSession, text: str) -> dict:
    """is_valid, errors, warnings, tables. One SELECT (or WITH, VALUES, TABLE) only."""
    errors, warnings = [], []
    stripped = re.sub(r"(--[^\n]*|/\*.*?\*/)", " ", text, flags=re.S).strip().rstrip(";").strip()
    tables: list[str] = []
    if not stripped:
        errors.append("the query is empty")
    else:
        verb = re.match(r"\(*\s*(\w+)", stripped)
        if verb and verb[1].upper() in FORBIDDEN:
            errors.append(f"{verb[1].upper()} is not allowed")
        else:
            try:
                plan = _plan(spark, stripped)
                if "Command" in plan.getClass().getName() or re.match(r"^'?(Create|Drop|Insert|Delete|Update|Merge|Set|Cache|Truncate|Alter|Describe|Show)", plan.nodeName()):
                    errors.append(f"{plan.nodeName()} is not a query")
                tables = table_names(plan.toString())
            except QueryError as e:
                errors.append(str(e))
        if re.search(r"select\s+\*", stripped, re.I):
            warnings.append("SELECT * reads every column")
        if not re.search(r"\blimit\b", stripped, re.I):
            warnings.append("no LIMIT; the service's own applies")
    return {"is_valid": not errors, "errors": errors, "warnings": warnings, "tables": tables}


def table_names(plan: str) -> list[str]:
    """Tables that a parsed plan reads, common table expressions left out."""
    ctes = set(re.findall(r"^\W*(?:CTE \[)(.*)\]", plan, re.M))
    names = {x.strip() for c in ctes for x in c.split(",")}
    found = [m.replace(", ", ".") for m in re.findall(r"'UnresolvedRelation \[([^\]]+)\]", plan)]
    return sorted(set(found) - names)


def lineage(spark: SparkSession, text: str) -> list[str]:
    return table_names(_plan(spark, text.strip().rstrip(";")).toString())


def run_query(spark: SparkSession, text: str, limit: int = 100, timeout: float = 30) -> dict:
    """Rows (JSON-safe), columns, whether more rows follow, seconds. The job is cancelled at the timeout (300 s at most)."""
    checked = check_query(spark, text)
    if not checked["is_valid"]:
        raise QueryError("; ".join(checked["errors"]))
    began, tag = time.time(), f"query-{hashlib.md5(text.encode()).hexdigest()[:12]}-{time.time_ns()}"  # noqa: S324
    df = spark.sql(text.strip().rstrip(";"))

    def work():
        spark.sparkContext.addJobTag(tag)
        return df.limit(limit + 1).collect()  # a page of rows

    with ThreadPoolExecutor(1) as pool:
        try:
            rows = pool.submit(work).result(min(timeout, 300))
        except Late:
            spark.sparkContext.cancelJobsWithTag(tag)
            raise QueryError(f"the query took longer than {min(timeout, 300)} s") from None
    return {"columns": df.columns, "rows": [{k: _json_safe(v) for k, v in r.asDict().items()} for r in rows[:limit]], "truncated": len(rows) > limit, "seconds": time.time() - began}


def _json_safe(v):
    if v is None or isinstance(v, bool | int | str):
        return v
    if isinstance(v, float):
        return v if v == v and abs(v) != float("inf") else None
    if isinstance(v, list | tuple):
        return [_json_safe(x) for x in v]
    return {k: _json_safe(x) for k, x in v.items()} if isinstance(v, dict) else str(v)


def query_columns(spark: SparkSession, text: str) -> list[dict]:
    """Names and types without running anything."""
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in spark.sql(text.strip().rstrip(";")).schema.fields]


def table_page(df: DataFrame, limit: int = 100, offset: int = 0, order: Sequence[str] = ()) -> DataFrame:
    """At most 100 rows."""
    df = df.orderBy(*[quoted(c) for c in order]) if order else df
    return (df.offset(offset) if offset else df).limit(min(limit, 100))


# preview


@dataclass
class Previews:
    """Previews over snapshots of built tables. What did not change, upstream or since an earlier preview, is read and not built again."""

    spark: SparkSession
    seconds: float = 300
    most: int = 64
    folder: str | None = None
    project_folder: str = "."
    built: list[str] = field(default_factory=list)  # entities built so far, in order

    def __post_init__(self) -> None:
        self.kept = Snapshots(self.spark, self.folder, self.seconds, self.most)

    def tables(self, project: Project, names: Sequence[str], given: Mapping[str, DataFrame] | None = None, versions: Mapping[str, object] | None = None) -> dict[str, DataFrame]:
        """The named tables; one run builds those that have no snapshot, from the snapshots of those that have."""
        at = addresses(self.spark, project, list(names), given, versions, self.project_folder)
        known = {n: df for n, address in at.items() if n not in (given or {}) and (df := self.kept.get(address)) is not None}
        missing = [n for n in names if n not in known and n not in (given or {})]
        if missing:
            with scratch():  # what the run wrote on the way is in the snapshots then
                result = normalize(self.spark, project, missing, {**known, **(given or {})}, constraints="warn", folder=self.project_folder)
                for n, df in result.tables.items():
                    if n in at and n not in known and n not in (given or {}):
                        self.built.append(n)
                        known[n] = self.kept.put(at[n], df)
        self.kept.sweep({at[n] for n in names})
        return {n: (given or {})[n] if n in (given or {}) else known[n] for n in names}

    def table(self, project: Project, name: str, given: Mapping[str, DataFrame] | None = None, versions: Mapping[str, object] | None = None) -> DataFrame:
        return self.tables(project, [name], given, versions)[name]

    def preview(
        self, project: Project, name: str, limit: int | None = 50, override: Mapping | None = None, given: Mapping[str, DataFrame] | None = None, versions: Mapping[str, object] | None = None
    ) -> DataFrame:
        if override:
            project = project.with_entity(name, {**project.entities[name].raw, **override})
        return self._page(project, name, self.table(project, name, given, versions), limit)

    def batch(self, project: Project, names: Sequence[str], limit: int | None = 50, given: Mapping[str, DataFrame] | None = None, versions: Mapping[str, object] | None = None) -> dict[str, DataFrame]:
        """Several previews from one run."""
        return {n: self._page(project, n, df, limit) for n, df in self.tables(project, names, given, versions).items()}

    def _page(self, project: Project, name: str, df: DataFrame, limit: int | None) -> DataFrame:
        order = project.entities[name].system_id
        df = df.orderBy(quoted(order)) if order in df.columns else df
        return df if limit is None else df.limit(limit)

    def forget(self, project: Project, name: str, given: Mapping[str, DataFrame] | None = None, versions: Mapping[str, object] | None = None) -> None:
        self.kept.forget(addresses(self.spark, project, [name], given, versions, self.project_folder)[name])


def column_info(project: Project, name: str, df: DataFrame) -> list[dict]:
    e = project.entities[name]
    nulls = df.agg(*[F.max(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first() if df.columns else []
    return [
        {"name": c, "type": display_type(df.schema[c].dataType), "nullable": bool(nulls[i]), "is_key": c in e.keys or c == e.system_id, "is_derived": c in e.extra_columns}
        for i, c in enumerate(df.columns)
    ]


def display_type(kind: T.DataType) -> str:
    match kind:
        case T.BooleanType():
            return "boolean"
        case T.IntegralType():
            return "integer"
        case T.DoubleType() | T.FloatType() | T.DecimalType():
            return "decimal number"
        case T.DateType() | T.TimestampType() | T.TimestampNTZType():
            return "date/time"
        case T.DayTimeIntervalType() | T.YearMonthIntervalType():
            return "duration"
        case T.StringType():
            return "text"
    return "other"


def test_foreign_key(project: Project, result: Result, name: str, index: int, sample: int | None = None) -> dict:
    e = project.entities[name]
    if not 0 <= index < len(e.foreign_keys):
        raise ProjectError(f"{name} has {len(e.foreign_keys)} foreign keys")
    fk = e.foreign_keys[index]
    remote = project.entities.get(fk.entity)
    df = result.tables[name] if sample is None else result.tables[name].limit(sample)
    return join_stats(df, fk, Remote(fk.entity, result.tables[fk.entity], remote.system_id if remote else "system_id", remote.public_id if remote else None))


# suggestions

# fixed values: scores of a suggested link by how its columns match
EXACT, PATTERN, NAMED = 0.5, 0.4, 0.3
BOTH_INTEGER, COMPATIBLE, PRIMARY, THRESHOLD = 0.2, 0.15, 0.15, 0.5


def _family(kind: str) -> str:
    kind = kind.lower()
    if "int" in kind and "interval" not in kind or kind in ("long", "short", "serial"):
        return "integer"
    return "string" if any(t in kind for t in ("char", "text", "string")) else kind.split("(")[0].strip()


def suggest_foreign_keys(name: str, columns: Sequence[str], others: Mapping[str, Sequence[str]], schemas: Mapping[str, TableInfo] | None = None) -> list[dict]:
    """Links by column names, scored by how they match, by types, and by primary keys; best first."""
    schemas, out = schemas or {}, []
    mine = {c.name: c for c in schemas[name].columns} if name in schemas else {}
    for other, theirs in others.items():
        if other == name:
            continue
        known = {c.name: c for c in schemas[other].columns} if other in schemas else {}
        singular = other[:-1] if other.endswith("s") else other
        for c in columns:
            for remote, score, reason in (
                (c, EXACT, "same name"),
                ("id", PATTERN, "names the entity") if c in (f"{other}_id", f"{singular}_id") else (None, 0, ""),
                (c[: -len("_id")], NAMED, "names a column") if c.endswith("_id") and len(c) > 3 else (None, 0, ""),
            ):
                if remote is None or remote not in theirs:
                    continue
                if c in mine and remote in known:
                    a, b = _family(mine[c].type), _family(known[remote].type)
                    score += BOTH_INTEGER if a == b == "integer" else COMPATIBLE if a == b else 0
                if remote in known and known[remote].primary_key:
                    score += PRIMARY
                if round(score, 6) >= THRESHOLD:
                    out.append({"remote_entity": other, "local_keys": [c], "remote_keys": [remote], "confidence": round(min(score, 1.0), 6), "reason": reason, "cardinality": "many_to_one"})
    return sorted(out, key=lambda s: (-s["confidence"], s["remote_entity"], s["local_keys"]))


# fixed values: field type and confidence for SQL types
SQL_TYPES = {
    "smallint": ("integer", 1.0), "integer": ("integer", 1.0), "int": ("integer", 1.0), "bigint": ("integer", 1.0), "serial": ("integer", 1.0), "bigserial": ("integer", 1.0),
    "real": ("float", 1.0), "double": ("float", 1.0), "double precision": ("float", 1.0), "numeric": ("float", 0.9), "decimal": ("float", 0.9), "money": ("float", 0.8),
    "character varying": ("string", 1.0), "varchar": ("string", 1.0), "character": ("string", 1.0), "char": ("string", 1.0), "string": ("string", 1.0), "text": ("text", 1.0),
    "boolean": ("boolean", 1.0), "bool": ("boolean", 1.0), "date": ("date", 1.0), "timestamp": ("datetime", 1.0), "timestamp_ntz": ("datetime", 1.0),
    "time": ("string", 0.7), "interval": ("string", 0.6), "uuid": ("uuid", 1.0), "json": ("json", 1.0), "jsonb": ("json", 1.0), "bytea": ("string", 0.5), "binary": ("string", 0.5),
    "array": ("json", 0.7), "xml": ("text", 0.8), "inet": ("string", 0.9), "cidr": ("string", 0.9), "macaddr": ("string", 0.9),
}


def suggest_type(sql_type: str) -> tuple[str, float]:
    """(field type, confidence) for an SQL type; sizes and zones do not matter."""
    kind = sql_type.lower().strip()
    if kind.endswith("[]") or kind.startswith("array"):
        kind = "array"
    kind = re.sub(r"\s*\([^)]*\)|\s+with(out)? time zone", "", kind).strip()
    return SQL_TYPES.get(kind, ("string", 0.3))


def dependency_graph(project: Project) -> dict:
    found = cycles(project)
    return {
        "nodes": sorted(project.entities),
        "edges": sorted((d, n) for n in project.entities for d in project.dependencies(n, deferred=True)),
        "cycles": found,
        "order": None if found else order_of(project),
        "depth": None if found else depths(project),
    }


def entity_from_table(table: TableInfo, data_source: str) -> dict:
    keys = list(table.primary_keys) or [c.name for c in table.columns if c.primary_key]
    hints = keys or [c.name for c in table.columns if c.name == "id" or c.name.endswith("_id")][:1]
    columns = [c.name for c in table.columns]
    return {
        "type": "sql", "data_source": data_source, "query": f"SELECT {', '.join(columns)} FROM {table.name}", "keys": hints, "columns": columns,
        "public_id": f"{table.name.removeprefix('tbl_')}_id",
        "foreign_keys": [{"entity": other, "local_keys": [c], "remote_keys": [r]} for c, other, r in table.foreign_keys],
    }


def available_columns(project: Project, name: str) -> dict[str, list[str]]:
    e = project.entities[name]
    linked = []
    for fk in e.foreign_keys:
        remote = project.entities.get(fk.entity)
        linked += [remote.public_id if remote and remote.public_id else f"{fk.entity}_id", *fk.extra_columns]
    return {
        "explicit": list(e.columns), "keys": list(e.keys), "extra": list(e.extra_columns), "unnested": [e.unnest.var_name, e.unnest.value_name] if e.unnest else [],
        "foreign_key": linked, "system": [e.system_id, *([e.public_id] if e.public_id else [])],
    }


# materialising


def materialize_entity(project: Project, name: str, df: DataFrame, path: str, form: str = "parquet") -> Project:
    """Freezes a table in files; the entity reads them from then on and keeps its former configuration."""
    problems = can_materialize(project, name)
    if problems:
        raise ProjectError(f"{name}: {'; '.join(problems)}")
    e = project.entities[name]
    keep = {k: e.raw[k] for k in ("keys", "public_id", "system_id", "foreign_keys") if k in e.raw}
    if form == "inline":
        rows = [list(r) for r in df.collect()]  # asked for: the values become part of the configuration
        return project.with_entity(name, {**keep, "type": "fixed", "columns": df.columns, "values": rows, "source_state": dict(e.raw)})
    writer = df.write.mode("overwrite")
    writer.parquet(path) if form == "parquet" else writer.option("header", True).csv(path)
    return project.with_entity(name, {**keep, "type": form, "columns": df.columns, "options": {"filename": path}, "source_state": dict(e.raw)})


def unmaterialize_entity(project: Project, name: str, cascade: bool = False) -> Project:
    """Back to the former configuration; cascade: also frozen entities that this one needs."""
    state = frozen_state(project.entities[name])
    if not state:
        raise ProjectError(f"{name} is not materialized")
    project = project.with_entity(name, state)
    if cascade:
        for d in sorted(project.dependencies(name, deferred=True)):
            if frozen_state(project.entities[d]):
                project = unmaterialize_entity(project, d, True)
    return project


def entity_of(project: Project, name: str) -> Entity:
    return project.entities[name]
