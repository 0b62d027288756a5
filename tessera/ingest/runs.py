"""A submission as one run that can be stopped anywhere and goes on: load, policies, checks, register, export.

Each step leaves its tables, or what it found, in the run's folder and then an entry in the journal; an entry is written under another name
and moved, so that a step is done or not. A start looks for the last entries that hold: an entry names a hash of what its step was
made from, so that changed settings repeat the step and those after it, and nothing before. The folder may be in any store that Spark writes to.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import removed
from ..quality.validators import Issue
from ..sources.relational import TableInfo
from .submission import Eav, Schema, Submission, apply_policies, check_submission, export_eav, submission_from_workbook, write_eav

STEPS = ("load", "policies", "checks", "register", "export")

# fixed values: classes of columns by the beginning of their type's name
_CLASSES = {
    "small": "java.lang.Integer", "int": "java.lang.Integer", "serial": "java.lang.Integer", "big": "java.lang.Long", "long": "java.lang.Long", "num": "java.math.BigDecimal", "dec": "java.math.BigDecimal",
    "double": "java.lang.Double", "float": "java.lang.Double", "real": "java.lang.Double", "bool": "java.lang.Boolean", "timestamp": "java.sql.Timestamp", "date": "java.util.Date",
}
_KINDS = {"int2": "smallint", "smallint": "smallint", "int4": "integer", "int": "integer", "integer": "integer", "serial": "integer", "int8": "bigint", "bigint": "bigint"}


def class_of(table: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in table.split("_"))


def schema_from_database(tables: Mapping[str, TableInfo], lookups: Callable[[str], bool] = lambda name: False, sheets: Mapping[str, str] | None = None) -> Schema:
    """A target schema from what a database says of its tables (`sqlite_tables`, `jdbc_tables`). Tables without a single key are left out."""
    known = {n: t for n, t in tables.items() if len(t.primary_keys) == 1}
    columns = []
    for name, table in known.items():
        refers = {column: other for column, other, _ in table.foreign_keys}
        for at, c in enumerate(table.columns):
            other, kind = refers.get(c.name), c.type.lower()
            own = next((java for start, java in _CLASSES.items() if kind.startswith(start)), "java.lang.String")
            columns.append(
                {
                    "table_name": name, "column_name": c.name, "data_type": _KINDS.get(kind, kind), "is_nullable": c.nullable, "is_pk": c.name in table.primary_keys,
                    "is_fk": other in known, "fk_table_name": other if other in known else None, "class_name": class_of(other) if other in known else own, "position": at,
                }
            )
    found = [{"table_name": n, "pk_name": t.primary_keys[0], "java_class": class_of(n), "is_lookup": lookups(n), "excel_sheet": (sheets or {}).get(n)} for n, t in known.items()]
    return Schema.of(found, columns)


@dataclass
class Outcome:
    """What a run came to: issues that stopped it, the id it was registered by, where its export is, and which steps ran this time."""

    issues: list[Issue] = field(default_factory=list)
    submission_id: int | None = None
    eav: Eav | None = None
    ran: list[str] = field(default_factory=list)


@dataclass
class Run:
    """folder: the run's own. register: (run's name) -> id; it may be asked again with the same name if the run stops right after it."""

    spark: SparkSession
    schema: Schema
    folder: str
    settings: Mapping[str, Mapping] | None = None
    strict: bool = True
    register: Callable[[str], int] | None = None
    name: str = "submission"

    def _system(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def entry(self, step: str) -> dict | None:
        system, where = self._system(f"{self.folder}/journal/{step}.json")
        return json.loads(self.spark.read.text(where.toString(), wholetext=True).first()[0]) if system.exists(where) else None

    def _note(self, step: str, made_from: str, found: dict) -> None:
        draft, goal = f"{self.folder}/journal/{uuid.uuid4().hex}", f"{self.folder}/journal/{step}.json"
        system, where = self._system(draft)
        out = system.create(where)
        out.write(bytearray(json.dumps({"made_from": made_from, **found}).encode()))
        out.close()
        removed(self.spark, goal)
        system.rename(where, self._system(goal)[1])

    def _kept(self, step: str, tables: Mapping[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{step}/{name}")

    def _read(self, step: str, names: list[str]) -> Submission:
        return Submission(self.schema, {n: self.spark.read.parquet(f"{self.folder}/{step}/{n}") for n in names})

    def start(self, source: str | Submission | Callable[[], Submission]) -> Outcome:
        """Runs what is not done. source: a workbook, a submission, or what gives one."""
        out, before, again = Outcome(), "", False
        schema = hashlib.sha256(repr(self.schema).encode()).hexdigest()
        inputs = {"load": source if isinstance(source, str) else "", "policies": self.settings, "checks": self.strict, "register": self.name, "export": None}
        entries = {}
        for step in STEPS:
            made_from = hashlib.sha256(json.dumps([before, schema, inputs[step]], sort_keys=True, default=str).encode()).hexdigest()
            entry = None if again else self.entry(step)
            if entry is None or entry["made_from"] != made_from:
                again = True
                found = getattr(self, f"_{step}")(source, entries, out)
                out.ran.append(step)
                if out.issues and self.strict:
                    return out  # nothing is registered or put out; the next start checks again
                self._note(step, made_from, found)
                entry = {"made_from": made_from, **found}
            entries[step], before = entry, made_from
        out.submission_id = entries["register"]["id"]
        out.issues = [Issue(**i) for i in entries["checks"]["issues"]]
        read = lambda n: self.spark.read.option("header", True).option("sep", "\t").csv(f"{self.folder}/export/{n}")
        out.eav = Eav(**{n: read(n) for n in ("tables", "columns", "records", "recordvalues")})
        return out

    def _load(self, source, entries: dict, out: Outcome) -> dict:
        s = submission_from_workbook(self.spark, self.schema, source) if isinstance(source, str) else source() if callable(source) else source
        self._kept("load", s.tables)
        return {"tables": sorted(s.tables)}

    def _policies(self, source, entries: dict, out: Outcome) -> dict:
        s = apply_policies(self._read("load", entries["load"]["tables"]), self.settings)
        self._kept("policies", s.tables)
        return {"tables": sorted(s.tables), "log": [list(x) for x in s.log]}

    def _checks(self, source, entries: dict, out: Outcome) -> dict:
        out.issues = check_submission(self._read("policies", entries["policies"]["tables"]))
        return {"issues": [asdict(i) for i in out.issues]}

    def _register(self, source, entries: dict, out: Outcome) -> dict:
        return {"id": self.register(self.name) if self.register else None}

    def _export(self, source, entries: dict, out: Outcome) -> dict:
        write_eav(export_eav(self.spark, self._read("policies", entries["policies"]["tables"])), f"{self.folder}/export")
        return {}
