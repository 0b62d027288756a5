"""Submissions: tables keyed by a target schema, repaired by policies, checked, and put out as entity-attribute-value rows."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import union
from ..operators.shared import quoted
from ..quality.validators import Issue

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    data_type: str = "text"
    nullable: bool = True
    is_pk: bool = False
    is_fk: bool = False
    fk_table: str | None = None
    class_name: str = "java.lang.String"

    @property
    def camel_case(self) -> str:
        head, *rest = self.name.split("_")
        return head + "".join(w.capitalize() for w in rest)


@dataclass(frozen=True)
class TableSpec:
    name: str
    pk_name: str
    java_class: str
    columns: Mapping[str, ColumnSpec]
    is_lookup: bool = False
    excel_sheet: str | None = None


@dataclass(frozen=True)
class Schema:
    tables: Mapping[str, TableSpec]

    @classmethod
    def of(cls, tables: Sequence[Mapping], columns: Sequence[Mapping]) -> Schema:
        """From metadata rows (table_name, pk_name, java_class, ...) and (table_name, column_name, data_type, ...)."""
        by_table: dict[str, dict[str, ColumnSpec]] = {}
        for c in sorted(columns, key=lambda c: (c["table_name"], c.get("position", 0))):
            by_table.setdefault(c["table_name"], {})[c["column_name"]] = ColumnSpec(
                c["column_name"], c.get("data_type", "text"), bool(c.get("is_nullable", True)), bool(c.get("is_pk")), bool(c.get("is_fk")), c.get("fk_table_name"), c.get("class_name", "java.lang.String")
            )
        return cls({t["table_name"]: TableSpec(t["table_name"], t["pk_name"], t["java_class"], by_table.get(t["table_name"], {}), bool(t.get("is_lookup")), t.get("excel_sheet")) for t in tables})

    def references_to(self, table: str) -> list[tuple[str, str]]:
        """(table, column) of the columns that refer to a table."""
        return [(t.name, c.name) for t in self.tables.values() for c in t.columns.values() if c.is_fk and c.fk_table == table and t.name != table]


@dataclass
class Submission:
    schema: Schema
    tables: dict[str, DataFrame] = field(default_factory=dict)
    log: list[tuple[str, str]] = field(default_factory=list)

    def spec(self, name: str) -> TableSpec:
        if name not in self.schema.tables:
            raise ValueError(f"table {name} is not in the schema")
        return self.schema.tables[name]


def referenced_keys(submission: Submission, table: str) -> DataFrame | None:
    """Distinct keys (key: long) by which other tables of the submission refer to a table."""
    parts = []
    for name, column in submission.schema.references_to(table):
        df = submission.tables.get(name)
        if df is not None and column in df.columns:
            parts.append(df.select(quoted(column).cast("long").alias("key")).where("key is not null"))
    return union(parts).distinct() if parts else None


# policies: each (submission, settings) -> None, changing tables; in order of priority

POLICIES: dict[str, Callable[[Submission, Mapping], None]] = {}


def policy(f: Callable[[Submission, Mapping], None]):
    POLICIES[f.__name__] = f
    return f


@policy
def add_primary_key_column_if_missing(s: Submission, settings: Mapping) -> None:
    for name, df in s.tables.items():
        pk = s.spec(name).pk_name
        if pk not in df.columns:
            s.tables[name] = df.withColumn(pk, F.lit(None).cast("long"))
            s.log.append((name, f"added column {pk}"))


@policy
def update_missing_foreign_key(s: Submission, settings: Mapping) -> None:
    for name, defaults in settings.items():
        if name in s.tables and isinstance(defaults, Mapping):
            df = s.tables[name]
            for column, value in defaults.items():
                df = df.withColumn(column, F.coalesce(quoted(column), F.lit(value)) if column in df.columns else F.lit(value))
            s.tables[name] = df


@policy
def add_identity_mapping_system_id_to_public_id(s: Submission, settings: Mapping) -> None:
    """A table that is referred to but missing becomes its referenced keys, which are then public ids."""
    chosen = settings.get("tables") or {}
    names = set(chosen.get("include") or s.schema.tables) - set(chosen.get("exclude") or ())
    for name in sorted(names - set(s.tables)):
        keys = referenced_keys(s, name)
        if keys is not None and not keys.isEmpty():
            s.tables[name] = keys.select(F.col("key").alias("system_id"), F.col("key").alias(s.spec(name).pk_name))
            s.log.append((name, "added as an identity mapping"))


@policy
def update_types_based_on_schema(s: Submission, settings: Mapping) -> None:
    kinds = {"smallint": "smallint", "integer": "int", "bigint": "bigint"}
    for name, df in s.tables.items():
        casts = {c.name: quoted(c.name).cast(kinds[c.data_type]) for c in s.spec(name).columns.values() if c.name in df.columns and c.data_type in kinds}
        s.tables[name] = df.withColumns(casts) if casts else df


@policy
def set_system_id_to_public_id_if_missing(s: Submission, settings: Mapping) -> None:
    for name, df in s.tables.items():
        pk = s.spec(name).pk_name
        if pk in df.columns:
            if "system_id" not in df.columns:
                raise ValueError(f"table {name} has no system_id")
            s.tables[name] = df.withColumn("system_id", F.coalesce(quoted("system_id").cast("long"), quoted(pk).cast("long")))


@policy
def add_identity_mapping_to_foreign_key_table_if_missing(s: Submission, settings: Mapping) -> None:
    for name, df in list(s.tables.items()):
        spec = s.spec(name)
        keys = referenced_keys(s, name) if spec.is_lookup else None
        if keys is not None:
            new = missing_lookup_rows(df, keys, spec.pk_name)
            s.tables[name] = union([df, new])


def missing_lookup_rows(df: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    """Rows (system_id, pk) for referenced keys that a table lacks."""
    lost = keys.join(df.select(quoted("system_id").cast("long").alias("key")), "key", "left_anti")
    return lost.select(F.col("key").alias("system_id"), F.col("key").alias(pk))


@policy
def drop_ignored_columns(s: Submission, settings: Mapping) -> None:
    for name, df in s.tables.items():
        s.tables[name] = df.drop(*[c for c in df.columns if any(fnmatch(c, p) for p in settings.get("columns") or ())])


@policy
def if_lookup_with_no_new_data_then_keep_only_system_id_public_id(s: Submission, settings: Mapping) -> None:
    for name, df in s.tables.items():
        spec = s.spec(name)
        if spec.is_lookup and spec.pk_name in df.columns and df.where(quoted(spec.pk_name).isNull()).isEmpty():
            s.tables[name] = df.select("system_id", quoted(spec.pk_name))


def apply_policies(s: Submission, settings: Mapping[str, Mapping] | None = None) -> Submission:
    """All policies in order of their priority setting (then as listed); disabled ones are left out."""
    settings = settings or {}
    order = sorted(POLICIES, key=lambda n: (settings.get(n, {}) or {}).get("priority", 0))
    for name in order:
        own = settings.get(name) or {}
        if own.get("disabled"):
            s.log.append((name, "disabled"))
        else:
            POLICIES[name](s, own)
    return s


# specifications

_NUMBERS = ("smallint", "integer", "bigint", "numeric", "real", "double precision")


def check_submission(s: Submission) -> list[Issue]:
    """What keeps a submission from being ingested; one aggregate for each table."""
    out: list[Issue] = []
    for name, df in s.tables.items():
        if name not in s.schema.tables:
            out.append(Issue("TABLE_UNKNOWN", name, "table is not in the schema"))
            continue
        spec = s.spec(name)
        if spec.pk_name not in df.columns:
            out.append(Issue("NO_PRIMARY_KEY", name, f"no column {spec.pk_name}"))
        for c in spec.columns.values():
            if c.name not in df.columns:
                if not c.nullable and not c.is_pk and not c.name.endswith("_uuid") and c.name != "date_updated":
                    out.append(Issue("MISSING_COLUMN", name, f"no column {c.name}", column=c.name))
            elif (c.data_type in _NUMBERS) != isinstance(df.schema[c.name].dataType, T.NumericType) and not isinstance(df.schema[c.name].dataType, T.NullType) and c.data_type in _NUMBERS:
                out.append(Issue("COLUMN_TYPE", name, f"{c.name} is {df.schema[c.name].dataType.simpleString()}, not {c.data_type}", column=c.name))
            if c.is_fk and c.fk_table and c.fk_table not in s.tables and c.name in df.columns and not df.where(quoted(c.name).isNotNull()).isEmpty():
                out.append(Issue("FK_TABLE_MISSING", name, f"{c.name} refers to {c.fk_table}, which is missing", column=c.name))
        if "system_id" not in df.columns:
            out.append(Issue("NO_SYSTEM_ID", name, "no column system_id"))
            continue
        new = quoted(spec.pk_name).isNull() if spec.pk_name in df.columns else F.lit(True)
        required = [c.name for c in spec.columns.values() if not c.nullable and not c.is_pk and c.name in df.columns]
        counts = df.agg(
            F.sum(quoted("system_id").isNull().cast("long")).alias("nulls"),
            (F.count("system_id") - F.count_distinct("system_id")).alias("repeats"),
            *[F.sum((new & quoted(c).isNull()).cast("long")).alias(f"lack{i}") for i, c in enumerate(required)],
        ).first()
        if counts["nulls"]:
            out.append(Issue("SYSTEM_ID_NULL", name, f"{counts['nulls']} rows have no system_id"))
        if counts["repeats"]:
            out.append(Issue("SYSTEM_ID_NOT_UNIQUE", name, f"{counts['repeats']} rows repeat a system_id"))
        out += [Issue("NULL_VALUES", name, f"{counts[f'lack{i}']} new rows lack {c}", column=c) for i, c in enumerate(required) if counts[f"lack{i}"]]
    return out


# entity-attribute-value rows

_INTEGERS = ("java.lang.Integer", "java.lang.Long", "java.lang.Short")


def formatted(column: Column, class_name: str) -> Column:
    """A value as the bulk format writes it: quoted text, whole numbers, '' for null."""
    text = column.cast("string")
    if class_name == "java.lang.String":
        out = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    elif class_name in _INTEGERS or class_name.startswith("com."):
        out = text.try_cast("double").cast("bigint").cast("string")
    else:
        out = text
    return F.when(column.isNull() | (text == "NULL"), "").otherwise(out)


@dataclass(frozen=True)
class Eav:
    tables: DataFrame
    columns: DataFrame
    records: DataFrame
    recordvalues: DataFrame


def export_eav(spark: SparkSession, s: Submission, ignore: Sequence[str] = ("date_updated",)) -> Eav:
    """Four tables. Rows with a public id are references only: a record, no values. Each new row has one value row for each
    column and one for clonedId; foreign ids are resolved to (system id, public id). Keys that others refer to but
    a table lacks become records too."""
    tables, columns, records, values = [], [], [], []
    none = F.lit("NULL")
    for name, raw in sorted(s.tables.items()):
        spec = s.spec(name)
        df = raw if spec.pk_name in raw.columns else raw.withColumn(spec.pk_name, F.lit(None).cast("long"))
        public = quoted(spec.pk_name).cast("long")
        df = df.withColumns({"__public": public, "__system": F.coalesce(quoted("system_id").cast("long") if "system_id" in df.columns else F.lit(None).cast("long"), public)})
        df = df.where("__system is not null")
        tables.append(df.agg(F.count(F.lit(1)).cast("string").alias("record_count")).select(F.lit(spec.java_class).alias("table_type"), "record_count").where("record_count != '0'"))
        head = [F.lit(spec.java_class).alias("class_name"), F.col("__system").cast("string").alias("system_id"), F.coalesce(F.col("__public").cast("string"), none).alias("public_id")]
        records.append(df.select(*head))
        keys = referenced_keys(s, name)
        if keys is not None:
            lost = keys.join(df.select(F.col("__system").alias("key")), "key", "left_anti")
            records.append(lost.select(F.lit(spec.java_class).alias("class_name"), F.col("key").cast("string").alias("system_id"), F.col("key").cast("string").alias("public_id")))
        new = df.where("__public is null")
        shown = [c for c in spec.columns.values() if c.name in df.columns and c.name not in ignore]
        items = []
        for c in shown:
            if c.is_fk and c.fk_table in s.tables and s.spec(c.fk_table).pk_name in s.tables[c.fk_table].columns:
                theirs = s.tables[c.fk_table].select(quoted("system_id").cast("long").alias(f"__k_{c.name}"), quoted(s.spec(c.fk_table).pk_name).cast("long").alias(f"__p_{c.name}")).dropDuplicates([f"__k_{c.name}"])
                new = new.join(theirs, quoted(c.name).cast("long") == F.col(f"__k_{c.name}"), "left")
                fk = [F.coalesce(quoted(c.name).cast("bigint").cast("string"), none), F.coalesce(F.col(f"__p_{c.name}").cast("string"), none), none]
            elif c.is_fk:
                fk = [F.coalesce(quoted(c.name).cast("bigint").cast("string"), none), F.coalesce(quoted(c.name).cast("bigint").cast("string"), none), none]
            else:
                fk = [none, none, formatted(quoted(c.name), c.class_name)]
            items.append(F.struct(F.lit(c.camel_case).alias("column_name"), F.lit(c.class_name).alias("column_type"), fk[0].alias("fk_system_id"), fk[1].alias("fk_public_id"), fk[2].alias("column_value")))
        items.append(F.struct(F.lit("clonedId").alias("column_name"), F.lit("java.util.Integer").alias("column_type"), none.alias("fk_system_id"), none.alias("fk_public_id"), none.alias("column_value")))
        values.append(new.select(*head, F.inline(F.array(*items))))
        named = [(spec.java_class, c.camel_case, c.class_name) for c in shown] + [(spec.java_class, "clonedId", "java.util.Integer")]
        if "date_updated" in spec.columns:
            named.append((spec.java_class, "dateUpdated", "java.util.Date"))
        columns.append(new.limit(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("table_type"), F.lit(b).alias("column_name"), F.lit(c).alias("column_type")) for a, b, c in named]))))
    return Eav(*(union(x) for x in (tables, columns, records, values)))


def write_eav(eav: Eav, folder: str) -> None:
    """Four TSV folders."""
    for name in ("tables", "columns", "records", "recordvalues"):
        getattr(eav, name).write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{folder}/{name}")


def submission_from_workbook(spark: SparkSession, schema: Schema, path: str) -> Submission:
    """All sheets that the schema knows, by sheet or table name."""
    from ..sources.files import Workbook, sheet_frame

    book = Workbook(path)
    out = Submission(schema)
    for t in schema.tables.values():
        sheet = next((x for x in (t.excel_sheet, t.name) if x in book.sheets), None)
        if sheet:
            names, rows = sheet_frame(spark, path, sheet)
            out.tables[t.name] = rows.toDF(*map(str, names))
    return out


def ingest(spark: SparkSession, s: Submission, settings: Mapping[str, Mapping] | None = None, folder: str | None = None, strict: bool = True) -> tuple[Submission, list[Issue], Eav | None]:
    """Policies, checks, export; nothing is put out where checks fail, unless strict is off."""
    s = apply_policies(replace(s, tables=dict(s.tables)), settings)
    issues = check_submission(s)
    if issues and strict:
        return s, issues, None
    eav = export_eav(spark, s)
    if folder:
        write_eav(eav, folder)
    return s, issues, eav
