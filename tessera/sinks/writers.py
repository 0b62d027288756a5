"""Writers for a set of tables; new ones can be registered."""

from __future__ import annotations

import csv
import io
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable, Mapping
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import quoted
from .fragments import SingleFile, cell, insert_texts, local_path

Tables = Mapping[str, DataFrame]
SINKS: dict[str, Callable[[str, Tables], None]] = {}


def register(name: str):
    def add(f):
        SINKS[name] = f
        return f

    return add


def write(kind: str, target: str, tables: Tables) -> None:
    if kind not in SINKS:
        raise ValueError(f"no sink {kind}; there are {', '.join(sorted(SINKS))}")
    SINKS[kind](target, tables)


@register("parquet")
def to_parquet(target: str, tables: Tables) -> None:
    """A folder of files for each table, written by all tasks."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")


@register("csv")
def to_csv(target: str, tables: Tables) -> None:
    """A folder of part files with headers for each table, written by all tasks."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{target}/{name}")


def _ordered(df: DataFrame) -> DataFrame:
    return df.orderBy("system_id") if "system_id" in df.columns else df


def _header(df: DataFrame) -> str:
    out = io.StringIO(newline="")
    csv.writer(out).writerow(df.columns)
    return out.getvalue()


@register("single_csv")
def to_single_csv(target: str, tables: Tables) -> None:
    """One file for each table, for exports that people read; tasks write its parts."""
    for name, df in tables.items():
        with SingleFile(f"{local_path(target)}/{name}.csv") as f:
            f.joined([f.text(_header(df), False), *f.parts(_ordered(df), "csv", False)])


@register("zipcsv")
def to_zipped_csv(target: str, tables: Tables) -> None:
    """One zip file with a CSV for each table; tasks write and pack its parts."""
    with SingleFile(target) as f:
        f.zipped([(f"{name}.csv", [f.text(_header(df), True), *f.parts(_ordered(df), "csv", True)]) for name, df in sorted(tables.items())])


def sheet_name(name: str, taken: set[str]) -> str:
    """At most 31 characters, none that sheets forbid; raises where two tables would share a sheet."""
    out = re.sub(r"[\[\]:*?/\\]", "_", name)[:31]
    if out.lower() in taken:
        raise ValueError(f"two tables would be sheet {out}")
    taken.add(out.lower())
    return out


MAX_SHEET_ROWS = 1_048_576

# fixed values: cell styles of the styled sink (0 plain, 1 header, 2 id column, 3 foreign id)
_FILLS = ("FFD9D9D9", "FFFFF2CC", "FFDDEBF7")


def _style_of(column: str, position: int) -> int:
    if position == 0 or column == "system_id":
        return 2
    return 3 if column.endswith("_id") else 1


def to_workbook(target: str, tables: Tables, styled: bool = False) -> None:
    """One sheet for each table, by name, times without zones, calculation set to manual. Tasks write and pack the sheets' rows; a
    sheet holds 1,048,576 rows."""
    taken: set[str] = set()
    names = [(sheet_name(n, taken), tables[n]) for n in sorted(tables)]
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
    sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="s{i}"/>' for i, (n, _) in enumerate(names, 1))
    links = "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in _FILLS)
    styles = "".join(f'<xf fillId="{k}" applyFill="1"/>' for k in (2, 3, 4))
    frames = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets><calcPr calcMode="manual" fullCalcOnLoad="0"/></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{links}<Relationship Id="st" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/>{styles}</cellXfs></styleSheet>',
    }
    declared = '<?xml version="1.0" encoding="UTF-8"?>'
    with SingleFile(target) as f:
        members = [(name, [f.text(declared + text, True)]) for name, text in frames.items()]
        for i, (name, df) in enumerate(names, 1):
            head = "<row>" + "".join(cell(c, _style_of(c, k) if styled else 0) for k, c in enumerate(df.columns)) + "</row>"
            rows = f.parts(df, "sheet", True)
            if 1 + sum(p.rows for p in rows) > MAX_SHEET_ROWS:
                raise ValueError(f"{name} has more rows than a sheet holds")
            members.append((f"xl/worksheets/sheet{i}.xml", [f.text(f'{declared}<worksheet xmlns="{main}"><sheetData>{head}', True), *rows, f.text("</sheetData></worksheet>", True)]))
        f.zipped(members)


register("xlsx")(to_workbook)
register("openpyxl")(lambda target, tables: to_workbook(target, tables, styled=True))


def to_sqlite(target: str, tables: Tables, batch: int = 10_000) -> None:
    """All tables replaced in one transaction of a SQLite file; rows pass the driver one partition at a time."""
    kinds = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.BinaryType: "BLOB"}
    connection = sqlite3.connect(target, isolation_level=None)
    try:
        connection.execute("BEGIN")
        for name, df in tables.items():
            columns = ", ".join(f'"{f.name}" {kinds.get(type(f.dataType), "TEXT")}' for f in df.schema.fields)
            connection.execute(f'DROP TABLE IF EXISTS "{name}"')
            connection.execute(f'CREATE TABLE "{name}" ({columns})')
            marks, rows = ", ".join("?" * len(df.columns)), []
            plain = df.select(*[quoted(f.name) if type(f.dataType) in kinds else quoted(f.name).cast("string").alias(f.name) for f in df.schema.fields])
            for row in plain.toLocalIterator():
                rows.append(tuple(row))
                if len(rows) == batch:
                    connection.executemany(f'INSERT INTO "{name}" VALUES ({marks})', rows)
                    rows = []
            connection.executemany(f'INSERT INTO "{name}" VALUES ({marks})', rows)
        connection.execute("COMMIT")
    except BaseException:
        connection.execute("ROLLBACK")
        raise
    finally:
        connection.close()


def to_jdbc(tables: Tables, url: str, properties: Mapping[str, str], schema: str | None = None) -> None:
    """Each table replaced, with its columns, by Spark's own parallel writer; a table at a time."""
    for name, df in tables.items():
        df.write.jdbc(url, f"{schema}.{name}" if schema else name, mode="overwrite", properties=dict(properties))


#: table of a database that tells how far a run has come
JOURNAL = "tessera_journal"


def _connected(spark: SparkSession, url: str, properties: Mapping[str, str]):
    login = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        login.setProperty(k, v)
    if "driver" in properties:
        spark._jvm.java.lang.Class.forName(properties["driver"], True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    return spark._jvm.java.sql.DriverManager.getConnection(url, login)


def _state(spark: SparkSession, url: str, properties: Mapping[str, str], run: str) -> str | None:
    held = spark.read.jdbc(url, JOURNAL, properties=dict(properties))
    found = held.where(F.col("run") == run).select("state").collect()
    return found[0]["state"] if found else None


def to_jdbc_together(tables: Tables, url: str, properties: Mapping[str, str], run: str, schema: str | None = None) -> None:
    """The rows of all tables replaced, or of none. `run` names the attempt: the same one again goes on where it stopped.

    Executors fill a staging table beside each table, which may fail or be repeated at any point. Then one transaction on the driver
    empties the tables and fills them from their staging tables within the database, so that keys, grants and indexes stay; the
    journal's state changes in it too. Tables that do not exist are made first; those that do must have the columns."""
    if not tables:
        return
    spark, properties = next(iter(tables.values())).sparkSession, dict(properties)
    named = lambda n: f'{schema}."{n}"' if schema else f'"{n}"'
    spark.createDataFrame([], "run string, state string").write.option("createTableColumnTypes", "run VARCHAR(200), state VARCHAR(20)").jdbc(url, JOURNAL, mode="append", properties=properties)
    state = _state(spark, url, properties, run)
    if state == "done":
        return
    stages = {name: f"{name}_stage" for name in tables}
    if state != "staged":
        for name, df in tables.items():
            df.write.jdbc(url, named(stages[name]), mode="overwrite", properties=properties)
            df.limit(0).write.jdbc(url, named(name), mode="append", properties=properties)
        spark.createDataFrame([(run, "staged")], "run string, state string").coalesce(1).write.jdbc(url, JOURNAL, mode="append", properties=properties)
    connection = _connected(spark, url, properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for name in reversed(tables):  # what refers to others goes first, and comes last
            statement.executeUpdate(f"DELETE FROM {named(name)}")
        for name, df in tables.items():
            columns = ", ".join(f'"{c}"' for c in df.columns)
            statement.executeUpdate(f"INSERT INTO {named(name)} ({columns}) SELECT {columns} FROM {named(stages[name])}")
        done = connection.prepareStatement(f'UPDATE {JOURNAL} SET "state" = ? WHERE "run" = ?')
        done.setString(1, "done")
        done.setString(2, run)
        done.executeUpdate()
        connection.commit()
        for stage in stages.values():
            statement.executeUpdate(f"DROP TABLE {named(stage)}")
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


@register("db")
def to_database(target: str, tables: Tables) -> None:
    to_jdbc_together(tables, target, {}, uuid.uuid4().hex) if target.startswith("jdbc:") else to_sqlite(target, tables)


def table_shapes(spark: SparkSession, tables: Tables) -> DataFrame:
    """(entity, num_rows, num_columns), in one plan."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("num_rows")).select(F.lit(name).alias("entity"), "num_rows", F.lit(len(df.columns)).cast("long").alias("num_columns"))
        out = one if out is None else out.unionAll(one)
    return out if out is not None else spark.createDataFrame([], "entity string, num_rows long, num_columns long")


def write_table_shapes(folder: str, tables: Tables) -> str:
    spark = next(iter(tables.values())).sparkSession
    path = Path(folder) / "table_shapes.tsv"
    rows = [f"{r.entity}\t{r.num_rows}\t{r.num_columns}" for r in table_shapes(spark, tables).orderBy("entity").collect()]  # a row for each table
    path.write_text("\n".join(["entity\tnum_rows\tnum_columns", *rows]) + "\n", encoding="utf-8")
    return str(path)


def shape_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Entities whose shape differs or that only one side has."""
    a, b = (x.select("entity", F.col("num_rows").alias(f"rows_{n}"), F.col("num_columns").alias(f"columns_{n}")) for x, n in ((found, "found"), (expected, "expected")))
    differs = ~(F.col("rows_found").eqNullSafe(F.col("rows_expected")) & F.col("columns_found").eqNullSafe(F.col("columns_expected")))
    return a.join(b, "entity", "full").where(differs)


def timestamped(target: str, now) -> str:
    """name-20240131-120000.ext"""
    p = Path(target)
    return str(p.with_name(f"{p.stem}-{now:%Y%m%d-%H%M%S}{p.suffix}"))


def zip_folder(folder: str) -> str:
    with tempfile.TemporaryDirectory() as t:
        made = shutil.make_archive(f"{t}/out", "zip", folder)
        return shutil.move(made, f"{folder}.zip")


def _insert(table: str, df: DataFrame, batch: int) -> dict:
    return {"table": table, "columns": ", ".join(f'"{c}"' for c in df.columns), "batch": batch}


def insert_statements(table: str, df: DataFrame, batch: int = 500) -> str:
    """INSERT statements of a small lookup table as one text."""
    return "".join(text for text, _ in insert_texts(df.toLocalIterator(), _insert(table, df, batch))).rstrip("\n")


def to_insert_script(target: str, table: str, df: DataFrame, batch: int = 500) -> None:
    """A script of INSERT statements; tasks write its parts."""
    with SingleFile(target) as f:
        f.joined(f.parts(_ordered(df), "insert", False, **_insert(table, df, batch)))


@register("sql")
def to_insert_scripts(target: str, tables: Tables) -> None:
    for name, df in tables.items():
        to_insert_script(f"{local_path(target)}/{name}.sql", f'"{name}"', df)
