"""Databases: SQL queries and tables over JDBC, SQLite by its own library, and what they contain."""

from __future__ import annotations

import datetime
import json
import re
import sqlite3
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config.project import Entity
from .registry import Option, SourceError, register


def checked_columns(df: DataFrame, entity: Entity) -> DataFrame:
    """auto_detect_columns: the declared columns must be in the result; otherwise names are given by position."""
    declared = [c for c in dict.fromkeys([*entity.keys, *entity.columns])]
    if not declared:
        return df
    if entity.auto_detect_columns:
        later = set(entity.extra_columns) | {c for f in entity.foreign_keys for c in f.extra_columns}
        later |= {entity.unnest.var_name, entity.unnest.value_name} if entity.unnest else set()
        missing = [c for c in declared if c not in df.columns and c not in later]
        if missing:
            raise SourceError(f"{entity.name}: the query has no column {', '.join(missing)}")
        return df
    if len(df.columns) != len(declared):
        raise SourceError(f"{entity.name}: the query has {len(df.columns)} columns for {len(declared)} names")
    return df.toDF(*declared)


_SQLITE_KINDS = {"INT": T.LongType(), "REAL": T.DoubleType(), "FLOA": T.DoubleType(), "DOUB": T.DoubleType(), "NUM": T.DoubleType(), "DEC": T.DoubleType(), "BOOL": T.BooleanType(), "BLOB": T.BinaryType()}


def mentioned(entity: Entity, names: Sequence[str]) -> list[str]:
    """Of a result's columns those that the entity's configuration names anywhere; all, where it declares none."""
    if not (entity.keys or entity.columns) or not entity.auto_detect_columns and entity.query:
        return list(names)
    text = json.dumps({k: v for k, v in entity.raw.items() if k != "query"}, default=str, ensure_ascii=False)
    return [n for n in names if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text)] or list(names)


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """Spark data source `sqlite`: a query or a table, by some of its columns, cut into partitions at places of a sorted key.

    Options: filename, query or dbtable, columns (a JSON list), key and numPartitions, page ("limit,offset"), where (SQL).
    Filters of the plan are not taken over: Spark 4.1 keeps what a Python source accepts with the relation, so that another use of the
    same frame, with other filters or none, would read those rows only."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _connect(self):
        return sqlite3.connect(f"file:{self.options['filename']}?mode=ro", uri=True)

    def _from(self) -> str:
        return f"({self.options['query']})" if self.options.get("query") else _name(self.options["dbtable"])

    def _columns(self, c: sqlite3.Connection) -> list[str]:
        names = [d[0] for d in c.execute(f"SELECT * FROM {self._from()} LIMIT 0").description]
        wanted = json.loads(self.options.get("columns") or "null")
        return [n for n in names if wanted is None or n in wanted]

    def _key(self, c: sqlite3.Connection) -> str | None:
        """What partitions and pages go by: the key named, or a table's rowid if it has one."""
        if self.options.get("key"):
            return _name(self.options["key"])
        if self.options.get("dbtable"):
            try:
                c.execute(f"SELECT rowid FROM {self._from()} LIMIT 0")
            except sqlite3.OperationalError:
                return None
            return "rowid"
        return None

    def schema(self) -> T.StructType:
        with self._connect() as c:
            names = self._columns(c)
            declared = {}
            if self.options.get("dbtable"):
                declared = {r[1]: next((k for p, k in _SQLITE_KINDS.items() if p in (r[2] or "").upper()), None) for r in c.execute(f"PRAGMA table_info({self._from()})")}
            # a query's columns have no declared type: which storage classes occur is asked of all its rows, in one pass
            asked = [n for n in names if not declared.get(n)]
            kinds = [f"max(typeof({_name(n)}) = '{kind}')" for n in asked for kind in _STORED]
            seen = c.execute(f"SELECT {', '.join(kinds)} FROM {self._from()}").fetchone() if asked else ()
            for k, n in enumerate(asked):
                declared[n] = _seen({kind for kind, there in zip(_STORED, seen[4 * k : 4 * k + 4], strict=True) if there})
        return T.StructType([T.StructField(n, declared[n]) for n in names])

    def reader(self, schema):
        source = self

        class Reader(DataSourceReader):
            def partitions(self):
                n = int(source.options.get("numpartitions", "1"))
                with source._connect() as c:
                    key = source._key(c)
                    if key is None or n < 2 or source.options.get("page"):
                        return [InputPartition(None)]
                    ranks = f"SELECT {key} AS k, ntile({n}) OVER (ORDER BY {key}) AS t FROM {source._from()} WHERE {key} IS NOT NULL"
                    ends = [r[0] for r in c.execute(f"SELECT max(k) FROM ({ranks}) GROUP BY t ORDER BY t")]
                ends = list(dict.fromkeys(ends))[:-1]
                return [InputPartition((key, a, b)) for a, b in zip([None, *ends], [*ends, None], strict=True)]

            def read(self, partition):
                tests, values = [f"({source.options['where']})"] if source.options.get("where") else [], []
                if partition.value:
                    key, a, b = partition.value
                    if a is not None:
                        tests.append(f"{key} > ?")
                        values.append(a)
                    if b is not None:
                        tests.append(f"({key} <= ?{' OR ' + key + ' IS NULL' if a is None else ''})")
                        values.append(b)
                with source._connect() as c:
                    names = [f.name for f in schema.fields]
                    query = f"SELECT {', '.join(map(_name, names)) or '1'} FROM {source._from()}"
                    query += f" WHERE {' AND '.join(tests)}" if tests else ""
                    if source.options.get("page"):
                        limit, offset = map(int, source.options["page"].split(","))
                        query += f" ORDER BY {source._key(c) or ', '.join(map(_name, names))} LIMIT {limit} OFFSET {offset}"
                    kinds = [f.dataType for f in schema.fields]
                    for row in c.execute(query, values):
                        yield tuple(_cast(v, k) for v, k in zip(row, kinds, strict=True))

        return Reader()


_STORED = ("integer", "real", "blob", "text")


def _seen(kinds: set[str]) -> T.DataType:
    if kinds == {"integer"}:
        return T.LongType()
    if kinds and kinds <= {"integer", "real"}:
        return T.DoubleType()
    return T.BinaryType() if kinds == {"blob"} else T.StringType()


def _cast(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return str(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    return float(value) if isinstance(kind, T.DoubleType) else value


def _sqlite_reader(spark: SparkSession, options: dict):
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("filename", options["filename"])
    for k in ("numPartitions", "key", "where"):
        reader = reader.option(k, options[k]) if options.get(k) else reader
    return reader


_SQLITE_FILE = Option("filename", "path", True, None, ("database", "dbname", "path"))
_SPLIT = (Option("key", aliases=("partitionColumn",)), Option("numPartitions", "integer"))


@register("sqlite", options=(_SQLITE_FILE, *_SPLIT), category="database", help="SQLite file")
def read_sqlite(spark: SparkSession, entity: Entity, options: dict) -> DataFrame:
    """A query or, with its declared types, a table (dbtable); only columns that the entity names are read."""
    if not options.get("key") and options.get("numPartitions") and not options.get("dbtable"):
        options = {**options, "key": entity.keys[0] if entity.keys else None}
    whole = bool(options.get("dbtable")) and not (entity.query or options.get("query"))
    reader = _sqlite_reader(spark, options)
    reader = reader.option("dbtable", options["dbtable"]) if whole else reader.option("query", _query(entity, options))
    with sqlite3.connect(f"file:{options['filename']}?mode=ro", uri=True) as c:
        names = [d[0] for d in c.execute(f"SELECT * FROM {_name(options['dbtable']) if whole else '(' + _query(entity, options) + ')'} LIMIT 0").description]
    if options.get("key") and options["key"] not in names:
        raise SourceError(f"{entity.name}: no column {options['key']} to split by")
    return checked_columns(reader.option("columns", json.dumps(mentioned(entity, names))).load(), entity)


def _query(entity: Entity, options: dict) -> str:
    query = entity.query or options.get("query") or (f'SELECT * FROM "{options["dbtable"]}"' if options.get("dbtable") else None)
    if not query:
        raise SourceError(f"{entity.name}: which query?")
    return query.strip().rstrip(";")


_SERVER = (Option("host", default="localhost"), Option("port", "integer"), Option("dbname", "string", True, None, ("database",)), Option("user", aliases=("username",)), Option("password", "password"))


def jdbc_options(driver: str, options: dict) -> dict[str, str]:
    """URL, driver class and partitioning of a JDBC read."""
    if driver in ("postgres", "postgresql"):
        out = {"url": f"jdbc:postgresql://{options.get('host', 'localhost')}:{options.get('port') or 5432}/{options['dbname']}", "driver": "org.postgresql.Driver"}
    elif driver in ("ucanaccess", "access"):
        out = {"url": f"jdbc:ucanaccess://{options['filename']};memory=false;ignoreCase=true", "driver": "net.ucanaccess.jdbc.UcanaccessDriver"}
    else:
        out = {"url": options["url"], **({"driver": options["driver_class"]} if options.get("driver_class") else {})}
    bounded = all(options.get(k) is not None for k in ("partitionColumn", "lowerBound", "upperBound"))
    for k in ("user", "password", "fetchsize", *(("partitionColumn", "lowerBound", "upperBound", "numPartitions") if bounded else ())):
        if options.get(k) is not None:
            out[k] = str(options[k])
    return out


def _literal(value) -> str:
    """A number, date or time as JDBC drivers read it."""
    if isinstance(value, datetime.datetime):
        return "{ts '" + value.isoformat(" ") + "'}"
    if isinstance(value, datetime.date):
        return "{d '" + value.isoformat() + "'}"
    return str(value) if isinstance(value, int | Decimal) else repr(float(value))


def range_tests(column: str, ends: Sequence) -> list[str]:
    """SQL tests of which each value, null included, passes one: up to the first end, between ends, beyond the last."""
    if not ends:
        return ["1 = 1"]
    said = [_literal(e) for e in ends]
    middle = [f"{column} > {a} AND {column} <= {b}" for a, b in zip(said, said[1:], strict=False)]
    return [f"({column} <= {said[0]} OR {column} IS NULL)", *middle, f"{column} > {said[-1]}"]


def split_jdbc(spark: SparkSession, said: dict[str, str], table: str, key: str | None, n: int) -> DataFrame:
    """A table or query (in brackets, with a name), read by n connections at once where it has a key that is a number, date or time.

    Where to cut is found once: the key column alone is sorted into n ranges of about as many rows by the executors, and the
    ranges' ends become predicates. Texts are sorted otherwise by some databases and are not cut."""
    whole = spark.read.format("jdbc").options(**said).option("dbtable", table).load()
    known = {c.lower(): c for c in whole.columns}
    if n < 2 or key is None or key.lower() not in known:
        return whole
    key = known[key.lower()]
    if not isinstance(whole.schema[key].dataType, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        return whole
    keys = whole.select(F.col(f"`{key}`").alias("k")).where(F.col("k").isNotNull())
    found = keys.repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.max("k").alias("k")).collect()  # n rows
    ends = sorted(r["k"] for r in found)[:-1]
    login = {k: v for k, v in said.items() if k not in ("url", "partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    return spark.read.jdbc(said["url"], table, predicates=range_tests(_name(key), ends), properties=login)


def _jdbc(driver: str):
    def read(spark: SparkSession, entity: Entity, options: dict) -> DataFrame:
        said = jdbc_options(driver, options)
        table = f"({_query(entity, options)}) q"
        if "partitionColumn" in said:
            return checked_columns(spark.read.format("jdbc").options(**said).option("dbtable", table).load(), entity)
        key = options.get("key") or options.get("partitionColumn") or (entity.keys[0] if entity.keys else None)
        return checked_columns(split_jdbc(spark, said, table, key, int(options.get("numPartitions") or 1)), entity)

    return read


register("postgres", "postgresql", options=_SERVER, category="database", help="PostgreSQL over JDBC; the driver's jar must be on Spark's class path")(_jdbc("postgresql"))
register("ucanaccess", "access", options=(Option("filename", "path", True),), category="database", help="MS Access over JDBC; the driver's jar must be on Spark's class path")(_jdbc("ucanaccess"))
register("jdbc", options=(Option("url", required=True), Option("driver_class")), category="database", help="any JDBC database")(_jdbc("jdbc"))


def read_table(
    spark: SparkSession, driver: str, options: dict, table: str, limit: int | None = None, offset: int = 0, columns: Sequence[str] | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """A table, or a page of it in a stable order: by `order`, else by SQLite's rowid, else by all columns."""
    if driver == "sqlite":
        reader = _sqlite_reader(spark, {**options, "key": order[0]} if len(order) == 1 else options).option("dbtable", table)
        reader = reader if columns is None else reader.option("columns", json.dumps(list(columns)))
        if len(order) < 2:
            return (reader.option("page", f"{-1 if limit is None else limit},{offset}") if limit is not None or offset else reader).load()
        df = reader.load()
    else:
        said = jdbc_options(driver, options)
        df = spark.read.format("jdbc").options(**said).option("dbtable", table).load() if "partitionColumn" in said else split_jdbc(spark, said, table, options.get("key"), int(options.get("numPartitions") or 1))
        df = df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])
    if limit is not None or offset:
        df = df.orderBy(*[F.col(f"`{c}`") for c in order or df.columns])
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: tuple[ColumnInfo, ...]
    primary_keys: tuple[str, ...] = ()
    #: (column, other table, other column)
    foreign_keys: tuple[tuple[str, str, str], ...] = ()
    row_count: int | None = None


def sqlite_tables(filename: str, count: bool = False) -> dict[str, TableInfo]:
    out = {}
    with sqlite3.connect(f"file:{filename}?mode=ro", uri=True) as c:
        for (name,) in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            columns = [ColumnInfo(r[1], r[2] or "text", not r[3], bool(r[5])) for r in c.execute(f'PRAGMA table_info("{name}")')]
            fks = tuple((r[3], r[2], r[4]) for r in c.execute(f'PRAGMA foreign_key_list("{name}")'))
            n = c.execute(f'SELECT count(*) FROM "{name}"').fetchone()[0] if count else None
            out[name] = TableInfo(name, tuple(columns), tuple(x.name for x in columns if x.primary_key), fks, n)
    return out


def tables_of(tables: Sequence[dict], described: Callable[[str], tuple], counted: Callable[[str], int | None]) -> dict[str, TableInfo]:
    """From rows as a database's metadata gives them: tables, and for each its columns, primary keys and foreign keys."""
    out = {}
    for name in sorted(t["TABLE_NAME"] for t in tables):
        columns, keys, fks = described(name)
        known = tuple(ColumnInfo(c["COLUMN_NAME"], c["TYPE_NAME"], c["NULLABLE"] != 0, c["COLUMN_NAME"] in keys) for c in columns)
        out[name] = TableInfo(name, known, tuple(keys), tuple(fks), counted(name))
    return out


def jdbc_tables(spark: SparkSession, driver: str, options: dict, schema: str | None = None, count: bool = False) -> dict[str, TableInfo]:
    """Tables and views of a database, their columns, keys and (if asked for) row counts, by its JDBC driver's own metadata."""
    said = jdbc_options(driver, options)
    login = spark._jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in said:
            login.setProperty(k, said[k])
    if "driver" in said:
        spark._jvm.java.lang.Class.forName(said["driver"], True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    connection = spark._jvm.java.sql.DriverManager.getConnection(said["url"], login)
    try:
        meta = connection.getMetaData()

        def rows(found, *columns: str) -> list[dict]:
            out = []
            while found.next():
                out.append({c: found.getString(c) for c in columns})
            found.close()
            return out

        def described(table: str) -> tuple:
            columns = [{**c, "NULLABLE": int(c["NULLABLE"])} for c in rows(meta.getColumns(None, schema, table, None), "COLUMN_NAME", "TYPE_NAME", "NULLABLE")]
            keys = sorted(rows(meta.getPrimaryKeys(None, schema, table), "COLUMN_NAME", "KEY_SEQ"), key=lambda r: int(r["KEY_SEQ"]))
            fks = rows(meta.getImportedKeys(None, schema, table), "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME")
            return columns, [k["COLUMN_NAME"] for k in keys], [(f["FKCOLUMN_NAME"], f["PKTABLE_NAME"], f["PKCOLUMN_NAME"]) for f in fks]

        found = [t for t in rows(meta.getTables(None, schema, None, None), "TABLE_NAME", "TABLE_TYPE") if t["TABLE_TYPE"] in ("TABLE", "BASE TABLE", "VIEW")]
        return tables_of(found, described, lambda t: read_table(spark, driver, options, f'"{schema}"."{t}"' if schema else f'"{t}"').count() if count else None)
    finally:
        connection.close()


def catalog_tables(spark: SparkSession, names: Sequence[str] | None = None, count: bool = False) -> dict[str, TableInfo]:
    """Tables and views that Spark knows."""
    out = {}
    for t in spark.catalog.listTables():
        if names is None or t.name in names:
            df = spark.table(t.name)
            out[t.name] = frame_info(t.name, df, df.count() if count else None)
    return out


def frame_info(name: str, df: DataFrame, row_count: int | None = None) -> TableInfo:
    return TableInfo(name, tuple(ColumnInfo(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields), row_count=row_count)
