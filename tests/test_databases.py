"""Database scans: what is pushed down, how they are cut, and that no row is lost or read twice."""

import random
import sqlite3
from collections import Counter

import pytest

from tessera.config.project import Entity
from tessera.sources import relational
from tessera.sources.registry import SourceError


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("db") / "x.db"), random.Random(2)
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER, x REAL, s TEXT COLLATE NOCASE, mixed, b BLOB, unread TEXT)")
        # most ids far apart from the others, many equal and null values of n
        ids = [*range(1, 900), *range(10**9, 10**9 + 100)]
        rows = [(i, rng.choice([None, 7, 7, 7, rng.randrange(1000)]), rng.choice([None, rng.random()]), rng.choice([None, "a", "A", "ab", "Ab", "b", "é"]), rng.choice([None, 5, "5", 5.5, "x"]), b"z", "no") for i in ids]
        c.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
        c.execute("CREATE TABLE keyed (a TEXT PRIMARY KEY, b INTEGER) WITHOUT ROWID")
        c.executemany("INSERT INTO keyed VALUES (?, ?)", [(f"k{i}", i) for i in range(50)])
        c.execute("CREATE TABLE none (id INTEGER)")
    return path, rows


def read(spark, path, **options):
    return relational._sqlite_reader(spark, {"filename": path, **options}).option("dbtable", "t").load()


def test_one_frame_serves_several_filters(spark, database):
    path, rows = database
    df = read(spark, path, numPartitions=4)
    assert df.where("n = 7").count() == sum(r[1] == 7 for r in rows)
    assert df.where("s = 'a'").count() == sum(r[3] == "a" for r in rows)
    assert df.count() == len(rows)
    assert read(spark, path, numPartitions=3, where="n = 7 OR n IS NULL").count() == sum(r[1] in (7, None) for r in rows)


def test_partitions_hold_as_many_rows(spark, database):
    path, rows = database
    df = read(spark, path, numPartitions=4)
    sizes = [r["count"] for r in df.groupBy(relational.F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4
    assert max(sizes) - min(sizes) <= 1
    query = Entity.of("q", {"type": "sqlite", "query": "SELECT n, id, unread FROM t WHERE id > 100", "keys": ["n"], "columns": ["id"]})
    got = relational.read_sqlite(spark, query, {"filename": path, "numPartitions": 3})
    assert got.columns == ["n", "id"]  # what the entity does not name is not read
    assert got.rdd.getNumPartitions() > 1
    assert Counter(map(tuple, got.collect())) == Counter((r[1], r[0]) for r in rows if r[0] > 100)
    with pytest.raises(SourceError, match="to split by"):
        relational.read_sqlite(spark, query, {"filename": path, "numPartitions": 3, "key": "gone"})


def test_declared_types_of_a_table(spark, database):
    path, _ = database
    entity = Entity.of("t", {"type": "sqlite", "keys": ["id"], "columns": ["x", "b"]})
    got = relational.read_sqlite(spark, entity, {"filename": path, "dbtable": "t", "numPartitions": 2})
    assert dict(got.dtypes) == {"id": "bigint", "x": "double", "b": "binary"}
    assert got.count() == 999
    assert relational.read_table(spark, "sqlite", {"filename": path, "numPartitions": 3}, "none").count() == 0


def test_pages_have_an_order(spark, database):
    path, rows = database
    pages = [relational.read_table(spark, "sqlite", {"filename": path}, "t", 250, a, columns=["id"]).collect() for a in range(0, 1000, 250)]
    assert [r.id for page in pages for r in page] == [r[0] for r in rows]
    keyed = [r.b for a in (0, 30) for r in relational.read_table(spark, "sqlite", {"filename": path}, "keyed", 30, a).collect()]
    assert keyed == [i for _, i in sorted((f"k{i}", i) for i in range(50))]
    by = relational.read_table(spark, "sqlite", {"filename": path}, "t", 5, 3, order=["x", "id"]).collect()
    assert [r.id for r in by] == [r[0] for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))[3:8]]


DERBY = {"url": "jdbc:derby:memory:tessera;create=true", "driver_class": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def server(spark):
    """A database inside Spark's own JVM, reached over JDBC."""
    rows = [(i, None if i % 11 == 0 else i % 5, f"2024-01-{1 + i % 28:02d}", f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, n int, day string, s string").selectExpr("id", "n", "cast(day AS date) AS day", "s")
    df.coalesce(1).write.format("jdbc").options(url=DERBY["url"], driver=DERBY["driver_class"], dbtable="t").mode("overwrite").save()
    return rows


@pytest.mark.parametrize("key", ["ID", "N", "DAY"])
def test_queries_over_jdbc_are_cut_by_key(spark, server, key):
    entity = Entity.of("q", {"type": "jdbc", "query": 'SELECT "id" AS id, "n" AS n, "day" AS day, "s" AS s FROM t WHERE "id" >= 20;'})
    from tessera.sources.registry import DRIVERS

    got = DRIVERS["jdbc"].read(spark, entity, {**DERBY, "key": key, "numPartitions": 4})
    assert got.rdd.getNumPartitions() >= 3
    assert Counter((r.ID, r.N, str(r.DAY), r.S) for r in got.collect()) == Counter(server[20:])
    plan = got.where("ID = 50").select("S")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(ID), *EqualTo(ID,50)]" in plan
    assert "ReadSchema: struct<S:string>" in plan
    assert DRIVERS["jdbc"].read(spark, entity, {**DERBY, "key": "S", "numPartitions": 4}).rdd.getNumPartitions() == 1  # texts are not cut


def test_pages_and_tables_over_jdbc(spark, server):
    ids = [r.id for a in (0, 150, 300) for r in relational.read_table(spark, "jdbc", DERBY, "t", 150, a, columns=["id"], order=["id"]).collect()]
    assert ids == list(range(400))
    whole = relational.read_table(spark, "jdbc", {**DERBY, "key": "id", "numPartitions": 5}, "t")
    assert whole.rdd.getNumPartitions() == 5
    assert whole.count() == 400
    info = relational.jdbc_tables(spark, "jdbc", DERBY, "APP", count=True)
    assert info["T"].row_count == 400
    assert [c.name for c in info["T"].columns] == ["id", "n", "day", "s"]


def test_range_tests():
    assert relational.range_tests("k", []) == ["1 = 1"]
    assert relational.range_tests("k", [3, 9]) == ["(k <= 3 OR k IS NULL)", "k > 3 AND k <= 9", "k > 9"]


def execute(spark, *statements):
    from tessera.sinks.writers import _connected

    c = _connected(spark, DERBY["url"], {"driver": DERBY["driver_class"]})
    for s in statements:
        c.createStatement().executeUpdate(s)
    c.close()


def stored(spark, name):
    return sorted(tuple(r) for r in spark.read.jdbc(DERBY["url"], f'"{name}"', properties={"driver": DERBY["driver_class"]}).collect())


def test_all_tables_or_none(spark, server):
    from tessera.sinks.writers import to_jdbc_together

    login = {"driver": DERBY["driver_class"]}
    put = lambda run, **tables: to_jdbc_together(tables, DERBY["url"], login, run)
    site, sample = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string"), spark.range(6).selectExpr("id", "cast(id % 2 + 1 AS int) AS site_id").repartition(3)
    execute(spark, 'CREATE TABLE "site" ("id" INT PRIMARY KEY, "s" VARCHAR(9))', 'CREATE TABLE "sample" ("id" BIGINT, "site_id" INT REFERENCES "site" ("id"))')
    put("one", site=site, sample=sample)
    assert stored(spark, "site") == [(1, "a"), (2, "b")]
    assert stored(spark, "sample") == [(i, i % 2 + 1) for i in range(6)]
    put("one", site=site.limit(0), sample=sample.limit(0))  # that run is done
    assert len(stored(spark, "sample")) == 6
    orphans = sample.selectExpr("id", "site_id + 7 AS site_id")
    with pytest.raises(Exception, match="foreign key|FOREIGN KEY|constraint"):
        put("two", site=site.selectExpr("id", "'new' AS s"), sample=orphans)
    assert stored(spark, "site") == [(1, "a"), (2, "b")]  # the first table too is as it was
    assert len(stored(spark, "sample")) == 6
    broken = site.selectExpr("id", "CASE WHEN id = 2 THEN raise_error('lost executor') ELSE s END AS s")
    with pytest.raises(Exception, match="lost executor"):
        put("three", site=site, sample=sample, fresh=broken)
    assert len(stored(spark, "sample")) == 6
    put("three", site=site.selectExpr("id + 2 AS id", "s"), sample=sample.selectExpr("id", "site_id + 2 AS site_id"), fresh=site)
    assert stored(spark, "site") == [(3, "a"), (4, "b")]
    assert stored(spark, "fresh") == [(1, "a"), (2, "b")]
    names = {t.lower() for t in relational.jdbc_tables(spark, "jdbc", DERBY, "APP")}
    assert not any(n in names for n in ("site_stage", "fresh_stage"))


def test_a_staged_run_goes_on(spark, server):
    """Stopped between staging and the transaction: the next start needs no executor, and takes what was staged."""
    from tessera.sinks import writers

    login, df = {"driver": DERBY["driver_class"]}, spark.range(3).selectExpr("id")
    real = writers._connected
    try:
        writers._connected = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
        with pytest.raises(KeyboardInterrupt):
            writers.to_jdbc_together({"later": df}, DERBY["url"], login, "run")
    finally:
        writers._connected = real
    assert stored(spark, "later") == []
    assert len(stored(spark, "later_stage")) == 3
    writers.to_jdbc_together({"later": df.where("false")}, DERBY["url"], login, "run")
    assert stored(spark, "later") == [(0,), (1,), (2,)]
