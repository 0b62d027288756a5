"""What lies just beyond limits that earlier versions had, and brute force for what is searched."""

import random
import sqlite3

import pytest

from tessera.config.project import Entity, ForeignKey, Project
from tessera.operators import shared
from tessera.operators.link import LinkError, Remote, link
from tessera.plans.pipeline import normalize
from tessera.recon import reconcile
from tessera.sources import relational


def trigrams(name):
    padded = f"  {name} "
    return {padded[k : k + 3] for k in range(len(padded) - 2)}


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_candidates_are_all_that_reach_the_threshold(spark, least):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(120)})
    asked = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)} | set(names[:10]) | {"zzz"})
    found = reconcile.local_scores(
        spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(f"x/{k}", n) for k, n in enumerate(names)], "uri string, name string"), "uri", "name", 10**6, least
    )
    want = {}
    for q in asked:
        for k, n in enumerate(names):
            a, b = trigrams(q), trigrams(n)
            if len(a & b) >= least * len(a | b) - 1e-9:
                want[q, f"x/{k}"] = round(100 * len(a & b) / len(a | b), 6)
    assert {(r.query, r.id): round(r.score, 6) for r in found.collect()} == want


def test_links_that_wait_for_many_others(spark):
    """The key of each deferred link comes with the one before, listed in the other order: each pass makes one."""
    n = 9
    things = {f"e{k}": {"source": "raw", "public_id": f"e{k}_id", "keys": ["code"], "columns": ["code"]} for k in range(n)}
    fks = [{"entity": f"e{k}", "local_keys": [f"k{k}"], "remote_keys": ["code"], "how": "left", "extra_columns": {f"k{k + 1}": "code"}, "defer_dependency": True} for k in range(n)]
    things["all"] = {"source": "raw", "keys": ["code"], "columns": ["code", "k0"], "foreign_keys": fks[::-1]}
    made = normalize(spark, Project.of({"entities": things}), None, {"raw": spark.range(3).selectExpr("id code", "id k0")})
    assert made.unlinked == {}
    assert sorted((r[f"k{n}"], r["e8_id"]) for r in made.tables["all"].collect()) == [(0, 1), (1, 2), (2, 3)]


def test_types_of_a_query_come_from_all_its_rows(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (a, b, c, d)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(k, k, None, b"x") for k in range(1500)])
        c.execute("INSERT INTO t VALUES (2.5, 'x', 7, x'00')")
    df = relational.read_sqlite(spark, Entity.of("t", {"type": "sqlite", "query": "SELECT * FROM t"}), {"filename": path})
    assert [t for _, t in df.dtypes] == ["double", "string", "bigint", "binary"]
    assert df.where("a = 2.5").first().b == "x"
    assert df.count() == 1501
    none = relational.read_sqlite(spark, Entity.of("t", {"type": "sqlite", "query": "SELECT a, b FROM t WHERE a < 0"}), {"filename": path})
    assert none.count() == 0


def test_a_cluster_must_name_its_shared_folder():
    class Nothing:
        def __getattr__(self, name):
            return lambda *_: self

        def isDefined(self):  # noqa: N802  as the JVM has it
            return False

    class Context:
        _jsc = Nothing()

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    Session.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_no_keys_are_no_cross_join(spark):
    df = spark.range(2).toDF("a")
    with pytest.raises(LinkError, match="how: cross"):
        link(df, ForeignKey("b"), Remote("b", df.toDF("system_id")))


def test_settled_rows_keep_odd_names_and_kinds(spark):
    df = spark.sql("SELECT 1 AS `a b`, 2 AS `a.b`, 3 AS `A B;`, null AS nothing, array(1) AS list")
    got = shared.fixed(df)
    assert got.dtypes == df.dtypes
    assert got.collect() == df.collect()


def test_jdbc_metadata(spark):
    """What a driver's metadata says of tables, columns, keys; rows as JDBC metadata gives them."""
    said = {
        "tables": [{"TABLE_NAME": "site"}, {"TABLE_NAME": "sample"}],
        "site": ([{"COLUMN_NAME": "id", "TYPE_NAME": "int8", "NULLABLE": 0}, {"COLUMN_NAME": "name", "TYPE_NAME": "text", "NULLABLE": 1}], ["id"], []),
        "sample": ([{"COLUMN_NAME": "id", "TYPE_NAME": "int8", "NULLABLE": 0}, {"COLUMN_NAME": "site_id", "TYPE_NAME": "int8", "NULLABLE": 1}], ["id"], [("site_id", "site", "id")]),
    }
    found = relational.tables_of(said["tables"], lambda t: said[t], lambda t: 4 if t == "site" else None)
    assert found["sample"].foreign_keys == (("site_id", "site", "id"),)
    assert found["site"].primary_keys == ("id",)
    assert found["site"].row_count == 4
    assert [c.nullable for c in found["site"].columns] == [False, True]


def test_old_workbooks_are_refused_by_name(spark, tmp_path):
    from tessera.sources.files import Workbook
    from tessera.sources.registry import SourceError

    path = tmp_path / "old.xls"
    path.write_bytes(bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 600)
    with pytest.raises(SourceError, match="only .xlsx"):
        Workbook(str(path))
