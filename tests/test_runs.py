"""Submissions as runs: stopped after any step they go on from there."""

import sqlite3
from collections import Counter

import pytest

from tessera.ingest import runs, submission
from tessera.sinks import writers
from tessera.sources import relational

from .test_project import sample_submission

SETTINGS = {"drop_ignored_columns": {"columns": ["date_*"]}}


class Stopped(BaseException):
    pass


def exported(out):
    return {n: Counter(map(tuple, getattr(out.eav, n).collect())) for n in ("tables", "columns", "records", "recordvalues")}


@pytest.mark.parametrize("stop", runs.STEPS)
def test_a_run_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch, stop):
    s, registered = sample_submission(spark), []
    run = runs.Run(spark, s.schema, f"file://{tmp_path}/run", SETTINGS, register=lambda name: registered.append(name) or 17, name="mine")
    with monkeypatch.context() as m:
        real = runs.Run._note
        m.setattr(runs.Run, "_note", lambda self, step, *a: (_ for _ in ()).throw(Stopped()) if step == stop else real(self, step, *a))
        with pytest.raises(Stopped):
            run.start(s)
    out = run.start(lambda: s)
    assert out.ran == list(runs.STEPS[runs.STEPS.index(stop) :])
    assert out.submission_id == 17
    assert len(registered) == (2 if stop == "register" else 1)  # by the same name
    fresh = sample_submission(spark)
    submission.ingest(spark, fresh, SETTINGS, str(tmp_path / "plain"))
    plain = runs.Outcome(eav=submission.Eav(**{n: spark.read.csv(f"{tmp_path}/plain/{n}", sep="\t", header=True) for n in ("tables", "columns", "records", "recordvalues")}))
    assert exported(out) == exported(plain)
    assert run.start(lambda: pytest.fail("all is done")).ran == []
    run.settings = {**SETTINGS, "update_missing_foreign_key": {"tbl_main": {"lookup_id": 1}}}
    assert run.start(lambda: pytest.fail("the load holds")).ran == ["policies", "checks", "register", "export"]


def test_faults_stop_a_run_before_it_is_registered(spark, tmp_path):
    s, registered = sample_submission(spark), []
    s.tables["tbl_main"] = spark.createDataFrame([(1, None, "x"), (1, "5", "y")], "system_id long, lookup_id string, description string")
    run = runs.Run(spark, s.schema, f"file://{tmp_path}/run", register=lambda name: registered.append(name) or 1)
    out = run.start(s)
    assert "SYSTEM_ID_NOT_UNIQUE" in {i.code for i in out.issues}
    assert out.eav is None
    assert registered == []
    assert run.start(s).ran == ["checks"]
    run.strict = False
    out = run.start(s)
    assert out.ran == ["checks", "register", "export"]
    assert out.issues
    assert out.eav.records.count() > 0


def test_workbook_to_a_schema_from_a_database(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE tbl_site (site_id INTEGER PRIMARY KEY, site_name VARCHAR(50) NOT NULL, kind_id INTEGER REFERENCES tbl_kind (kind_id), changed TIMESTAMP)")
        c.execute("CREATE TABLE tbl_kind (kind_id INTEGER PRIMARY KEY, kind TEXT)")
        c.execute("CREATE TABLE no_key (a INTEGER)")
    schema = runs.schema_from_database(relational.sqlite_tables(path), lookups=lambda n: n == "tbl_kind", sheets={"tbl_site": "sites"})
    assert set(schema.tables) == {"tbl_site", "tbl_kind"}
    site = schema.tables["tbl_site"]
    assert (site.pk_name, site.java_class, site.excel_sheet) == ("site_id", "TblSite", "sites")
    assert [(c.name, c.class_name, c.fk_table) for c in site.columns.values()] == [("site_id", "java.lang.Integer", None), ("site_name", "java.lang.String", None), ("kind_id", "TblKind", "tbl_kind"), ("changed", "java.sql.Timestamp", None)]
    book = str(tmp_path / "in.xlsx")
    writers.write("xlsx", book, {"sites": spark.createDataFrame([(1, "North", 4), (2, "South", 5)], "system_id long, site_name string, kind_id long")})
    out = runs.Run(spark, schema, f"file://{tmp_path}/run").start(book)
    assert out.issues == []
    assert Counter(r.class_name for r in out.eav.records.collect()) == {"TblSite": 2, "TblKind": 2}
