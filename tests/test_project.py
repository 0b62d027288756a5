"""Configuration, whole pipelines, checks, sources, sinks, services, ingest, reconciliation, streams."""

import datetime
import sqlite3

import pytest

from tessera.config import directives
from tessera.config.project import Entity, Project, ProjectError, cycles, order_of
from tessera.ingest import submission
from tessera.plans.pipeline import duplicate_keys, normalize, workflow
from tessera.quality import conformance, specifications, validators
from tessera.recon import reconcile
from tessera.service import analysis
from tessera.sinks import writers
from tessera.sources import files, registry, relational
from tessera.streaming import steps


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


SAMPLES = {
    "entities": {
        "site": {"type": "fixed", "public_id": "site_id", "keys": ["name"], "columns": ["name"], "values": [["north"], ["south"]]},
        "sample": {
            "source": "raw", "public_id": "sample_id", "keys": ["code"], "columns": ["code", "site"], "drop_duplicates": ["code"],
            "foreign_keys": [{"entity": "site", "local_keys": ["site"], "remote_keys": ["name"], "how": "left"}],
            "extra_columns": {"label": "{site_id}/{code}"},
        },
        "measure": {
            "source": "raw", "public_id": "measure_id", "keys": ["code"], "columns": ["code", "ph", "depth"],
            "unnest": {"id_vars": ["code"], "value_vars": ["ph", "depth"], "var_name": "what", "value_name": "value"},
            "filters": [{"type": "query", "query": "value.notna()", "stage": "after_unnest"}],
            "foreign_keys": [{"entity": "sample", "local_keys": ["code"], "remote_keys": ["code"], "how": "left"}, {"entity": "kind", "local_keys": ["what"], "remote_keys": ["what"], "how": "left"}],
        },
        "kind": {"type": "fixed", "public_id": "kind_id", "keys": ["what"], "columns": ["what"], "values": ["ph", "depth"]},
    }
}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([("s1", "north", 7.1, 3.0), ("s2", "south", None, 4.5), ("s3", "west", 6.0, None), ("s1", "north", 7.1, 3.0)], "code string, site string, ph double, depth double")


def test_pipeline(spark, raw):
    result = normalize(spark, Project.of(SAMPLES), given={"raw": raw})
    assert rows(result.tables["sample"], "system_id", "sample_id", "site_id", "code", "label") == sorted([(1, None, 1, "s1", "1/s1"), (2, None, 2, "s2", "2/s2"), (3, None, None, "s3", "/s3")], key=repr)
    m = result.tables["measure"]
    assert m.columns == ["system_id", "measure_id", "kind_id", "sample_id", "code", "value", "what"]
    assert sorted(rows(m, "sample_id", "kind_id", "value")) == sorted([(1, 1, 7.1), (1, 1, 7.1), (1, 2, 3.0), (1, 2, 3.0), (2, 2, 4.5), (3, 1, 6.0)])
    assert not result.unlinked
    assert not result.unresolved
    assert normalize(spark, Project.of(SAMPLES), ["site"], {"raw": raw}).tables.keys() == {"site"}


def test_cyclic_links(spark):
    spec = {
        "entities": {
            "a": {"type": "fixed", "public_id": "a_id", "keys": ["k"], "columns": ["k", "bk"], "values": [["x", "p"], ["y", "q"]], "foreign_keys": [{"entity": "b", "local_keys": ["bk"], "remote_keys": ["k"], "how": "left", "defer_dependency": True}]},
            "b": {"type": "fixed", "public_id": "b_id", "keys": ["k"], "columns": ["k", "ak"], "values": [["p", "y"], ["q", "x"]], "foreign_keys": [{"entity": "a", "local_keys": ["ak"], "remote_keys": ["k"], "how": "left"}]},
        }
    }
    project = Project.of(spec)
    assert order_of(project) == ["a", "b"]
    tables = normalize(spark, project).tables
    assert rows(tables["a"], "k", "b_id") == [("x", 1), ("y", 2)]
    assert rows(tables["b"], "k", "a_id") == [("p", 2), ("q", 1)]
    spec["entities"]["a"]["foreign_keys"][0].pop("defer_dependency")
    assert cycles(Project.of(spec)) == [["a", "b", "a"]]
    with pytest.raises(ProjectError, match="depend on each other"):
        order_of(Project.of(spec))


def test_append_and_merge(spark):
    given = {"raw": spark.createDataFrame([("1", "a")], "id string, name string")}
    spec = {"entities": {"s": {"source": "raw", "keys": ["id"], "columns": ["id", "name"], "append": [{"type": "fixed", "values": [["2", "b"], ["1", "a"]]}], "drop_duplicates": ["id"]}}}
    assert rows(normalize(spark, Project.of(spec), given=given).tables["s"], "id", "name") == [("1", "a"), ("2", "b")]


def test_workflow(spark, raw):
    spec = {**SAMPLES, "options": {"mappings": {"site": {"local_key": "name", "remote_key": "site_id", "mapping": {"north": 77}}}, "finally": {"drop": ["kind"]}}}
    seen = {}
    result = workflow(spark, Project.of(spec), seen.update, translations={"code": "sample_code"}, drop_keys=True, given={"raw": raw})
    assert "kind" not in seen
    assert rows(result.tables["site"], "name", "site_id") == [("north", 77), ("south", None)]
    assert "sample_code" in seen["sample"].columns
    assert duplicate_keys(seen["measure"], ["sample_code"]).count() == 1


def test_specifications():
    assert specifications.check_project(Project.of(SAMPLES | {"entities": {k: v for k, v in SAMPLES["entities"].items() if k in ("site", "kind")}})) == []
    bad = {
        "metadata": {"type": "x"},
        "entities": {
            "f": {"type": "fixed", "columns": ["system_id", "a"], "values": [[1, "x"], [1, "y"], [None, "z"]], "public_id": "f"},
            "g": {"type": "sql", "query": "select 1", "columns": ["a"], "filters": [{"type": "query", "query": "b > 1"}, {"type": "nope"}], "extra_columns": {"a": 1, "c": "=nope(a)"}},
            "h": {"source": "gone", "columns": ["a"], "foreign_keys": [{"entity": "f", "local_keys": ["q"], "remote_keys": ["r"]}], "append": [{"source": "x", "values": []}]},
            "m": {"type": "merged", "branches": [{"source": "f"}, {"source": "f"}]},
        },
    }
    found = {(i.entity, i.code) for i in specifications.check_project(Project.of(bad), "project")}
    assert {("", "METADATA_TYPE"), ("f", "SYSTEM_ID_NULL"), ("f", "SYSTEM_ID_NOT_UNIQUE"), ("f", "PUBLIC_ID"), ("g", "BY_TYPE"), ("g", "FILTERS"), ("g", "EXTRA_COLUMNS")} <= found
    assert {("h", "REFERENCES"), ("h", "FOREIGN_KEYS"), ("h", "APPEND"), ("m", "BY_TYPE")} <= found


def test_validators(spark, raw):
    project = Project.of(SAMPLES)
    tables = {"site": spark.createDataFrame([(1, 5)], "system_id long, name long"), "sample": raw, "kind": raw.limit(0)}
    found = {(i.entity, i.code) for i in validators.validate(project, tables)}
    assert found == {("sample", "NON_UNIQUE_KEYS"), ("sample", "EXTRA_COLUMN_UNRESOLVED"), ("sample", "FK_TYPE_MISMATCH"), ("kind", "COLUMN_NOT_FOUND"), ("kind", "EMPTY_RESULT")}
    assert rows(validators.orphans(raw, ["site"], spark.createDataFrame([("north",)], "s string"), ["s"])) == [("south",), ("west",)]
    fixed = validators.apply_fixes(project, [validators.Issue("COLUMN_NOT_FOUND", "sample", "", column="site"), validators.Issue("NON_UNIQUE_KEYS", "kind", "")])
    assert fixed.entities["sample"].columns == ("code",)
    assert fixed.entities["kind"].drop_duplicates == ["what"]


MODEL = {
    "model": {"name": "m", "version": 1}, "naming": {"public_id_suffix": "_id"},
    "entities": {
        "site": {"required": True, "public_id": "site_id", "columns": {"name": {"required": True}, "lat": {"required": True}}, "foreign_keys": [{"entity": "place", "required": True, "via": "site_place"}]},
        "sample": {"public_id": "samp_id", "foreign_keys": [{"entity": "method", "required": True}, {"entity": "site", "required": True}]},
        "method": {"foreign_keys": [{"entity": "group", "required": True}]}, "group": {}, "place": {}, "site_place": {"role": "bridge"}, "kind": {"role": "classifier"}, "must": {"required": True},
    },
}


def test_conformance():
    model = conformance.TargetModel.of(MODEL)
    found = {(i.entity, i.code) for i in conformance.conformance(model, Project.of(SAMPLES))}
    assert found == {
        ("site", "MISSING_REQUIRED_COLUMN"), ("site", "MISSING_BRIDGE_ENTITY"), ("sample", "UNEXPECTED_PUBLIC_ID"), ("sample", "MISSING_REQUIRED_FOREIGN_KEY_TARGET"),
        ("must", "MISSING_REQUIRED_ENTITY"), ("method", "MISSING_INDUCED_REQUIRED_ENTITY"), ("group", "MISSING_INDUCED_REQUIRED_ENTITY"),
    }
    assert conformance.check_model(model) == []
    assert set(conformance.scaffold(model, entities=["sample"])["entities"]) == {"site", "must", "sample", "method", "group", "place", "site_place"}
    assert "## site" in conformance.documentation(model)
    assert "<h2>site</h2>" in conformance.documentation(model, "html")
    assert conformance.compare_models(model, model, Project.of(SAMPLES))["only_first"] == []


def test_model_documentation_as_a_workbook(spark, tmp_path):
    model = conformance.TargetModel.of(MODEL)
    writers.write("xlsx", str(tmp_path / "model.xlsx"), conformance.documentation_tables(spark, model))
    book = files.Workbook(str(tmp_path / "model.xlsx"))
    assert {s: len(list(book.rows(s))) - 1 for s in book.sheets} == {"columns": 2, "entities": 8, "links": 4}
    assert ["site", "place", "site_place", True] in [list(r.values()) for _, r in book.rows("links")]


def test_directives(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "part.yml").write_text("a: [x, y]\nmore: '@include: deeper.yml'\n")
    (tmp_path / "sub" / "deeper.yml").write_text("n: 5\n")
    (tmp_path / "v.csv").write_text("id,name\n1,one\n")
    (tmp_path / "p.yml").write_text(
        "metadata: {name: p}\npart: '@include: sub/part.yml'\nrows: '@load: v.csv'\nboth: '@value: part.a + @value: part.a'\nn: '@value: part.more.n'\nlist: [z, '@value: part.a']\n"
        "home: ${HOME_X:-none}/${SET_X}\njoined: !join [a, 1]\nother: !unknown {k: 1}\n"
    )
    out = directives.resolve(directives.read_yaml(tmp_path / "p.yml"), tmp_path, environment={"SET_X": "s", "APP_METADATA_NAME": "q"}, env_prefix="APP")
    assert out == {
        "metadata": {"name": "q"}, "part": {"a": ["x", "y"], "more": {"n": 5}}, "rows": [{"id": "1", "name": "one"}], "both": ["x", "y", "x", "y"], "n": 5, "list": ["z", "x", "y"],
        "home": "none/s", "joined": "a1", "other": {"k": 1},
    }
    assert directives.lookup(out, "nope.x,part.more.n") == 5
    assert directives.check_directives({"a": "@value: b.c", "d": "@include: gone.yml"}, tmp_path) == ["a: nothing at b.c", "d: no file gone.yml"]
    with pytest.raises(ProjectError):
        directives.resolve({"a": "@value: gone"}, tmp_path, strict=True)
    assert directives.managed_path("x.csv", "local", "/p", "/g") == "/p/x.csv"


def test_file_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Größe (cm)\tb\n1\tx\n")
    e = Entity.of("t", {"type": "tsv", "options": {"filename": str(tmp_path / "t.tsv")}})
    assert registry.read_source(spark, Project("p", {}), e, {}).columns == ["groe_cm", "b"]
    path = str(tmp_path / "b.xlsx")
    writers.write("openpyxl", path, {"one": spark.createDataFrame([(1, "a&b", True, 2.5, None)], "i long, s string, t boolean, x double, n string"), "two": spark.range(3)})
    assert files.workbook_metadata(path) == {"one": ["i", "s", "t", "x", "n"], "two": ["id"]}
    read = lambda **o: registry.read_source(spark, Project("p", {}), Entity.of("x", {"type": "xlsx", "source": "one", "options": {"filename": path, **o}}), {})
    assert rows(read()) == [(1, "a&b", True, 2.5, None)]
    assert rows(read(range="A1:B2", header=False)) == [("1", "a&b"), ("i", "s")]
    assert read(range="A:B", header=["p", "q"]).columns == ["p", "q"]
    spark.dataSource.register(files.WorkbookSource)
    assert rows(spark.read.format("workbook").option("path", path).option("sheet", "two").load()) == [(1, ["sid"]), (2, ["i0"]), (3, ["i1"]), (4, ["i2"])]
    with pytest.raises(registry.SourceError):
        read(sheet_name="gone")


def test_fixed_values(spark):
    read = lambda **s: registry.read_source(spark, Project("p", {}), Entity.of("x", {"type": "fixed", **s}), {})
    assert rows(read(columns=["a"], values=[1, 2])) == [(1,), (2,)]
    assert rows(read(columns=["a", "b"], values=[{"b": 1}, {"a": "x", "b": 2.5}]), "a", "b") == sorted([(None, 1.0), ("x", 2.5)], key=repr)
    assert read(keys=["k"], columns=["a"], values=[[1, "k", "a"]]).columns == ["system_id", "k", "a"]
    assert read(columns=["a"], values=[]).count() == 0
    with pytest.raises(registry.SourceError):
        read(columns=["a", "b"], values=[[1], [1, 2]])


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    writers.write("db", path, {"t": spark.range(10).selectExpr("id", "cast(id as string) s", "id / 2 x"), "u": spark.range(2)})
    assert relational.read_table(spark, "sqlite", {"filename": path, "numPartitions": 3}, "t").count() == 10
    assert relational.read_table(spark, "sqlite", {"filename": path}, "t", 2, 5).count() == 2
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE child (id INTEGER PRIMARY KEY, t_id INTEGER REFERENCES t(id))")
    info = relational.sqlite_tables(path, True)
    assert info["t"].row_count == 10
    assert info["child"].foreign_keys == (("t_id", "t", "id"),)
    e = {"type": "sql", "data_source": "d", "query": "SELECT id, s FROM t WHERE id > 7;", "columns": ["k", "v"], "auto_detect_columns": False}
    project = Project.of({"options": {"data_sources": {"d": {"driver": "sqlite", "options": {"database": path}}}}, "entities": {"e": e}})
    assert rows(normalize(spark, project).tables["e"], "k", "v") == [(8, "8"), (9, "9")]
    with pytest.raises(registry.SourceError, match="no column"):
        normalize(spark, project.with_entity("e", {**e, "auto_detect_columns": True}))
    assert registry.test_connection(spark, "sqlite", {"filename": path}, Entity.of("t", {"query": "SELECT * FROM u"}))["success"]
    assert not registry.test_connection(spark, "sqlite", {"filename": path}, Entity.of("t", {"query": "SELECT * FROM gone"}))["success"]
    assert analysis.entity_from_table(info["child"], "d")["foreign_keys"] == [{"entity": "t", "local_keys": ["t_id"], "remote_keys": ["id"]}]
    assert relational.jdbc_options("postgresql", {"host": "h", "dbname": "d", "user": "u"})["url"] == "jdbc:postgresql://h:5432/d"


def test_sinks(spark, tmp_path):
    tables = {"a": spark.createDataFrame([(1, 'x "y"'), (2, None)], "i long, s string"), "b": spark.range(3)}
    writers.write("csv", str(tmp_path / "csv"), tables)
    assert spark.read.csv(str(tmp_path / "csv" / "a"), header=True, escape='"').count() == 2
    writers.write("zipcsv", str(tmp_path / "x.zip"), tables)
    writers.write("single_csv", str(tmp_path / "one"), tables)
    assert (tmp_path / "one" / "a.csv").read_text().splitlines()[1] == '1,"x ""y"""'
    writers.write("parquet", str(tmp_path / "pq"), tables)
    assert open(writers.write_table_shapes(str(tmp_path), tables)).read() == "entity\tnum_rows\tnum_columns\na\t2\t2\nb\t3\t1\n"
    found = writers.table_shapes(spark, tables)
    assert writers.shape_differences(found, found).count() == 0
    assert writers.shape_differences(found, found.where("entity = 'a'")).count() == 1
    assert writers.insert_statements("t", tables["a"]).endswith("(1, 'x \"y\"'),\n(2, NULL);")
    assert writers.timestamped("/x/a.zip", datetime.datetime(2024, 1, 2, 3, 4, 5)) == "/x/a-20240102-030405.zip"
    with pytest.raises(ValueError, match="one sheet|would be sheet"):
        writers.write("xlsx", str(tmp_path / "y.xlsx"), {"x" * 40: tables["b"], "x" * 35: tables["b"]})


def test_services(spark, raw, tmp_path):
    raw.createOrReplaceTempView("raw_view")
    assert analysis.check_query(spark, "WITH c AS (SELECT * FROM raw_view) SELECT code FROM c JOIN db.other o ON true")["tables"] == ["db.other", "raw_view"]
    for bad in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "SELEC x FROM y", "", "CREATE VIEW v AS SELECT 1", "SHOW TABLES"):
        assert not analysis.check_query(spark, bad)["is_valid"], bad
    out = analysis.run_query(spark, "SELECT code, ph FROM raw_view ORDER BY code", limit=2)
    assert out["truncated"]
    assert out["rows"][0] == {"code": "s1", "ph": 7.1}
    assert analysis.query_columns(spark, "SELECT ph FROM raw_view")[0]["type"] == "double"
    project = Project.of(SAMPLES)
    previews = analysis.Previews(spark)
    first = previews.preview(project, "sample", 2, given={"raw": raw})
    assert [r.system_id for r in first.collect()] == [1, 2]
    assert previews.table(project, "sample", {"raw": raw}) is previews.table(project, "sample", {"raw": raw})
    assert previews.preview(project, "site", override={"values": [["x"]]}).count() == 1
    info = {c["name"]: c for c in analysis.column_info(project, "sample", previews.table(project, "sample", {"raw": raw}))}
    assert info["code"]["is_key"]
    assert info["label"]["is_derived"]
    assert info["site_id"]["nullable"]
    result = normalize(spark, project, ["sample"], {"raw": raw})
    assert analysis.test_foreign_key(project, result, "sample", 0)["unmatched_rows"] == 1
    frozen = analysis.materialize_entity(project, "sample", result.tables["sample"], str(tmp_path / "s.parquet"))
    assert normalize(spark, frozen, ["sample"]).tables["sample"].count() == 3
    assert analysis.unmaterialize_entity(frozen, "sample").entities["sample"].raw == project.entities["sample"].raw
    graph = analysis.dependency_graph(project)
    assert graph["order"].index("site") < graph["order"].index("sample") < graph["order"].index("measure")
    assert analysis.available_columns(project, "sample")["foreign_key"] == ["site_id"]


def test_suggestions():
    schemas = {
        "order": relational.TableInfo("order", (relational.ColumnInfo("customer_id", "integer"), relational.ColumnInfo("code", "text"))),
        "customers": relational.TableInfo("customers", (relational.ColumnInfo("id", "bigint", False, True), relational.ColumnInfo("code", "integer"))),
    }
    out = analysis.suggest_foreign_keys("order", ["customer_id", "code"], {"customers": ["id", "code"], "order": ["code"]}, schemas)
    assert [(s["local_keys"], s["remote_keys"], s["confidence"]) for s in out] == [(["customer_id"], ["id"], 0.75), (["code"], ["code"], 0.5)]
    assert [analysis.suggest_type(t)[0] for t in ("VARCHAR(20)", "numeric(5,2)", "timestamp with time zone", "integer[]", "odd")] == ["string", "float", "datetime", "json", "string"]


def sample_submission(spark):
    columns = [
        {"table_name": "tbl_main", "column_name": "main_id", "data_type": "integer", "is_pk": True, "class_name": "java.lang.Integer"},
        {"table_name": "tbl_main", "column_name": "lookup_id", "data_type": "integer", "is_fk": True, "fk_table_name": "tbl_lookup", "class_name": "com.x.Lookup", "is_nullable": False},
        {"table_name": "tbl_main", "column_name": "description", "class_name": "java.lang.String"},
        {"table_name": "tbl_main", "column_name": "date_updated", "class_name": "java.util.Date"},
        {"table_name": "tbl_lookup", "column_name": "lookup_id", "data_type": "integer", "is_pk": True, "class_name": "java.lang.Integer"},
        {"table_name": "tbl_lookup", "column_name": "name", "class_name": "java.lang.String"},
    ]
    tables = [{"table_name": "tbl_main", "pk_name": "main_id", "java_class": "TblMain"}, {"table_name": "tbl_lookup", "pk_name": "lookup_id", "java_class": "TblLookup", "is_lookup": True}]
    main = spark.createDataFrame([(1, 1, 'a "q"'), (2, 9, None), (3, 1, "c")], "system_id long, lookup_id long, description string")
    lookup = spark.createDataFrame([(1, 50, "one")], "system_id long, lookup_id long, name string")
    return submission.Submission(submission.Schema.of(tables, columns), {"tbl_main": main, "tbl_lookup": lookup})


def test_ingest(spark, tmp_path):
    s, issues, eav = submission.ingest(spark, sample_submission(spark), {"drop_ignored_columns": {"columns": ["date_*"]}}, str(tmp_path / "eav"))
    assert issues == []
    assert rows(s.tables["tbl_lookup"], "system_id", "lookup_id") == [(1, 50), (9, 9)]
    values = rows(eav.recordvalues.where("system_id = '1'"), "column_name", "fk_system_id", "fk_public_id", "column_value")
    assert values == sorted([("clonedId", "NULL", "NULL", "NULL"), ("description", "NULL", "NULL", '"a ""q"""'), ("lookupId", "1", "50", "NULL"), ("mainId", "NULL", "NULL", "")], key=repr)
    assert rows(eav.records, "class_name", "system_id", "public_id") == sorted([("TblLookup", "1", "50"), ("TblLookup", "9", "9"), *[("TblMain", str(i), "NULL") for i in (1, 2, 3)]], key=repr)
    assert ("TblMain", "dateUpdated", "java.util.Date") in rows(eav.columns, "table_type", "column_name", "column_type")
    assert rows(eav.tables) == [("TblLookup", "2"), ("TblMain", "3")]
    assert spark.read.csv(str(tmp_path / "eav" / "recordvalues"), sep="\t", header=True).count() == 12


def test_submission_checks(spark):
    s = sample_submission(spark)
    s.tables["tbl_main"] = spark.createDataFrame([(1, None, "x"), (1, "5", "y"), (None, "5", "z")], "system_id long, lookup_id string, description string")
    codes = {i.code for i in submission.check_submission(s)}
    assert codes == {"NO_PRIMARY_KEY", "COLUMN_TYPE", "SYSTEM_ID_NULL", "SYSTEM_ID_NOT_UNIQUE", "NULL_VALUES"}
    fresh = sample_submission(spark)
    del fresh.tables["tbl_lookup"]
    submission.apply_policies(fresh, {"add_primary_key_column_if_missing": {"disabled": True}, "update_missing_foreign_key": {"tbl_main": {"method": 4}}})
    assert rows(fresh.tables["tbl_lookup"]) == [(1, 1), (9, 9)]
    assert "main_id" not in fresh.tables["tbl_main"].columns
    assert {r.method for r in fresh.tables["tbl_main"].collect()} == {4}


def test_reconciliation(spark):
    df = spark.createDataFrame([("Betula pendula", "tree"), ("betula pendulla", None), (" ", "x"), (None, "y"), ("Quercus", "tree")], "taxon string, kind string")
    asked = reconcile.queries(df, "taxon", {"type": "kind", "gone": "gone"})
    assert {r.query: r.properties for r in asked.collect()} == {"Betula pendula": {"type": "tree"}, "betula pendulla": {"type": ""}, "Quercus": {"type": "tree"}}
    targets = spark.createDataFrame([("http://t/11", "Betula pendula"), ("http://t/12/", "Betula nana"), ("http://t/x", "Salix")], "uri string, name string")
    found = reconcile.classify(asked, reconcile.local_scores(asked, targets, "uri", "name"))  # by the default threshold
    got = {r.source_value: (r.target_id, r.status) for r in found.collect()}
    assert got == {"Betula pendula": (11, "accepted"), "betula pendulla": (11, "review"), "Quercus": (None, "unmatched")}
    mapping = found.withColumn("notes", found.status).select(*reconcile.MAPPING)
    assert rows(reconcile.apply_mapping(df, "taxon", mapping, "taxon_id"), "taxon_id") == sorted([(11,), (11,), (None,), (None,), (None,)], key=repr)
    changed = reconcile.mark_unmatched(mapping, ["Betula pendula"])
    assert {r.source_value: r.target_id for r in changed.collect()}["Betula pendula"] is None
    assert reconcile.delete(changed, ["Quercus"]).count() == 2


def test_streams(spark, raw, tmp_path):
    raw.write.parquet(str(tmp_path / "in"))
    e = Entity.of("m", {k: v for k, v in SAMPLES["entities"]["measure"].items() if k != "foreign_keys"})
    q = steps.apply_entity(steps.read_stream(spark, str(tmp_path / "in"), raw.schema), e).writeStream.format("memory").queryName("stream_out").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("stream_out")) == rows(steps.apply_entity(raw, e))
    with pytest.raises(steps.StreamError):
        steps.apply_entity(raw, Entity.of("x", {"drop_duplicates": True}))
