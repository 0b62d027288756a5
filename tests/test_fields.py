"""Field checks and the configuration checks of SQL columns."""

from tessera.config.project import Entity, Project
from tessera.quality.fields import FIELD_CHECKS, check_fields
from tessera.quality.specifications import CHECKS

ENTITIES = {
    "site": {"source": "raw", "keys": ["code"], "columns": ["code", "name"], "public_id": "site_id", "options": {"sep": ";"}, "type": "csv", "note": " "},
    "sample": {"source": "site", "keys": ["code", "place"], "columns": ["code"], "public_id": "sample", "columns_from": "@value: x", "label": "name", "empty": []},
}


def failing(check, field, **options):
    return {i.entity for i in check_fields(ENTITIES, [{"check": check, "field": field, **options}])}


def test_each_field_check():
    assert failing("exists", "options.sep") == {"sample"}
    assert failing("is_absent", "options.sep") == {"site"}
    assert failing("is_empty", "empty") == set()
    assert failing("is_empty", "keys") == {"site", "sample"}
    assert failing("is_string_list", "keys") == set()
    assert failing("is_string_list", "columns_from") == {"site"}
    assert failing("not_empty_string", "note") == {"site", "sample"}
    assert failing("not_empty", "label") == {"site"}
    assert failing("of_type", "type", types=(str, None)) == set()
    assert failing("of_type", "type", types=(str,)) == {"sample"}
    assert failing("is_existing_entity", "source") == {"site"}
    assert failing("ends_with_id", "public_id") == {"sample"}
    assert failing("is_of_categorical_values", "type", values=["fixed"]) == {"site"}
    assert failing("is_in_columns", "label") == {"sample"}
    assert failing("has_value", "type", expected="csv") == {"sample"}
    assert failing("keys_subset_of_columns", "keys") == {"sample"}
    assert len(FIELD_CHECKS) == 13


def test_issues_name_field_and_severity():
    (issue,) = check_fields(ENTITIES, [{"check": "exists", "field": "options.sep", "severity": "warning"}])
    assert (issue.code, issue.entity, issue.severity, issue.column) == ("EXISTS", "sample", "warning", "options.sep")


def test_sql_columns():
    check = lambda **spec: CHECKS["sql_columns"](Project.of({"entities": {}}), Entity.of("q", {"type": "sql", "query": "SELECT 1", "data_source": "d", **spec}))
    assert check(columns=["a", "b"], keys=["a"]) == []
    assert check(columns=["a", "a"]) == ["columns repeat a name"]
    assert check(auto_detect_columns=False) == ["no columns are named, and none are detected"]
    assert check(columns=["a"], keys=["k"], auto_detect_columns=False) == ["keys k are not among the named columns"]


def test_suggested_fixes():
    from tessera.quality.validators import Issue, apply_fixes, preview_fixes

    project = Project.of({"entities": {"a": {"source": "x", "keys": ["k"], "columns": ["gone", "b"]}, "f": {"type": "fixed", "columns": ["system_id", "v"], "values": [[None, "p"], [1, "q"], [1, "r"]]}}})
    issues = [Issue("COLUMN_NOT_FOUND", "a", "", column="gone"), Issue("FK_LOCAL_COLUMN_MISSING", "a", "", column="c"), Issue("NON_UNIQUE_KEYS", "a", ""), Issue("SYSTEM_ID_DUPLICATE_VALUES", "f", ""), Issue("SYSTEM_ID_NULL_VALUES", "a", ""), Issue("EXTRA_COLUMN_UNRESOLVED", "a", "", column="d"), Issue("UNHEARD_OF", "a", "")]
    seen = preview_fixes(project, issues)
    assert [s["automatic"] for s in seen] == [True, True, True, True, False, False]
    assert seen[1]["changes"] == {"columns": {"before": ["gone", "b"], "after": ["gone", "b", "c"]}}
    assert seen[4]["changes"] == {}
    fixed = apply_fixes(project, issues).entities
    assert fixed["a"].raw["columns"] == ["b", "c"]
    assert fixed["a"].raw["drop_duplicates"] == ["k"]
    assert fixed["f"].raw["values"] == [[1, "p"], [2, "q"], [3, "r"]]


def test_materialized_entities():
    from tessera.quality.specifications import check_project

    def found(**spec):
        project = Project.of({"entities": {"a": {"columns": ["v"], **spec}}})
        return {(i.code, i.severity, i.message.split(":")[0]) for i in check_project(project) if i.code.startswith("MATERIALIZED")}

    whole = {"enabled": True, "source_state": {"source": "x"}, "materialized_at": "2024-01-01"}
    assert found(type="fixed", values=[[1]], materialized=whole) == set()
    assert found(type="csv", materialized={"enabled": False}) == set()
    assert {m for _, _, m in found(type="csv", options={"filename": "x"}, materialized={"enabled": True})} == {"a materialized entity is of type fixed, not csv", "a materialized entity has its values, or a file of them", "a materialized entity keeps its former configuration in materialized.source_state", "MATERIALIZED_AT_MISSING"}
    assert found(type="fixed", values=[[1]], materialized={"enabled": True, "source_state": {"source": "x"}}) == {("MATERIALIZED_AT_MISSING", "warning", "MATERIALIZED_AT_MISSING")}
