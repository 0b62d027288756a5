"""Links, constraints, reshaping, duplicates, ids, filters."""

import pytest

from tessera.config.project import Entity, ForeignKey, ProjectError, Unnest
from tessera.operators import extra_columns, filters, identity, link, reshape, subset


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


@pytest.fixture(scope="module")
def local(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "i long, k string")


@pytest.fixture(scope="module")
def remote(spark):
    return link.Remote("kind", spark.createDataFrame([(10, "a", "A"), (20, "b", "B"), (30, None, "N"), (40, "c", "C")], "system_id long, k string, name string"), "system_id", "kind_id")


def fk(**more):
    return ForeignKey.of({"entity": "kind", "local_keys": ["k"], "remote_keys": ["k"], **more})


def test_lookup_ignores_nulls(local, remote):
    out, _ = link.link(local, fk(how="left", extra_columns=["name"]), remote)
    assert rows(out, "i", "kind_id", "name") == [(1, 10, "A"), (2, 20, "B"), (3, None, None), (4, None, None)]


def test_plain_link_matches_nulls(local, remote):
    assert rows(link.link(local, fk(), remote)[0], "i", "kind_id") == [(1, 10), (2, 20), (3, 30)]


def test_null_policy_said_so(local, remote):
    assert rows(link.link(local, fk(constraints={"allow_null_keys": True}), remote)[0], "i") == [(1,), (2,)]


@pytest.mark.parametrize(("how", "n"), [("inner", 3), ("left", 4), ("right", 4), ("outer", 6)])
def test_joins(local, remote, how, n):
    out, _ = link.link(local, fk(how=how), remote)
    assert out.count() == (n if how != "outer" else 5)
    if how in ("right", "outer"):
        assert ("c", 40) in rows(out, "k", "kind_id")


def test_cross(local, remote):
    assert link.link(local, ForeignKey.of({"entity": "kind", "how": "cross"}), remote)[0].count() == 16


def test_drop_remote_id_and_clash(local, remote):
    out, _ = link.link(local.withColumnRenamed("i", "name"), fk(how="left", extra_columns=["name"], drop_remote_id=True), remote)
    assert out.columns == ["name", "k", "name_kind"]


def test_linked_already(local):
    assert link.is_linked(local.withColumnRenamed("i", "kind_id"), fk(), "kind_id")
    assert link.is_linked(local, fk(extra_columns=["i"]), "kind_id")
    assert not link.is_linked(local, fk(), "kind_id")


@pytest.mark.parametrize(
    ("constraints", "how", "code"),
    [
        ({"allow_null_keys": False}, "inner", "NULL_KEYS"),
        ({"require_unique_left": True, "allow_null_keys": True}, "left", None),
        ({"cardinality": "one_to_one", "allow_null_keys": True}, "inner", "NOT_ONE_TO_ONE"),
        ({"cardinality": "many_to_one", "allow_null_keys": True}, "left", None),
        ({"cardinality": "one_to_many", "allow_null_keys": True}, "inner", "NOT_ONE_TO_MANY"),
        ({"allow_row_decrease": False, "allow_null_keys": True}, "inner", "ROWS_LOST"),
        ({"allow_unmatched_left": False}, "left", "UNMATCHED_LEFT"),
        ({"allow_unmatched_right": False, "allow_null_keys": True}, "outer", "UNMATCHED_RIGHT"),
        ({"cardinality": "many_to_many", "allow_null_keys": True}, "inner", None),
    ],
)
def test_constraints(local, remote, constraints, how, code):
    key = fk(how=how, constraints=constraints)
    if code is None:
        link.link(local, key, remote)
        return
    with pytest.raises(link.ConstraintViolation) as e:
        link.link(local, key, remote)
    assert e.value.code == code
    out, report = link.link(local, key, remote, mode="warn")
    assert report.violations[0][0] == code
    assert link.link(local, key, remote, mode="off")[1] is None


def test_unique_right(local, spark):
    twice = link.Remote("kind", spark.createDataFrame([(1, "a"), (2, "a")], "system_id long, k string"), "system_id", "kind_id")
    with pytest.raises(link.ConstraintViolation, match="repeat"):
        link.link(local.where("k is not null"), fk(how="left", constraints={"require_unique_right": True}), twice)


def test_bad_links(local, remote):
    with pytest.raises(link.LinkError, match="no column"):
        link.link(local.drop("k"), fk(), remote)
    with pytest.raises(ProjectError):
        ForeignKey.of({"entity": "x", "local_keys": ["a"], "remote_keys": ["a", "b"]})


def test_join_stats(local, remote):
    s = link.join_stats(local, fk(), remote)
    assert (s["total_rows"], s["matched_rows"], s["null_key_rows"], s["cardinality"]) == (4, 2, 1, "one_to_one")
    assert [r["i"] for r in s["unmatched_sample"]] == [3, 4]


def test_unnest(spark):
    df = spark.createDataFrame([(1, 2, "x", 9), (2, None, "y", 9)], "id long, a long, b string, lost long")
    spec = Unnest.of({"id_vars": ["id"], "value_vars": ["a", "b"], "var_name": "what", "value_name": "value"})
    out = reshape.unnest(df, spec)
    assert rows(out) == [(1, "a", "2"), (1, "b", "x"), (2, "a", None), (2, "b", "y")]
    assert reshape.unnest(out, spec) is out
    with pytest.raises(reshape.ReshapeError):
        reshape.unnest(df.drop("a"), spec)


def test_union_of_unlike_types(spark):
    out = reshape.union([spark.createDataFrame([(1, "a")], "x long, y string"), spark.createDataFrame([("b", 2.5)], "x string, z double"), spark.sql("select null x")])
    assert rows(out) == sorted([("1", "a", None), ("b", None, 2.5), (None, None, None)], key=repr)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, None, "a"), (3, "k", "c"), (3, "k", "c")], "i long, k string, v string")
    assert rows(subset.drop_duplicates(df, ["k"], ["i"]), "i", "v") == [(1, "b"), (3, "c")]
    assert subset.drop_duplicates(df, True).count() == 3
    assert subset.drop_duplicates(df, ["nope"]).count() == 4
    with pytest.raises(subset.FunctionalDependencyError):
        subset.check_fd(df, ["k"])
    assert subset.check_fd(df, ["i"]) == []
    assert subset.check_fd(df, ["k"], strict=False) == [(None,)]


def test_empty_rows(spark):
    df = spark.createDataFrame([(1, "", None), (2, "", "x"), (3, "-", None)], "i long, a string, b string")
    assert rows(subset.drop_empty_rows(df, ["a", "b"])) == [(2, None, "x"), (3, "-", None)]
    assert rows(subset.drop_empty_rows(df, {"a": ["", "-"], "b": []}), "i") == [(2,)]
    assert subset.drop_empty_rows(df, False) is df


def test_ids(spark):
    df = spark.range(1000).selectExpr("999 - id k").repartition(9)
    out = identity.add_system_id(df, ["k"])
    assert out.columns == ["system_id", "k"]
    assert all(r.system_id == r.k + 1 for r in out.collect())
    half = spark.createDataFrame([(5, "a"), (None, "b"), (None, "c")], "system_id long, k string")
    assert rows(identity.add_system_id(half, ["k"])) == [(5, "a"), (6, "b"), (7, "c")]
    assert identity.canonical_order(["b", "x_id", "system_id", "a", "p_id", "e"], "system_id", "p_id", ["x_id"], ["e"]) == ["system_id", "p_id", "x_id", "e", "a", "b"]


def test_extra_columns(spark):
    df = spark.createDataFrame([("n", 2.0)], "Name string, x double")
    out, late = extra_columns.add_extra_columns(df, {"a": 1, "b": "==x", "c": "name", "d": "{x}!", "e": "=upper(Name)", "f": "other", "g": "=concat(h, 'x')", "Name": "kept", "h": "{e}"}, True)
    r = out.first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.Name) == (1, "=x", "n", "2!", "N", "other", "Nx", "N", "n")
    assert late == {}
    _, late = extra_columns.add_extra_columns(df, {"z": "=upper(gone)"}, True)
    assert late == {"z": "=upper(gone)"}
    with pytest.raises(extra_columns.MissingColumns):
        extra_columns.add_extra_columns(df, {"z": "{gone}"})


def test_filters(spark, local):
    other = {"o": spark.createDataFrame([("a",), (None,)], "kk string")}
    spec = [{"type": "exists_in", "column": "k", "other_entity": "o", "other_column": "kk"}, {"type": "query", "query": "i > 1", "stage": "after_link"}, {"type": "query", "query": " "}]
    assert rows(filters.apply_filters(local, spec, other), "i") == [(1,), (3,)]
    assert rows(filters.apply_filters(local, spec, other, "after_link"), "i") == [(2,), (3,), (4,)]
    for bad in ({"type": "nope"}, {"type": "query", "query": "q > 1"}, {"type": "query", "stage": "x"}, {"type": "exists_in", "column": "k", "other_entity": "gone"}):
        with pytest.raises(filters.FilterError):
            filters.apply_filters(local, [bad], other)


def test_projection(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, system_id long")
    assert subset.select_columns(df, ["b", "x", "a", "b"]).columns == ["b", "a"]
    assert subset.select_columns(df, ["p_id"], aliases={"p_id": "system_id"}).first().p_id == 3
    with pytest.raises(subset.SubsetError):
        subset.select_columns(df, ["x"], True)
    assert subset.translate_columns(df, {"a": "b", "b": "c", "system_id": "c"}).columns == ["a", "c", "system_id"]
    assert subset.rename_last(["a", "b", "a"], "a", "z") == ["a", "b", "z"]


def test_merged(spark):
    e = Entity.of("m", {"type": "merged", "public_id": "m_id", "branches": [{"source": "p"}, {"name": "second", "source": "q"}]})
    p, q = spark.createDataFrame([(1, "x")], "system_id long, v string"), spark.createDataFrame([(7, 2.5)], "system_id long, w double")
    out = reshape.merged(e, {"p": p, "q": q}, {"q": Entity.of("q", {"public_id": "quu_id"})})
    assert rows(out, "m_branch", "v", "w", "p_id", "quu_id") == sorted([("p", "x", None, 1, None), ("second", None, 2.5, None, 7)], key=repr)
