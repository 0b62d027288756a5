"""Counts behind constraints and checks: right under skew and nulls, and taken by one job."""

import random
from itertools import product

import pytest

from tessera.config.project import ForeignKey, Project
from tessera.functions.replace import apply_replacements
from tessera.operators import link as links
from tessera.operators.identity import add_system_id
from tessera.operators.link import ConstraintViolation, Remote, key_counts, link
from tessera.plans.pipeline import normalize
from tessera.quality.validators import validate




def brute(left, right, how, nulls):
    same = lambda a, b: (a == b and None not in a) or (nulls and a == b)
    pairs = sum(same(a, b) for a, b in product(left, right))
    lost = sum(not any(same(a, b) for b in right) for a in left)
    unused = sum(not any(same(a, b) for a in left) for b in right)
    a, b = (lost if how in ("left", "outer") else 0), (unused if how in ("right", "outer") else 0)
    whole = lambda rows: [r for r in rows if None not in r]
    return {
        "left_rows": len(left), "left_nulls": len(left) - len(whole(left)), "left_repeats": len(whole(left)) - len(set(whole(left))),
        "right_rows": len(right), "right_nulls": len(right) - len(whole(right)), "right_repeats": len(whole(right)) - len(set(whole(right))),
        "lost": lost, "unused": unused, "left_only": a, "right_only": b, "rows": pairs + a + b,
    }


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_counts_of_links(spark, how):
    rng = random.Random(how)
    pick = lambda n: [(rng.choice([None, 1, 2, 3, 4]), rng.choice(["a", "b", None])) for _ in range(n)]
    for left, right in [(pick(40), pick(30)), (pick(10), []), ([], pick(10)), ([(1, "a")] * 300, [(1, "a")] * 200)]:
        a, b = spark.createDataFrame(left, "k int, ln string"), spark.createDataFrame(right, "__left int, rn string")
        fk = ForeignKey.of({"entity": "other", "local_keys": ["k", "ln"], "remote_keys": ["__left", "rn"], "how": how})
        remote = Remote("other", b.selectExpr("*", "1 AS system_id"))
        for nulls in (True, False):
            assert key_counts([(a, fk, remote)], nulls)[0] == brute(left, right, how, nulls)


def test_counts_make_no_rows_of_the_link(spark):
    """A key with 60,000 rows on both sides would link to 3.6 billion."""
    fk = ForeignKey.of({"entity": "other", "local_keys": ["k"], "remote_keys": ["k"], "how": "inner", "constraints": {"cardinality": "many_to_one"}})
    many = spark.range(60_000).selectExpr("1 AS k", "id AS system_id")
    report = link(many.select("k"), fk, Remote("other", many), "warn")[1]
    assert report.counts["rows"] == 3_600_000_000
    assert {c for c, _ in report.violations} == {"NOT_UNIQUE_RIGHT", "NOT_MANY_TO_ONE"}


SPEC = {
    "a": {"source": "ra", "public_id": "a_id", "keys": ["x"], "columns": ["y"]},
    "b": {"source": "rb", "public_id": "b_id", "keys": ["y"]},
    "c": {
        "source": "rc", "keys": ["n"], "columns": ["x", "y"],
        "foreign_keys": [
            {"entity": "a", "local_keys": ["x"], "remote_keys": ["x"], "how": "left", "constraints": {"cardinality": "many_to_one"}},
            {"entity": "b", "local_keys": ["y"], "remote_keys": ["y"], "how": "inner", "constraints": {"cardinality": "many_to_one", "allow_row_decrease": True}},
        ],
    },
}


def given(spark, doubled=False):
    ra = [(1, 5), (2, 5)] + ([(2, 6)] if doubled else [])
    return {"ra": spark.createDataFrame(ra, "x int, y int"), "rb": spark.createDataFrame([(5,), (6,)], "y int"), "rc": spark.createDataFrame([(n, n % 3, 5 + n % 3) for n in range(30)], "n int, x int, y int")}


def test_links_of_an_entity_share_one_count(spark, monkeypatch):
    asked = []
    real = links.key_counts
    for module in ("tessera.operators.link", "tessera.plans.pipeline"):
        monkeypatch.setattr(f"{module}.key_counts", lambda x, nulls=None: asked.append(len(x)) or real(x, nulls))
    result = normalize(spark, Project.of({"entities": SPEC}), ["c"], given(spark), constraints="warn")
    assert asked == [2]
    assert result.reports["c", "a"].counts["rows"] == 30
    assert (result.reports["c", "b"].counts["left_rows"], result.reports["c", "b"].counts["rows"]) == (30, 20)
    asked.clear()
    doubled = normalize(spark, Project.of({"entities": SPEC}), ["c"], given(spark, True), constraints="warn")
    assert asked == [2, 1]  # the first link made more rows, so that the second is counted on those
    assert doubled.reports["c", "b"].counts["left_rows"] == 40
    assert doubled.tables["c"].count() == doubled.reports["c", "b"].counts["rows"]
    with pytest.raises(ConstraintViolation):
        normalize(spark, Project.of({"entities": SPEC}), ["c"], given(spark, True))


def test_each_table_is_checked_by_one_query(spark, monkeypatch):
    from tessera.quality import validators

    asked = []
    real = validators.answers
    monkeypatch.setattr(validators, "answers", lambda probes: asked.append(len(probes)) or real(probes))
    tables = {"a": spark.createDataFrame([(1, 5), (1, 5)], "x int, y int"), "b": spark.createDataFrame([], "y int"), "c": spark.createDataFrame([(1, 7, None), (2, 1, 3)], "n int, x int, y int")}
    found = {(i.code, i.entity) for i in validate(Project.of({"entities": SPEC}), tables)}
    assert found == {("NON_UNIQUE_KEYS", "a"), ("EMPTY_RESULT", "b"), ("FK_DATA_INTEGRITY", "c"), ("FK_REMOTE_EMPTY", "c")}
    assert asked == [2, 2, 4]
    text = next(i.message for i in validate(Project.of({"entities": SPEC}), tables) if i.code == "FK_DATA_INTEGRITY")
    assert text == "1 keys are not in a, e.g. [(7,)]"


def test_names_from_inside_may_be_columns(spark):
    names = ["__left", "__right", "__key0", "__place", "__range", "__before", "__v0", "__end0", "__n", "count"]
    df = spark.createDataFrame([(i, *[f"{n}{i}" for n in names]) for i in range(6)], "id int, " + ", ".join(f"`{n}` string" for n in names))
    whole = {r.id: tuple(r)[1:] for r in df.collect()}
    assert {r.id: tuple(r)[2:] for r in add_system_id(df, ["id"]).collect()} == whole
    fk = ForeignKey.of({"entity": "other", "local_keys": ["id"], "remote_keys": ["id"], "how": "outer", "constraints": {"cardinality": "one_to_one"}, "extra_columns": {"theirs": "__left"}})
    out = link(df, fk, Remote("other", df.selectExpr("*", "id AS system_id")), merge_indicator="from")[0]
    assert {(r.id, r.theirs, r["from"], tuple(r)[1 : len(names) + 1]) for r in out.collect()} == {(i, w[0], "both", w) for i, w in whole.items()}
    filled = apply_replacements(df, {"count": [{"blank_out": ["count3"], "fill": "forward"}], "__n": [{"blank_out": ["__n3"], "fill": "backward"}]}, ("id",))
    rows = {r.id: r for r in filled.collect()}
    assert (rows[3]["count"], rows[3]["__n"], rows[3]["__place"], rows[3]["__v0"]) == ("count2", "__n4", "__place3", "__v03")


def test_fills_of_several_columns_write_once(spark, monkeypatch):
    from tessera.operators import shared

    wrote = []
    real = shared.fixed
    monkeypatch.setattr(shared, "fixed", lambda df: wrote.append(1) or real(df))
    rng = random.Random(1)
    rows = [(i, *[rng.choice([None, "", "p", "q"]) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string").repartition(5)
    spec = {"a": [{"blank_out": [""], "fill": "forward"}], "b": [{"map": {"p": "P"}}, {"blank_out": [""], "fill": "backward"}, {"map": {"q": "Q"}}], "c": [{"blank_out": ["", "p"], "fill": "forward"}, {"blank_out": ["q"], "fill": "backward"}]}
    got = [tuple(r) for r in apply_replacements(df, spec, ("i",)).orderBy("i").collect()]
    assert len(wrote) == 2  # one for all first fills, one for the second fill of c
    one = df
    for name, rules in spec.items():
        one = apply_replacements(one, {name: rules}, ("i",))
    assert got == [tuple(r) for r in one.orderBy("i").collect()]
    last = None
    for i, a, *_ in rows:
        last = a or last
        assert got[i][1] == last
