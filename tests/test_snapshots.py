"""Previews: what is built again after which change."""

import os
import time

import pytest

from tessera.config.project import Project
from tessera.service.analysis import Previews
from tessera.service.snapshots import Snapshots


def project(folder, **changes):
    spec = {
        "left": {"type": "csv", "options": {"filename": f"{folder}/left.csv"}, "public_id": "left_id", "keys": ["k"], "columns": ["v"]},
        "right": {"type": "csv", "options": {"filename": f"{folder}/right.csv"}, "public_id": "right_id", "keys": ["k"], "columns": ["w"]},
        "middle": {"source": "left", "public_id": "middle_id", "keys": ["k"], "columns": ["v"]},
        "top": {"source": "raw", "keys": ["k"], "foreign_keys": [{"entity": e, "local_keys": ["k"], "remote_keys": ["k"], "how": "left", "extra_columns": [c]} for e, c in (("middle", "v"), ("right", "w"))]},
    }
    for name, change in changes.items():
        spec[name] = {**spec[name], **change}
    return Project.of({"entities": spec})


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "left.csv").write_text("k,v\n1,a\n2,b\n")
    (tmp_path / "right.csv").write_text("k,w\n1,p\n2,q\n")
    return tmp_path


def rows(df):
    return sorted((r.k, r.v, r.w) for r in df.collect())


def touch(path, text):
    path.write_text(text)
    os.utime(path, (time.time() + 5, time.time() + 5))


def test_a_changed_leaf_rebuilds_its_descendants_only(spark, folder):
    previews = Previews(spark, folder=f"file://{folder}/kept")
    given = {"raw": spark.createDataFrame([(1,), (2,)], "k int")}
    assert rows(previews.preview(project(folder), "top", given=given)) == [(1, "a", "p"), (2, "b", "q")]
    assert sorted(previews.built) == ["left", "middle", "right", "top"]
    previews.built.clear()
    assert rows(previews.preview(project(folder), "top", given=given)) == [(1, "a", "p"), (2, "b", "q")]
    assert previews.built == []
    touch(folder / "left.csv", "k,v\n1,A\n2,b\n")
    assert rows(previews.preview(project(folder), "top", given=given)) == [(1, "A", "p"), (2, "b", "q")]
    assert sorted(previews.built) == ["left", "middle", "top"]
    previews.built.clear()
    changed = project(folder, middle={"replacements": {"v": {"b": "B"}}})
    assert rows(previews.preview(changed, "top", given=given)) == [(1, "A", "p"), (2, "B", "q")]
    assert sorted(previews.built) == ["middle", "top"]
    previews.built.clear()
    assert rows(previews.preview(project(folder), "top", given=given)) == [(1, "A", "p"), (2, "b", "q")]  # the change taken back
    assert previews.built == []


def test_other_given_rows_are_other_previews(spark, folder, tmp_path):
    previews = Previews(spark, folder=f"file://{folder}/kept")
    three = {"raw": spark.createDataFrame([(1,), (2,), (3,)], "k int")}
    seven = {"raw": spark.createDataFrame([(k,) for k in range(7)], "k int")}
    assert previews.table(project(folder), "top", three).count() == 3
    assert previews.table(project(folder), "top", seven).count() == 7
    assert previews.table(project(folder), "top", three).count() == 3
    assert previews.built.count("top") == 2
    assert previews.built.count("middle") == 1
    path = str(tmp_path / "raw.parquet")
    spark.range(4).selectExpr("cast(id AS int) AS k").write.parquet(path)
    previews.built.clear()
    read = lambda: {"raw": spark.read.parquet(path)}
    assert previews.table(project(folder), "top", read()).count() == 4
    assert previews.table(project(folder), "top", read()).count() == 4  # read anew, but the same files
    assert previews.built == ["top"]
    spark.range(5).selectExpr("cast(id AS int) AS k").write.mode("overwrite").parquet(path)
    assert previews.table(project(folder), "top", read()).count() == 5


def test_versions_of_sources_that_show_no_change(spark, folder):
    previews = Previews(spark, folder=f"file://{folder}/kept")
    given = {"raw": spark.createDataFrame([(1,)], "k int")}
    for version, built in ((1, 4), (1, 4), (2, 5)):
        previews.table(project(folder), "top", given, {"top": version})
        assert len(previews.built) == built


def test_snapshots_outlive_the_session_and_go_with_their_files(spark, folder):
    given = {"raw": spark.createDataFrame([(1,)], "k int")}
    kept = f"file://{folder}/kept"
    Previews(spark, folder=kept).table(project(folder), "top", given)
    again = Previews(spark, folder=kept)
    assert rows(again.table(project(folder), "top", given)) == [(1, "a", "p")]
    assert again.built == []
    few = Previews(spark, folder=f"file://{folder}/few", most=2)
    few.table(project(folder), "top", given)
    assert len(os.listdir(folder / "few")) == 2
    old = Previews(spark, folder=f"file://{folder}/old", seconds=0.0)
    assert old.kept.get("nothing") is None
    late = Previews(spark, folder=kept, seconds=0.0)
    late.table(project(folder), "top", given)
    assert sorted(late.built) == ["left", "middle", "right", "top"]
    again.forget(project(folder), "top", given)
    again.built.clear()
    again.table(project(folder), "middle", given)
    assert again.built in ([], ["left", "middle"])


def test_a_half_written_snapshot_is_not_found(spark, folder):
    store = Snapshots(spark, f"file://{folder}/kept")
    df = spark.sql("SELECT 1 AS `a b`, null AS nothing, array(1) AS list")
    df.write.parquet(f"{folder}/kept/half/rows")
    assert store.get("half") is None
    assert store.put("whole", df).collect() == df.collect()
    found = Snapshots(spark, f"file://{folder}/kept").get("whole")
    assert found.collect() == df.collect()
    assert found.columns == df.columns
    assert sorted(os.listdir(folder / "kept")) == ["half", "whole"]


def test_several_previews_from_one_run(spark, folder):
    previews = Previews(spark, folder=f"file://{folder}/kept")
    got = previews.batch(project(folder), ["middle", "right"], 1)
    assert {n: df.count() for n, df in got.items()} == {"middle": 1, "right": 1}
    assert sorted(previews.built) == ["left", "middle", "right"]


def test_tables_on_the_way_go(spark, folder, monkeypatch):
    from tessera.operators import shared

    monkeypatch.setattr(shared, "shared_folder", lambda s: f"file://{folder}/way")
    previews = Previews(spark, folder=f"file://{folder}/kept")
    given = {"raw": spark.createDataFrame([(1,), (2,)], "k int")}
    assert rows(previews.preview(project(folder), "top", given=given)) == [(1, "a", "p"), (2, "b", "q")]
    assert os.listdir(folder / "way") == []
    with shared.scratch() as kept:
        shared.written(spark.range(5))
        out = kept(shared.written(spark.range(7)))
        none = kept(shared.written(spark.range(0)))
    assert (out.count(), none.count()) == (7, 0)
    assert len(os.listdir(folder / "way")) == 2
    shared.dropped(none)
    shared.dropped(out.select("id"))  # no table of its own
    assert len(os.listdir(folder / "way")) == 1
    with pytest.raises(RuntimeError), shared.scratch() as kept:
        kept(shared.written(spark.range(5)))
        raise RuntimeError
    assert len(os.listdir(folder / "way")) == 1
