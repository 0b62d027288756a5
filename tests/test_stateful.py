"""Stateful steps over streams: several micro-batches, late rows and a restart give the batch operators' results."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tessera.streaming import stateful, steps

START = datetime(2024, 5, 1)
SCHEMA = "k string, at timestamp, v long, w string, x double"


def batches(seed, n=4, late=30):
    """Rows in about the order of their times, out of order by up to `late` minutes, with repeats, nulls and large numbers."""
    rng = random.Random(seed)
    rows = []
    for _ in range(240):
        minute = rng.randrange(600)
        value = rng.choice([None, 2**53 + rng.randrange(9), rng.randrange(5)])
        rows.append((rng.choice(["a", "b", "c", None, "é"]), START + timedelta(minutes=minute, microseconds=rng.randrange(3)), value, rng.choice([None, "p", 'q"{'] ), rng.choice([None, 0.1, 1e300]), minute + rng.randrange(late)))
    rows.sort(key=lambda r: r[-1])
    rows = [r[:-1] for r in rows]
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)] + [[("end", START + timedelta(days=9), 1, None, None)], [("end", START + timedelta(days=19), 1, None, None)]]


def streamed(spark, tmp_path, parts, work):
    """Each part is a file that arrives while the stream is stopped: the stream starts anew from its checkpoint for every one."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        source = steps.read_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, 1)
        work(source).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        assert i < 99
    return [r for r in spark.read.parquet(out).collect() if r.k != "end"]


def whole(spark, parts):
    return spark.createDataFrame([r for part in parts[:-2] for r in part], SCHEMA)


def test_first_rows(spark, tmp_path):
    parts = batches(1)
    got = streamed(spark, tmp_path, parts, lambda df: stateful.keep_first(df, ["k", "w"], "at", "40 minutes"))
    want = stateful.keep_first(whole(spark, parts), ["k", "w"], "at")
    assert Counter(map(tuple, got)) == Counter(map(tuple, want.collect()))
    least = {}
    for part in parts[:-2]:
        for r in part:
            least[r[0], r[3]] = min(least.get((r[0], r[3]), r[1]), r[1])
    assert {(r.k, r.w): r["at"] for r in got} == least


def test_fills(spark, tmp_path):
    parts = batches(2)
    got = streamed(spark, tmp_path, parts, lambda df: stateful.forward_fill(df, ["k"], ["v", "w", "x"], "at", "40 minutes"))
    want = stateful.forward_fill(whole(spark, parts), ["k"], ["v", "w", "x"], "at")
    assert Counter(map(tuple, got)) == Counter(map(tuple, want.collect()))
    assert sum(r.v is not None for r in got) > sum(r[2] is not None for part in parts[:-2] for r in part)


def test_ids_of_a_ledger(spark, tmp_path):
    parts, folder, ledger = batches(3)[:3], tmp_path / "in", str(tmp_path / "ledger")
    folder.mkdir()
    seen, fail = {}, [True]

    def sink(df, n):
        rows = df.collect()
        if n == 1 and fail:
            fail.clear()
            raise RuntimeError("lost after the ledger was written")
        seen[n] = rows

    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        for _ in range(2):  # the second start runs a failed batch again
            source = steps.read_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, 1)
            query = stateful.write_with_ids(source, ["k", "w"], ledger, sink, str(tmp_path / "state"), availableNow=True)
            try:
                query.awaitTermination()
            except Exception as e:  # noqa: BLE001
                assert "lost after" in str(e)
    assert sorted(seen) == [0, 1, 2]
    rows = [r for n in seen for r in seen[n]]
    assert Counter((r.k, r["at"], r.v, r.w, r.x) for r in rows) == Counter(r for part in parts for r in part)
    ids = {(r.k, r.w): r.system_id for r in rows}
    assert sorted(ids.values()) == list(range(1, len(ids) + 1))
    assert len({(r.k, r.w, r.system_id) for r in rows}) == len(ids)
    first = {key: i for key, i in ids.items() if any(r[0] == key[0] and r[3] == key[1] for r in parts[0])}
    assert sorted(first.values()) == list(range(1, len(first) + 1))  # ids given first stay below later ones


def test_batch_forms_take_any_names(spark):
    df = spark.createDataFrame([("a", START, 1), ("a", START, 1), ("a", START - timedelta(1), None)], "__text string, at timestamp, row long")
    assert [r.row for r in stateful.keep_first(df, ["__text"], "at").collect()] == [None]
    assert sorted((r.row for r in stateful.forward_fill(df, ["__text"], ["row"], "at").collect()), key=repr) == [1, 1, None]
    with pytest.raises(steps.StreamError):
        steps.apply_entity(df, steps.Entity.of("e", {"drop_duplicates": True, "source": "x"}))
