"""Single files whose parts tasks write."""

import csv
import io
import os
import random
import sqlite3
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sinks import fragments, writers
from tessera.sources import files


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", 'q"uote', "two\nlines", "é,;", "  "]), rng.random() if i % 3 else None, i % 2 == 0) for i in range(5000)]
    return rows, spark.createDataFrame(rows, "system_id long, s string, x double, t boolean").repartition(7)


def read_csv(text):
    return list(csv.reader(io.StringIO(text, newline="")))


def expected(rows):
    return [["system_id", "s", "x", "t"], *[["" if v is None else str(v) for v in r] for r in rows]]


def test_checksums_of_joined_strings():
    rng = random.Random(1)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (1000, 77_777), (3, 1 << 16)]:
        a, b = rng.randbytes(n), rng.randbytes(m)
        assert fragments.crc_of_both(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_zipped_csv(spark, tmp_path, table):
    rows, df = table
    path = tmp_path / "out.zip"
    writers.write("zipcsv", str(path), {"b": df, "a": spark.range(3).coalesce(1), "none": df.where("false")})
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert z.namelist() == ["a.csv", "b.csv", "none.csv"]
        assert read_csv(z.read("b.csv").decode()) == expected(rows)  # in the order of their ids
        assert z.read("none.csv").decode() == "system_id,s,x,t\r\n"
    assert os.listdir(tmp_path) == ["out.zip"]


def test_single_csv_and_scripts(spark, tmp_path, table):
    rows, df = table
    writers.write("single_csv", str(tmp_path), {"t": df})
    assert read_csv((tmp_path / "t.csv").read_text(newline="")) == expected(rows)
    writers.write("sql", str(tmp_path), {"t": df})
    c = sqlite3.connect(":memory:")
    c.execute("CREATE TABLE t (system_id, s, x, t)")
    c.executescript((tmp_path / "t.sql").read_text())
    near = lambda x: None if x is None else round(x, 12)  # noqa: E731  SQLite reads decimals to 15 places
    assert [(i, s, near(x), t) for i, s, x, t in c.execute("SELECT * FROM t ORDER BY 1")] == [(i, s, near(x), int(t)) for i, s, x, t in rows]
    assert [fragments.insert_value(v) for v in (None, True, 2.5, float("nan"), float("-inf"), "it's")] == ["NULL", "TRUE", "2.5", "'NaN'", "'-Infinity'", "'it''s'"]
    assert sorted(os.listdir(tmp_path)) == ["t.csv", "t.sql"]


def test_workbooks_of_many_tasks(spark, tmp_path, table):
    rows, df = table
    path = str(tmp_path / "w.xlsx")
    writers.write("openpyxl", path, {"t": df.withColumn("when", F.lit("2024-01-02 03:04:05").cast("timestamp")), "none": df.where("false")})
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert b'<c t="inlineStr" s="2"><is><t xml:space="preserve">system_id</t></is></c>' in z.read("xl/worksheets/sheet2.xml")
    names, got = files.sheet_frame(spark, path, "t", range_bytes=100_000)
    assert names == ["system_id", "s", "x", "t", "when"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(rows)
    assert {r.c4 for r in got.collect()} == {"2024-01-02 03:04:05"}
    assert files.sheet_frame(spark, path, "none")[0] == ["system_id", "s", "x", "t"]


def test_a_failed_job_leaves_nothing(spark, tmp_path, table):
    _, df = table
    (tmp_path / "kept.zip").write_text("as before")
    bad = df.withColumn("s", F.when(F.col("system_id") == 4321, F.raise_error(F.lit("broken row"))).otherwise(F.col("s")))
    with pytest.raises(Exception, match="broken row"):
        writers.write("zipcsv", str(tmp_path / "kept.zip"), {"a": df, "b": bad})
    assert os.listdir(tmp_path) == ["kept.zip"]
    assert (tmp_path / "kept.zip").read_text() == "as before"


def test_records_beyond_32_bits():
    """Heads and directory of members larger than four gigabytes, by their own numbers."""
    head = fragments._head(b"x", 1, 5, 1 << 33)
    assert head[18:26] == b"\xff" * 8
    assert head[-16:] == (1 << 33).to_bytes(8, "little") + (5).to_bytes(8, "little")
    assert b"PK\6\6" in fragments._directory([(b"x", 1, 5, 1 << 33, 0)], 1 << 33)
    assert b"PK\6\6" not in fragments._directory([(b"x", 1, 5, 9, 0)], 100)
