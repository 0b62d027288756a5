"""Workbooks read by ranges of their XML."""

import random
import zipfile
from collections import Counter

import pytest

from tessera.config.project import Entity
from tessera.sinks import writers
from tessera.sources import files
from tessera.sources.registry import SourceError

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, sheet_xml, shared=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="s" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet_xml)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{a}</t></r><r><t>{b}</t></r></si>" for a, b in shared) + "</sst>")
    return str(path)


def test_ranges_hold_each_row_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b<c>&", "é" * 50, "  x ", None]), rng.random() * 10 ** rng.randint(-5, 20), rng.random() < 0.5, i if i % 3 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "i long, s string, x double, t boolean, n long")
    path = str(tmp_path / "big.xlsx")
    writers.write("xlsx", path, {"one": df, "two": spark.range(1)})
    for step in (1 << 14, 77_777, files.RANGE_BYTES):
        names, got = files.sheet_frame(spark, path, "one", range_bytes=step)
        assert names == ["i", "s", "x", "t", "n"]
        assert [t for _, t in got.dtypes] == ["bigint", "string", "double", "boolean", "bigint"]
        assert Counter(map(tuple, got.collect())) == Counter(rows)
    source = spark.read.format("workbook").option("path", path).option("sheet", "one").option("rangeBytes", 1 << 14).load()
    assert source.rdd.getNumPartitions() > 20
    assert sorted(r.n for r in source.select("n").collect()) == list(range(1, 4002))
    assert files.sheet_frame(spark, path, "two")[1].collect() == [(0,)]


@pytest.mark.parametrize("prefix", ["", "x:"])
def test_shared_strings_prefixes_and_rows_without_numbers(spark, tmp_path, prefix):
    p, ns = prefix, f'xmlns{":x" if prefix else ""}="{MAIN}"'
    cell = lambda v, kind="n": f'<{p}c t="{kind}"><{p}v>{v}</{p}v></{p}c>'
    body = "".join(f"<{p}row>{cell(k % 7, 's')}{cell(k)}{cell(int(k % 2), 'b') if k % 5 else ''}</{p}row>" for k in range(3000))
    head = f"<{p}row>{cell('id', 'str')}{cell('k', 'str')}{cell('odd', 'str')}</{p}row><{p}row/>"
    path = book(tmp_path / "b.xlsx", f'<{p}worksheet {ns}><{p}dimension ref="A1"/><{p}sheetData>{head}{body}</{p}sheetData><{p}rowBreaks/></{p}worksheet>', [(f"a{i}", "é&amp;") for i in range(9)])
    names, got = files.sheet_frame(spark, path, "s", range_bytes=10_000)
    assert names == ["id", "k", "odd"]
    want = Counter((f"a{k % 7}é&", k, bool(k % 2) if k % 5 else None) for k in range(3000))
    want[None, None, None] += 1  # the empty row is a row
    assert Counter(map(tuple, got.collect())) == want


def test_ranges_of_cells(spark, tmp_path):
    sheet = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}"><v>{r * 10 + k}</v></c>' for k, c in enumerate("ACE")) + "</row>" for r in (2, 3, 7, 9))
    path = book(tmp_path / "c.xlsx", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
    read = lambda **o: files.read_workbook(spark, Entity.of("x", {"type": "xlsx", "source": "s"}), {"filename": path, "sanitize_header": False, **o})
    assert sorted(map(tuple, read(range="C3:E7", header=False).collect())) == [(31, None, 32), (71, None, 72)]
    assert read(range="C3:E7", header=False).columns == ["C_1", "C_2", "C_3"]
    got = read(range="A2:E8", header=True)
    assert got.columns == ["20", "None", "21", "None", "22"]
    assert sorted(tuple(r) for r in got.collect()) == [(30, None, 31, None, 32), (70, None, 71, None, 72)]
    assert read(range="A50:B60").columns == []
    assert read(range="A:C", header=["p", "q", "r"]).count() == 4
    with pytest.raises(SourceError, match="names for"):
        read(range="A:C", header=["p"])
    with pytest.raises(SourceError, match="not a range"):
        read(range="A")


def test_kinds_are_those_of_all_rows(spark, tmp_path):
    rows = [(1, "1"), (2, "2"), (3, "true")]
    path = str(tmp_path / "k.xlsx")
    writers.write("xlsx", path, {"s": spark.createDataFrame(rows, "i long, s string")})
    sheet = "".join(f'<row r="{n}"><c r="A{n}"><v>{v}</v></c><c r="B{n}" t="{t}"><v>{w}</v></c></row>' for n, v, t, w in [(1, 5, "str", "mixed"), (2, 5, "n", 7), (3, "5.5", "b", 1), (4, "1E3", "n", "2.50")])
    _, got = files.sheet_frame(spark, book(tmp_path / "m.xlsx", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>'), "s", header=False)
    assert got.dtypes == [("c0", "double"), ("c1", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(5.0, "mixed"), (5.0, "7"), (5.5, "True"), (1000.0, "2.5")], key=repr)
    assert files.sheet_frame(spark, path, "s")[1].dtypes == [("c0", "bigint"), ("c1", "string")]
