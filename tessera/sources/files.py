"""File scans: CSV and TSV, Parquet, and workbooks."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config.project import Entity
from ..functions.text import column_names
from .registry import Option, SourceError, register

_FILE = Option("filename", "path", True, None, ("path", "file"))


@register(
    "csv",
    "tsv",
    options=(_FILE, Option("sep", "string", False, None, ("delimiter",)), Option("encoding"), Option("sanitize_header", "boolean", False, True)),
    help="delimited text with a header",
)
def read_csv(spark: SparkSession, entity: Entity, options: dict) -> DataFrame:
    """Other options go to Spark's reader. Types are inferred unless a schema is given; headers become plain names."""
    options = dict(options)
    name, plain = options.pop("filename"), options.pop("sanitize_header", True)
    sep = options.pop("sep", None) or ("\t" if entity.type == "tsv" or str(name).endswith(".tsv") else ",")
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", options.pop("multiLine", True)).option("escape", '"')
    if options.get("encoding"):
        reader = reader.option("encoding", options.pop("encoding"))
    schema = options.pop("schema", None)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", options.pop("inferSchema", True))
    df = reader.options(**{k: v for k, v in options.items() if v is not None}).csv(name)
    return df.toDF(*column_names([re.sub(r"^_c\d+$", "", c) for c in df.columns])) if plain else df


@register("parquet", options=(_FILE,), help="Parquet files")
def read_parquet(spark: SparkSession, entity: Entity, options: dict) -> DataFrame:
    return spark.read.parquet(options["filename"])


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_CELL = re.compile(r"([A-Z]+)(\d+)?")


def _column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


#: rows of a sheet's XML, and the end of them
_TAGS = re.compile(rb"<(?:[\w.]+:)?row[\s>/]|</(?:[\w.]+:)?sheetData\s*>")
_ROOT = re.compile(rb"<(?:[\w.]+:)?worksheet\b[^>]*>")
#: bytes of a sheet's XML that a task reads
RANGE_BYTES = 8 << 20
_CHUNK = 1 << 20


def _opened(path: str):
    """A file by its path, or in a store that pyarrow knows by its address."""
    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file://"), "rb")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


class Workbook:
    """Reads an .xlsx file's sheets from its XML parts, by ranges of their bytes, a row at a time."""

    def __init__(self, path: str):
        file = _opened(path)
        if not zipfile.is_zipfile(file):
            raise SourceError(f"{path} is no workbook of zipped XML: only .xlsx files are read, an .xls file must be saved as one")
        self.zip = zipfile.ZipFile(file)
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = {x.get("Id"): x.get("Target") for x in links}
        self.sheets = {}
        for s in book.iterfind("m:sheets/m:sheet", _NS):
            at = target[s.get(f"{{{_NS['r']}}}id")]
            self.sheets[s.get("name")] = at.lstrip("/") if at.startswith("/") else f"xl/{at}"

    def member(self, sheet: str) -> str:
        if sheet not in self.sheets:
            raise SourceError(f"no sheet {sheet}; there are {', '.join(self.sheets)}")
        return self.sheets[sheet]

    def size(self, sheet: str) -> int:
        """Bytes of the sheet's XML."""
        return self.zip.getinfo(self.member(sheet)).file_size

    def strings(self, wanted: set[int]) -> dict[int, str]:
        """The shared strings of these numbers, by one pass over all of them."""
        out: dict[int, str] = {}
        if not wanted or "xl/sharedStrings.xml" not in self.zip.namelist():
            return out
        item, text, last = f"{{{_NS['m']}}}si", f"{{{_NS['m']}}}t", max(wanted)
        with self.zip.open("xl/sharedStrings.xml") as f:
            n = 0
            for _, e in ElementTree.iterparse(f):
                if e.tag == item:
                    if n in wanted:
                        out[n] = "".join(x.text or "" for x in e.iter(text))
                    n += 1
                    e.clear()
                    if n > last:
                        break
        return out

    def cells(self, sheet: str, start: int = 0, end: int | None = None):
        """(row number, {column number: (kind, text)}) of the rows whose tags begin at bytes start to end of the sheet's XML.

        What lies before is unpacked, as it must be, and searched for rows' tags only; nothing of it is parsed."""
        row_tag = f"{{{_NS['m']}}}row"
        with self.zip.open(self.member(sheet)) as f:
            parser, root, base, held, seen, at_end = ElementTree.XMLPullParser(("end",)), None, 0, b"", 0, False
            feeding = done = False
            while not (at_end or done):
                chunk = f.read(_CHUNK)
                at_end = not chunk
                data = held + chunk
                if root is None:
                    found = _ROOT.search(data)
                    if not found:
                        held = data
                        continue
                    root = found[0]
                    parser.feed(root)
                # a tag may go on in the next chunk, so that the last bytes wait for it
                sure = len(data) if at_end else max(0, len(data) - 64)
                fed = 0
                for tag in _TAGS.finditer(data):
                    if tag.start() >= sure:
                        break
                    place, is_row = base + tag.start(), data[tag.start() + 1 : tag.start() + 2] != b"/"
                    if not is_row or end is not None and place >= end:
                        if feeding:
                            parser.feed(data[fed : tag.start()])
                        feeding, done = False, True
                        break
                    if not feeding and place >= start:
                        feeding, fed, number = True, tag.start(), seen
                    seen += 1
                if feeding:
                    parser.feed(data[fed:sure])
                held, base = data[sure:], base + sure
                for _, e in parser.read_events():
                    if e.tag == row_tag:
                        number = int(e.get("r") or number + 1)
                        yield number, self._row(e)
                        e.clear()

    def _row(self, row) -> dict[int, tuple[str, str]]:
        out: dict[int, tuple[str, str]] = {}
        at = 0
        for c in row:
            value, place = _cell_of(c), _CELL.match(c.get("r", ""))
            at = _column_number(place[1]) if place else at + 1
            if value is not None:
                out[at] = value
        return out

    def rows(self, sheet: str, start: int = 0, end: int | None = None):
        """(row number, {column number: value}) of a range of bytes, shared strings filled in."""
        found = list(self.cells(sheet, start, end))
        shared = self.strings({int(text) for _, cells in found for kind, text in cells.values() if kind == "s"})
        for n, cells in found:
            yield n, {k: _value_of(kind, text, shared) for k, (kind, text) in cells.items()}

    def head(self, sheet: str, low: int = 1) -> tuple[int, dict] | None:
        """The first row that is there from row `low` on."""
        for n, cells in self.cells(sheet):
            if n >= low:
                shared = self.strings({int(text) for kind, text in cells.values() if kind == "s"})
                return n, {k: _value_of(kind, text, shared) for k, (kind, text) in cells.items()}
        return None


def _cell_of(cell) -> tuple[str, str] | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "str", "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
    v = cell.find("m:v", _NS)
    return None if v is None or v.text is None else (kind, v.text)


def _value_of(kind: str, text: str, shared: dict[int, str]):
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return text == "1"
    if kind in ("str", "e", "d"):
        return text
    number = float(text)
    return int(number) if number.is_integer() and "." not in text and "E" not in text.upper() else number


def cell_range(cells: str | None) -> tuple[int, int, int | None, int | None]:
    """First column and row, last column and row of a range (A1:D10 or A:I); the whole sheet without one."""
    if not cells:
        return 1, 1, None, None
    a, b = (_CELL.fullmatch(x) for x in (cells.upper().split(":") + [""])[:2])
    if not a or not b:
        raise SourceError(f"not a range: {cells}")
    return _column_number(a[1]), int(a[2] or 1), _column_number(b[1]), int(b[2]) if b[2] else None


#: how a value is written before its type is known
_LETTERS = {bool: "b", int: "i", float: "f", str: "s"}


class WorkbookSource(DataSource):
    """Spark data source `workbook`: rows of a sheet as (n, cells), a partition for each range of the sheet's XML.

    A cell is a letter for its kind and its text. Options: path, sheet, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "n long, cells array<string>"

    def reader(self, schema):
        o = self.options
        path, sheet, step = o["path"], o["sheet"], int(o.get("rangebytes", RANGE_BYTES))

        class Reader(DataSourceReader):
            def partitions(self):
                size = Workbook(path).size(sheet)
                return [InputPartition((a, a + step)) for a in range(0, max(size, 1), step)]

            def read(self, partition):
                for n, row in Workbook(path).rows(sheet, *partition.value):
                    yield n, [None if (v := row.get(c)) is None else _LETTERS[type(v)] + str(v) for c in range(1, max(row, default=0) + 1)]

        return Reader()


def sheet_frame(spark: SparkSession, path: str, sheet: str, cells: str | None = None, header: bool | list[str] = True, range_bytes: int = RANGE_BYTES) -> tuple[list, DataFrame]:
    """The names and the rows of a sheet, or of a range of its cells. header: True, False (C_1, ...), or names.

    Executors read the rows and settle them; then each column's type is what all its values are. The driver sees the first row alone."""
    from ..operators.shared import written

    book = Workbook(path)
    low_c, low_r, high_c, high_r = cell_range(cells)
    book.member(sheet)
    first = book.head(sheet, low_r) if header is True else None
    spark.dataSource.register(WorkbookSource)
    rows = spark.read.format("workbook").option("path", path).option("sheet", sheet).option("rangeBytes", range_bytes).load().where(F.col("n") >= low_r)
    if high_r is not None:
        rows = rows.where(F.col("n") <= high_r)
    rows = written(rows if high_c is None else rows.withColumn("cells", F.slice("cells", 1, high_c)), "sheet")
    if high_c is None:
        high_c = rows.agg(F.max(F.size("cells"))).first()[0] or low_c - 1
    there = first is not None and (high_r is None or first[0] <= high_r)
    data = rows.where(F.col("n") != first[0]) if there else rows
    each = data.select(F.posexplode("cells").alias("c", "v")).where(F.col("v").isNotNull())
    kinds = {r["c"] + 1: set(r["k"]) for r in each.groupBy("c").agg(F.collect_set(F.substring("v", 1, 1)).alias("k")).collect()}  # no more rows than a sheet has columns
    width = max(0, high_c - low_c + 1)
    if header is True:
        names = [first[1].get(c) for c in range(low_c, high_c + 1)] if there else []
    else:
        names = [f"C_{i + 1}" for i in range(width)] if header is False else list(header)
    if not names and header is True:
        return [], data.select()
    if len(names) != width and width:
        raise SourceError(f"{len(names)} names for {width} columns")
    return names, data.select(*[_typed(F.get("cells", F.lit(low_c + i - 1)), kinds.get(low_c + i, set())).alias(f"c{i}") for i in range(len(names))])


def _typed(cell: Column, kinds: set[str]) -> Column:
    text = F.substring(cell, 2, 1 << 30)
    if kinds and kinds <= {"b"}:
        return text == "True"
    if kinds and kinds <= {"i"}:
        return text.cast("long")
    return text.cast("double") if kinds and kinds <= {"i", "f"} else text


@register(
    "xlsx",
    "xls",
    "openpyxl",
    options=(_FILE, Option("sheet_name", "string", False, None, ("sheet",)), Option("range"), Option("header", "boolean", False, True), Option("sanitize_header", "boolean", False, True)),
    help="one sheet of a workbook, or a range of its cells",
)
def read_workbook(spark: SparkSession, entity: Entity, options: dict) -> DataFrame:
    """`source` is short for the sheet. Typed by its values."""
    sheet = options.get("sheet_name") or entity.source
    if not sheet:
        raise SourceError(f"{entity.name}: which sheet?")
    names, df = sheet_frame(spark, str(options["filename"]), sheet, options.get("range"), options.get("header", True))
    return df.toDF(*(column_names(names) if options.get("sanitize_header", True) else [str(n) for n in names]))


def workbook_metadata(path: str) -> dict[str, list[str]]:
    """Sheet -> its header."""
    book = Workbook(path)
    return {s: [str(n) for _, n in sorted(((book.head(s) or (0, {}))[1]).items())] for s in book.sheets}
