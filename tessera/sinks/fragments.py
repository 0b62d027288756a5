"""Single files made by executors: each task writes, and packs, its part of a text; the parts are then strung together.

Raw deflate streams that end on a full flush can follow each other, so that a zip member is its tasks' streams one after the other, and
its checksum follows from theirs and their lengths. The driver's job is told names, lengths and checksums, never rows; whoever
strings the parts together copies packed bytes, a block at a time. The file gets its name when it is whole. Tasks and driver must
share the folder of the target. What a failed or repeated task left behind goes with the folder of the parts.
"""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isfinite
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_BLOCK = 1 << 20
#: text gathered before it is packed and written
_PAGE = 1 << 18


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its place among the tasks, where, bytes before and after packing, their CRC-32, rows."""

    at: int
    path: str
    size: int
    packed: int
    crc: int
    rows: int


def csv_texts(rows: Iterator, said: dict) -> Iterator[tuple[str, int]]:
    """CSV lines, a page at a time, with the number of rows in each."""
    out, n = io.StringIO(newline=""), 0
    write = csv.writer(out).writerow
    for row in rows:
        write(["" if v is None else v for v in row])
        n += 1
        if out.tell() > _PAGE:
            yield out.getvalue(), n
            out.seek(0)
            out.truncate()
            n = 0
    yield out.getvalue(), n


def insert_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float) and not isfinite(v):
        return "'NaN'" if v != v else "'Infinity'" if v > 0 else "'-Infinity'"
    return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def insert_texts(rows: Iterator, said: dict) -> Iterator[tuple[str, int]]:
    """INSERT statements of up to `batch` rows each."""
    held, head = [], f"INSERT INTO {said['table']} ({said['columns']}) VALUES\n"
    for row in rows:
        held.append("(" + ", ".join(map(insert_value, row)) + ")")
        if len(held) == said["batch"]:
            yield head + ",\n".join(held) + ";\n", len(held)
            held = []
    if held:
        yield head + ",\n".join(held) + ";\n", len(held)


_CONTROL = {c: None for c in range(32) if c not in (9, 10, 13)}


def cell(value, style: int = 0) -> str:
    """A sheet's cell; places follow from the order, so that a null is a cell too."""
    s = f' s="{style}"' if style else ""
    if value is None:
        return f"<c{s}/>"
    if isinstance(value, bool):
        return f'<c t="b"{s}><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and isfinite(value):
        return f"<c{s}><v>{value!r}</v></c>"
    text = value.replace(tzinfo=None).isoformat(" ") if hasattr(value, "tzinfo") else str(value)
    return f'<c t="inlineStr"{s}><is><t xml:space="preserve">{escape(text.translate(_CONTROL))}</t></is></c>'


def sheet_texts(rows: Iterator, said: dict) -> Iterator[tuple[str, int]]:
    held, size = [], 0
    for row in rows:
        held.append("<row>" + "".join(map(cell, row)) + "</row>")
        size += len(held[-1])
        if size > _PAGE:
            yield "".join(held), len(held)
            held, size = [], 0
    yield "".join(held), len(held)


TEXTS = {"csv": csv_texts, "insert": insert_texts, "sheet": sheet_texts}


class FragmentSink(DataSource):
    """Spark data sink `tessera_fragments`: options folder, kind (csv, sheet, insert), packed, said (JSON for the kind)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_fragments"

    def writer(self, schema, overwrite):
        return FragmentWriter(dict(self.options))


class FragmentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.kind, self.packed, self.said = options["folder"], options["kind"], options.get("packed") == "true", json.loads(options.get("said") or "{}")

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        path = f"{self.folder}/{place}-{uuid.uuid4().hex}"  # attempts do not meet
        size = packed = crc = rows = 0
        pack = zlib.compressobj(6, zlib.DEFLATED, -15) if self.packed else None
        with open(path, "wb") as f:
            for text, n in TEXTS[self.kind](iterator, self.said):
                raw = text.encode("utf-8", "surrogatepass")
                size, crc, rows = size + len(raw), zlib.crc32(raw, crc), rows + n
                packed += f.write(pack.compress(raw) if pack else raw)
            if pack:
                packed += f.write(pack.flush(zlib.Z_FULL_FLUSH))
        return Part(place, path, size, packed, crc, rows)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.at)
        Path(self.folder, "parts.json").write_text(json.dumps([vars(p) for p in parts]))

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def local_path(target: str) -> str:
    return str(target).removeprefix("file://")


class SingleFile:
    """Collects parts beside the target, and puts the target in place or leaves nothing."""

    def __init__(self, target: str):
        self.target = Path(local_path(target))
        self.draft = self.target.with_name(f".{self.target.name}.{uuid.uuid4().hex}")

    def __enter__(self) -> SingleFile:
        self.draft.mkdir(parents=True)
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                os.replace(self.draft / "whole", self.target)
        finally:
            shutil.rmtree(self.draft, ignore_errors=True)

    def parts(self, df: DataFrame, kind: str, packed: bool, **said) -> list[Part]:
        """Has the rows of df written by its tasks; the parts come in the order of its partitions."""
        folder = self.draft / uuid.uuid4().hex
        folder.mkdir()
        df.sparkSession.dataSource.register(FragmentSink)
        df.write.format("tessera_fragments").mode("append").option("folder", str(folder)).option("kind", kind).option("packed", str(packed).lower()).option("said", json.dumps(said)).save()
        return [Part(**p) for p in json.loads((folder / "parts.json").read_text())]

    def text(self, text: str, packed: bool) -> Part:
        """A part that is the driver's own: headers and frames."""
        path, raw = self.draft / uuid.uuid4().hex, text.encode()
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        path.write_bytes(pack.compress(raw) + pack.flush(zlib.Z_FULL_FLUSH) if packed else raw)
        return Part(-1, str(path), len(raw), path.stat().st_size, zlib.crc32(raw), 0)

    def joined(self, parts: list[Part]) -> None:
        """The target as the parts one after the other."""
        with open(self.draft / "whole", "wb") as out:
            for p in parts:
                _copy(p, out)

    def zipped(self, members: list[tuple[str, list[Part]]]) -> None:
        """The target as a zip file with these members."""
        with open(self.draft / "whole", "wb") as out:
            entries = []
            for name, parts in members:
                crc = size = 0
                for p in parts:
                    crc, size = crc_of_both(crc, p.crc, p.size), size + p.size
                packed = sum(p.packed for p in parts) + len(_LAST)
                entries.append((name.encode(), crc, packed, size, out.tell()))
                out.write(_head(*entries[-1][:4]))
                for p in parts:
                    _copy(p, out)
                out.write(_LAST)
            out.write(_directory(entries, out.tell()))


#: the empty last block of a deflate stream
_LAST = b"\x03\x00"


def _copy(part: Part, out) -> None:
    with open(part.path, "rb") as f:
        shutil.copyfileobj(f, out, _BLOCK)


def crc_of_both(first: int, second: int, length: int) -> int:
    """CRC-32 of two strings one after the other, the second of this length: the first one's is moved over that many zero bytes.

    A zero byte is a linear map of the checksum's 32 bits; maps are squared for the bits of the length."""

    def applied(m: list[int], v: int) -> int:
        out = 0
        for k in range(32):
            if v >> k & 1:
                out ^= m[k]
        return out

    step = [(zlib.crc32(b"\0", 0xFFFFFFFF ^ (1 << k)) ^ zlib.crc32(b"\0", 0xFFFFFFFF)) for k in range(32)]
    while length:
        if length & 1:
            first = applied(step, first)
        step = [applied(step, x) for x in step]
        length >>= 1
    return first ^ second


# fixed values: the zip format's records; sizes and places beyond 32 bits go to an extra field
_FULL = 0xFFFFFFFF


def _head(name: bytes, crc: int, packed: int, size: int) -> bytes:
    large = max(packed, size) >= _FULL
    extra = struct.pack("<HHQQ", 1, 16, size, packed) if large else b""
    return struct.pack("<4sHHHHHLLLHH", b"PK\3\4", 45 if large else 20, 0x800, 8, 0, 33, crc, *((_FULL, _FULL) if large else (packed, size)), len(name), len(extra)) + name + extra


def _directory(entries: list[tuple[bytes, int, int, int, int]], start: int) -> bytes:
    out = b""
    for name, crc, packed, size, at in entries:
        large = max(packed, size, at) >= _FULL
        extra = struct.pack("<HHQQQ", 1, 24, size, packed, at) if large else b""
        told = (_FULL, _FULL, _FULL) if large else (packed, size, at)
        out += struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\1\2", 45, 45 if large else 20, 0x800, 8, 0, 33, crc, *told[:2], len(name), len(extra), 0, 0, 0, 0, told[2]) + name + extra
    n, length = len(entries), len(out)
    if start + length >= _FULL or n >= 0xFFFF:
        out += struct.pack("<4sQHHLLQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start) + struct.pack("<4sLQL", b"PK\6\7", 0, start + length, 1)
    return out + struct.pack("<4sHHHHLLH", b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, _FULL), min(start, _FULL), 0)
