"""Shared helpers of the training-data operators: materialised tables and Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import dropped, scratch, shared_folder, written

__all__ = ["dropped", "fresh", "materialize", "mix64", "scratch", "shared_folder", "slices", "text_of", "utf8"]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the folder of spark.checkpoint.dir and reads it back."""
    return written(df, name)


def text_of(column) -> F.Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, nulls as empty, without a copy of the bytes."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many leading underscores as keep it apart from all in `taken`, whatever their case."""
    known, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20, rows: int = 65_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows of about `limit` bytes of text, and of `rows` rows at most (one row at least)."""
    off, _ = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
