"""Files that hold an entity's fixed values, changed only by who has seen their latest version."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..config.directives import read_values
from .values import table_of


class Changed(ValueError):
    """The file is not the one that was read."""


def etag(path: str | Path) -> str:
    p = Path(path)
    files = sorted(f for f in p.rglob("*") if f.is_file()) if p.is_dir() else [p]
    h = hashlib.sha256()
    for f in files:
        h.update(f.name.encode() + f.read_bytes())
    return h.hexdigest()


def get_values(spark: SparkSession, path: str | Path) -> tuple[DataFrame, str]:
    """The rows of a CSV, TSV (text) or Parquet file (typed), and its etag."""
    path = Path(path)
    if path.suffix == ".parquet":
        return spark.read.parquet(str(path)), etag(path)
    rows = read_values(path)
    names = list(rows[0]) if rows else []
    return table_of(spark, [[r[n] for n in names] for r in rows], names), etag(path)


def update_values(path: str | Path, columns: list[str], rows: list[list], seen: str | None = None) -> str:
    """Writes rows (as edited by hand) in place of the file, and gives its new etag; raises Changed if `seen` is not its etag."""
    path = Path(path)
    if seen is not None and path.exists() and etag(path) != seen:
        raise Changed(f"{path.name} was changed by someone else")
    if any(len(r) != len(columns) for r in rows):
        raise ValueError("rows must be as wide as columns")
    fresh = path.with_name(path.name + ".new")
    if path.suffix == ".parquet":
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)}), fresh)
    else:
        import csv

        with open(fresh, "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f, delimiter="\t" if path.suffix == ".tsv" else ",")
            out.writerow(columns)
            out.writerows([["" if v is None else v for v in r] for r in rows])
    fresh.replace(path)
    return etag(path)
