"""Snapshots of built tables, addressed by what they were made from.

A snapshot's address is a hash of the configuration of its entity and of all that it needs, and of fingerprints of the data
below: files by size and time, given tables by their plans and files, other sources by a version that the caller tells. A change
thus gives other addresses to the changed entity and to what depends on it, and to nothing else.

Snapshots are looked for in memory, then in the shared folder, where other sessions and a restarted one find them too. They are written
under another name and moved, so that a half-written one is never found. What is too old, or beyond the number kept, is deleted.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config.project import Project, closure
from ..operators.shared import quoted, removed, shared_folder
from ..sources.registry import source_options


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, size, time) of a file, or of all files below a folder; none if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    found, listed = [], system.listFiles(where, True)
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def fingerprint(df: DataFrame) -> list:
    """Equal for frames that read the same data the same way."""
    plan = df._jdf.queryExecution().analyzed().toString()
    files = [_files(df.sparkSession, f) for f in sorted(df.inputFiles())]
    if not files or "RDD" in plan:
        return [df.semanticHash(), plan]  # rows of this session: the plan's own numbers tell them apart
    numbers: dict[str, str] = {}
    plain = re.sub(r"#\d+L?", lambda m: numbers.setdefault(m[0], f"#{len(numbers)}"), plan)
    return [df.semanticHash(), plain, files]


def addresses(spark: SparkSession, project: Project, names: list[str], given: Mapping[str, DataFrame] | None = None, versions: Mapping[str, object] | None = None, folder: str = ".") -> dict[str, str]:
    """The address of every entity that the named ones need. versions: of sources that show no change themselves, by data source or entity."""
    given, versions, parts = given or {}, versions or {}, {}
    tables = {n: fingerprint(df) for n, df in given.items()}
    for n in closure(project, names):
        entity = project.entities[n]
        driver, options = source_options(project, entity, folder)
        below: list = [versions.get(n), versions.get(entity.data_source or "")]
        below += [tables.get(t) for t in (n, entity.source, project.options.get("default_entity"), *[b.source for b in entity.branches], *[a.source for a in entity.appended()])]
        below += [tables.get(f.get("other_entity") or f.get("entity")) for f in entity.filters]
        if options.get("filename"):
            below.append(_files(spark, str(options["filename"])))
        parts[n] = [dict(entity.raw), driver, {k: str(v) for k, v in options.items()}, below]
    out = {}
    for n in parts:
        whole = {m: parts[m] for m in sorted(closure(project, [n]))}
        out[n] = hashlib.sha256(json.dumps(whole, sort_keys=True, default=str).encode()).hexdigest()
    return out


@dataclass
class Snapshots:
    """A store of tables by address. seconds: how long one holds; most: how many are kept."""

    spark: SparkSession
    folder: str | None = None
    seconds: float = 300
    most: int = 64
    held: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)

    def path(self, address: str) -> str:
        if self.folder is None:
            self.folder = f"{shared_folder(self.spark)}/tessera-snapshots"
        return f"{self.folder}/{address}"

    def _system(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def get(self, address: str) -> DataFrame | None:
        found = self.held.get(address)
        if found:
            if time.time() - found[0] < self.seconds:
                return found[1]
            self.forget(address)
        system, mark = self._system(self.path(address) + "/kept.json")
        if not system.exists(mark):
            return None
        written = system.getFileStatus(mark).getModificationTime() / 1000
        if time.time() - written >= self.seconds:
            removed(self.spark, self.path(address))
            return None
        said = json.loads(self.spark.read.text(mark.toString(), wholetext=True).first()[0])
        df = self._named(address, said["names"], T.StructType.fromJson(said["schema"]))
        self.held[address] = written, df
        return df

    def _named(self, address: str, names: list[str], schema: T.StructType) -> DataFrame:
        df = self.spark.read.schema(T.StructType([T.StructField(f"c{i}", T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType) for i, f in enumerate(schema)])).parquet(self.path(address) + "/rows")
        return df.select(*[(F.lit(None) if isinstance(f.dataType, T.NullType) else F.col(f"c{i}")).alias(n) for i, (n, f) in enumerate(zip(names, schema, strict=True))])

    def put(self, address: str, df: DataFrame) -> DataFrame:
        """Writes df's rows, and the names and types of its columns last; the first complete snapshot of an address stays."""
        goal, draft = self.path(address), f"{self.path(address)}.{uuid.uuid4().hex}"
        columns = [(F.lit(None).cast("string") if isinstance(f.dataType, T.NullType) else quoted(f.name)).alias(f"c{i}") for i, f in enumerate(df.schema)]
        df.select(*columns).write.option("compression", "zstd").parquet(draft + "/rows")
        system, mark = self._system(draft + "/kept.json")
        out = system.create(mark)
        out.write(bytearray(json.dumps({"names": df.columns, "schema": df.schema.jsonValue()}).encode()))
        out.close()
        _, where = self._system(goal)
        if system.exists(where) or not system.rename(self._system(draft)[1], where):
            removed(self.spark, draft)
        kept = self._named(address, df.columns, df.schema)
        self.held[address] = time.time(), kept
        return kept

    def forget(self, address: str) -> None:
        self.held.pop(address, None)
        removed(self.spark, self.path(address))

    def sweep(self, needed: Collection[str] = ()) -> None:
        """Deletes what is too old or too many, the oldest first, with its files; not what a caller is about to read."""
        old = [a for a, (at, _) in self.held.items() if time.time() - at >= self.seconds]
        rest = sorted((a for a in self.held if a not in old), key=lambda a: self.held[a][0])
        for address in [*old, *rest[: max(0, len(rest) - self.most)]]:
            if address not in needed:
                self.forget(address)
