"""Helpers that operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir. Only local masters, as in tests, do without:
    a temporary folder is one folder for all of their tasks."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back, column by column where few are asked for.

    A lost executor then costs a reread, not a recomputation. The files go with the `scratch` around, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at its end, when nothing reads them any more, but for those handed to the function it gives.

    What is lazy must be written before: `with scratch() as kept: out = kept(written(work(df)))`. After an error all of them go."""
    first, keep = len(_written), set()

    def kept(df: DataFrame) -> DataFrame:
        keep.add(df._written_at)
        return df

    try:
        yield kept
    except BaseException:
        keep.clear()
        raise
    finally:
        for spark, path in _written[first:]:
            if path not in keep:
                removed(spark, path)
        _written[first:] = [(s, p) for s, p in _written[first:] if p in keep]


def dropped(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more; other frames are left alone."""
    path = vars(df).get("_written_at")
    if path:
        removed(df.sparkSession, path)
        _written[:] = [(s, p) for s, p in _written if p != path]


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            removed(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def fixed(df: DataFrame) -> DataFrame:
    """df with its rows and ids settled, whatever its columns are called."""
    kinds = [f.dataType for f in df.schema.fields]
    plain = df.toDF(*[f"c{i}" for i in range(len(kinds))])
    stored = written(plain.select(*[F.col(f"c{i}").cast("string" if isinstance(k, T.NullType) else k).alias(f"c{i}") for i, k in enumerate(kinds)]), "fixed")
    back = stored.select(*[F.lit(None).alias(f"c{i}") if isinstance(k, T.NullType) else F.col(f"c{i}") for i, k in enumerate(kinds)])
    return back.toDF(*df.columns)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[quoted(n) for n in names])


def fresh(wanted: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while wanted in taken:
        wanted += "_"
    return wanted
