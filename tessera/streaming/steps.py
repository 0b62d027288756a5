"""The stateless steps of an entity over a stream, and windowed counts with late data.

Projection, derived columns, filters, replacements without fills, and unnesting work row by row and mean the same on
a stream. Surrogate ids, fills and keep-first duplicates need all rows and are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.project import Entity
from ..functions.replace import apply_replacements, needs_order
from ..operators.extra_columns import add_extra_columns
from ..operators.filters import apply_filters
from ..operators.reshape import unnest
from ..operators.shared import quoted
from ..operators.subset import select_columns


class StreamError(ValueError):
    pass


def apply_entity(df: DataFrame, entity: Entity) -> DataFrame:
    if entity.drop_duplicates or entity.append or entity.branches or entity.foreign_keys:
        raise StreamError(f"{entity.name}: duplicates, unions and links need whole tables")
    if any(needs_order(s) for s in entity.replacements.values()):
        raise StreamError(f"{entity.name}: fills need whole tables")
    df, _ = add_extra_columns(df, entity.extra_columns)
    df = apply_replacements(df, entity.replacements)
    df = apply_filters(df, entity.filters, {}, "extract")
    if entity.unnest:
        df = apply_filters(unnest(df, entity.unnest), entity.filters, {}, "after_unnest")
        return df
    wanted = [*entity.keys, *entity.columns, *entity.extra_columns]
    return select_columns(df, wanted) if wanted else df


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def windowed_counts(df: DataFrame, time: str, keys: Sequence[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows in each window and key; rows later than `late` behind the latest seen are not counted."""
    moved = df.withWatermark(time, late) if df.isStreaming else df
    window = F.window(quoted(time), width, slide) if slide else F.window(quoted(time), width)
    return moved.groupBy(window.alias("w"), *[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n_rows")


def first_seen(df: DataFrame, keys: Sequence[str], time: str, late: str = "1 hour") -> DataFrame:
    """Drops repeats of a key that arrive within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
