"""Steps that need rows before or after, over a stream: the first row of a key, fills in row order, surrogate ids.

The first two keep state for each key and give out a row once the watermark has passed it: no earlier row can come then, so that over all
rows that are not late the results are those of the batch operators in the order of event time. Rows are handed to the state as
texts of their whole content, so that no value changes its type on the way. A key's rows are one task's, as an order demands; what a key
holds is one row, or the rows of the time by which rows may be late.

Surrogate ids are given from a ledger of the ids given before, a folder with one part for each micro-batch. A batch that is run again
after a failure finds the same ledger, gives the same ids and writes its part anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.identity import numbered
from ..operators.shared import fresh, pick, quoted, removed

_AS_WRITTEN = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _text(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), _AS_WRITTEN)


def _named(df: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """Keys as k0.., the watermarked time as `at`, its microseconds as `us`, and the row's text."""
    whole = _text(*[quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = df.select(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)], quoted(time).alias("at"), whole.alias("row"))
    return rows.withWatermark("at", late).withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))


def _back(text: Column, fields: list[T.StructField]) -> Column:
    return F.from_json(text, T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)]), _AS_WRITTEN)


def _restored(made: DataFrame, like: DataFrame) -> DataFrame:
    read = made.withColumn("r", _back(F.col("row"), list(like.schema.fields)))
    return read.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(like.columns)])


def _after(us: int) -> int:
    """The first watermark (in milliseconds) that has passed a time."""
    return us // 1000 + 1


def keep_first(df: DataFrame, keys: Sequence[str], time: str, late: str = "1 hour") -> DataFrame:
    """Of the rows of a key the one of least event time (ties: of least content), once no earlier one can come."""
    if not df.isStreaming:
        from ..operators.subset import drop_duplicates

        text = fresh("__text", df.columns)
        ordered = df.withColumn(text, _text(*[quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)]))
        return drop_duplicates(ordered, list(keys), [time, text]).drop(text)

    def least(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, us, row = state.get if state.exists else (False, None, None)
        if state.hasTimedOut:
            state.update((True, us, None))  # the key's later rows are repeats
            yield pd.DataFrame({"row": [row]})
            return
        for frame in frames:
            if done:
                continue
            own = min(zip(frame["us"].tolist(), frame["row"].tolist(), strict=True))
            if us is None or own < (us, row):
                us, row = own
        if not done:
            state.update((False, us, row))
            state.setTimeoutTimestamp(max(_after(us), state.getCurrentWatermarkMs() + 1))

    rows = _named(df, keys, time, late)
    grouped = rows.groupBy(*[f"k{i}" for i in range(len(keys))])
    made = grouped.applyInPandasWithState(least, "row string", "done boolean, us long, row string", "append", GroupStateTimeout.EventTimeTimeout)
    return _restored(made, df)


def forward_fill(df: DataFrame, keys: Sequence[str], columns: Sequence[str], time: str, late: str = "1 hour") -> DataFrame:
    """Nulls of the columns take the last value of their key before them in event time (ties: in the order of content)."""
    if not df.isStreaming:
        from pyspark.sql import Window

        text = fresh("__text", df.columns)
        ordered = df.withColumn(text, _text(*[quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)]))
        so_far = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(quoted(time), text).rowsBetween(Window.unboundedPreceding, 0)
        return ordered.withColumns({c: F.last(quoted(c), True).over(so_far) for c in columns}).drop(text)
    n = len(columns)

    def fill(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, waiting = state.get if state.exists else ([None] * n, [])
        carry, waiting = list(carry), [tuple(w) for w in waiting]
        if not state.hasTimedOut:
            for frame in frames:
                values = [frame[f"v{i}"].tolist() for i in range(n)]
                waiting += [(us, row, [x if isinstance(x, str) else None for x in v]) for us, row, *v in zip(frame["us"].tolist(), frame["row"].tolist(), *values, strict=True)]
        waiting.sort(key=lambda w: w[:2])
        passed, out = state.getCurrentWatermarkMs(), []
        while waiting and _after(waiting[0][0]) <= passed:
            us, row, values = waiting.pop(0)
            carry = [v if v is not None else c for v, c in zip(values, carry, strict=True)]
            out.append((row, *carry))
        state.update((carry, [(us, row, list(v)) for us, row, v in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(_after(waiting[0][0]), passed + 1))
        if out:
            yield pd.DataFrame(out, columns=["row", *[f"v{i}" for i in range(n)]])

    rows = _named(df, keys, time, late)
    whole = _back(F.col("row"), list(df.schema.fields))
    own = [whole[f"c{df.columns.index(c)}"] for c in columns]
    own = [F.when(v.isNotNull(), _text(v.alias("c0"))) for v in own]
    rows = rows.withColumns({f"v{i}": v for i, v in enumerate(own)})
    grouped = rows.groupBy(*[f"k{i}" for i in range(len(keys))])
    out = "row string" + "".join(f", v{i} string" for i in range(n))
    held = "carry array<string>, waiting array<struct<us: long, row: string, v: array<string>>>"
    made = grouped.applyInPandasWithState(fill, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    read = made.withColumn("r", _back(F.col("row"), list(df.schema.fields)))
    value = {c: F.when(F.col(f"v{i}").isNotNull(), _back(F.col(f"v{i}"), [df.schema[c]])["c0"]) for i, c in enumerate(columns)}
    return read.select(*[(value[c] if c in value else F.col(f"r.c{i}")).alias(c) for i, c in enumerate(df.columns)])


def with_ids(batch: DataFrame, batch_id: int, keys: Sequence[str], ledger: str, name: str = "system_id", order: Sequence[str] = ()) -> DataFrame:
    """The rows of a micro-batch with the ids of their keys: those given before, and the next numbers for new keys in order."""
    spark = batch.sparkSession
    kinds = T.StructType([batch.schema[k] for k in keys])
    part = f"{ledger}/part={batch_id}"
    known = spark.read.schema(T.StructType([*kinds, T.StructField(name, T.LongType()), T.StructField("part", T.LongType())])).option("basePath", ledger)
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    before = known.parquet(ledger).where(F.col("part") < batch_id).drop("part") if system.exists(where) else spark.createDataFrame([], T.StructType([*kinds, T.StructField(name, T.LongType())]))
    same = lambda a, b: [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys]
    new = pick(batch, list(keys)).distinct().alias("n").join(before.alias("b"), same("n", "b"), "left_anti")
    top = before.agg(F.coalesce(F.max(quoted(name)), F.lit(0)).alias("m")).first()["m"]
    given = numbered(new, name, list(order or keys), F.lit(top + 1))
    removed(spark, part)
    given.select(*[quoted(k) for k in keys], quoted(name)).write.parquet(part)
    every = known.parquet(ledger).where(F.col("part") <= batch_id).drop("part")
    return batch.alias("n").join(every.alias("b"), same("n", "b"), "left").select(F.col(f"b.`{name}`").alias(name), *[F.col(f"n.`{c}`") for c in batch.columns])


def write_with_ids(stream: DataFrame, keys: Sequence[str], ledger: str, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str = "system_id", order: Sequence[str] = (), **trigger) -> StreamingQuery:
    """Starts the stream; sink takes each micro-batch with its ids, and its number, by which a repeated batch is known."""
    started = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(with_ids(batch, n, keys, ledger, name, order), n))
    return (started.trigger(**trigger) if trigger else started).start()
