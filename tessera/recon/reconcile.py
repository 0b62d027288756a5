"""Reconciliation: matching source values to target ids, by a pluggable scorer, and applying the matches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib import request

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators.shared import fixed, quoted, shared_folder
from .calls import Ledger, post

ACCEPT, REVIEW = 0.95, 0.70
CANDIDATES = "query string, id string, name string, score double"
MAPPING = ["source_value", "target_id", "confidence", "notes"]


def source_rows(entity: str, source: str | Mapping | None, tables: Mapping[str, DataFrame], sql: Callable[[str, str], DataFrame] | None = None) -> DataFrame:
    """Where the values come from: the entity itself, another table, or {data_source, query}."""
    if isinstance(source, Mapping):
        if sql is None:
            raise ValueError("a query source needs a way to run it")
        return sql(source.get("data_source"), source["query"])
    name = source or entity
    if name not in tables:
        raise ValueError(f"no table {name}")
    return tables[name]


def queries(df: DataFrame, field: str, properties: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct non-blank values with their properties: query, properties (map)."""
    items = [x for p, c in (properties or {}).items() if c in df.columns for x in (F.lit(p), F.coalesce(quoted(c).cast("string"), F.lit("")))]
    mapped = F.create_map(*items) if items else F.expr("cast(map() as map<string,string>)")
    rows = df.select(quoted(field).cast("string").alias("query"), mapped.alias("properties")).where(F.trim("query") != "")
    return rows.groupBy("query").agg(F.min(F.to_json("properties")).alias("_p")).select("query", F.from_json("_p", "map<string,string>").alias("properties"))


def local_scores(asked: DataFrame, targets: DataFrame, id_col: str, name_col: str, top: int = 5, least: float = 0.3) -> DataFrame:
    """The `top` candidates by trigrams of normalised names, shared / union, of all that reach `least`.

    Two sets of which s / union is `least` or more share one of the rarest size - ceil(least * size) + 1 trigrams of each, so that
    pairs come from a join on these: no candidate is missed, and common trigrams pair few names."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        padded = F.concat(F.lit("  "), normalize_text(F.col("_t")), F.lit(" "))
        return df.withColumn("_g", F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))))

    ours = grams(asked.select("query", F.col("query").alias("_t")), "query").select("query", F.col("_g").alias("_q"))
    theirs = grams(targets.select(quoted(id_col).cast("string").alias("id"), quoted(name_col).cast("string").alias("name"), quoted(name_col).cast("string").alias("_t")).where("name is not null"), "id").select("id", "name", F.col("_g").alias("_n"))
    frequency = theirs.select(F.explode("_n").alias("g")).groupBy("g").count()
    rarest = lambda df, keys, c: (
        df.select(*keys, F.size(c).alias("_size"), F.explode(c).alias("g"))
        .join(frequency, "g", "left")
        .withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("count", F.lit(0)), "g")))
        .where(F.col("_r") <= F.col("_size") - F.ceil(F.lit(least) * F.col("_size") - 1e-9) + 1)
        .select(*keys, "g")
    )
    pairs = rarest(ours, ["query"], "_q").join(rarest(theirs, ["id", "name"], "_n"), "g").select("query", "id", "name").distinct()
    scored = pairs.join(ours, "query").join(theirs.select("id", "name", "_n"), ["id", "name"])
    score = F.size(F.array_intersect("_q", "_n")) / F.size(F.array_union("_q", "_n"))
    ranked = scored.select("query", "id", "name", (100 * score).alias("score")).where(F.col("score") >= 100 * least - 1e-9).withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("_r") <= top).drop("_r")


def http_scores(
    asked: DataFrame, url: str, kind: str | None = None, batch: int = 50, timeout: float = 30, ledger: str | None = None, in_flight: int = 8, attempts: int = 6, pause: float = 0.5
) -> DataFrame:
    """Candidates of an OpenRefine-style service, asked by the executors in batches, `in_flight` calls at a time.

    Queries are settled and dealt first, so that a repeated or speculative task, or another action on the result, has the same batches and
    finds their answers in the ledger; a ledger that is named serves later runs too. It must be a folder that all tasks have mounted."""
    spark = asked.sparkSession
    folder = (ledger or f"{shared_folder(spark)}/tessera-calls-{uuid.uuid4().hex}").removeprefix("file://")
    if "://" in folder:
        raise ValueError(f"{folder} is no mounted folder; name one as the ledger")
    book = Ledger(folder, in_flight=in_flight, lease=2 * (timeout + pause * 2**attempts) * attempts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                body = {}
                for i, (q, props) in enumerate(zip(part["query"], part["properties"], strict=True)):
                    body[f"q{i}"] = {"query": q, **({"type": kind} if kind else {}), "properties": [{"pid": k, "v": v} for k, v in sorted(dict(props or {}).items()) if v]}
                data = ("queries=" + request.quote(json.dumps(body))).encode()
                found = book.once([url, body], lambda data=data: post(url, data, timeout, attempts, pause))
                rows = [(q, str(c["id"]), c.get("name"), float(c.get("score", 0))) for i, q in enumerate(part["query"]) for c in found.get(f"q{i}", {}).get("result", [])]
                yield pd.DataFrame(rows, columns=["query", "id", "name", "score"])

    return fixed(asked.select("query", "properties").sortWithinPartitions("query")).mapInPandas(run, CANDIDATES)


def classify(asked: DataFrame, candidates: DataFrame, accept: float = ACCEPT, review: float = REVIEW) -> DataFrame:
    """source_value, target_id (trailing number of the best candidate's id), confidence (score / 100), status: accepted, review or unmatched."""
    best = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where("_r = 1")
    out = asked.select("query").distinct().join(best, "query", "left")
    confidence = F.coalesce(F.col("score") / 100, F.lit(0.0))
    number = F.regexp_extract(F.col("id"), r"(?:^|/)(\d+)/?$", 1).try_cast("bigint")
    status = F.when((confidence >= accept) & number.isNotNull(), "accepted").when((confidence >= review) & number.isNotNull(), "review").otherwise("unmatched")
    return out.select(F.col("query").alias("source_value"), F.when(status != "unmatched", number).alias("target_id"), confidence.alias("confidence"), F.col("name").alias("target_name"), status.alias("status"))


def apply_mapping(df: DataFrame, field: str, mapping: DataFrame, target: str) -> DataFrame:
    """df with the target id of each row's value; unmapped rows get null."""
    ids = mapping.where("target_id is not null").groupBy(F.col("source_value").alias("__v")).agg(F.max("target_id").alias("__t"))
    rest = [c for c in df.columns if c != target]
    return df.join(ids, quoted(field).cast("string") == F.col("__v"), "left").select(*[quoted(c) for c in rest], F.col("__t").cast("long").alias(target))


def upsert(mapping: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes replace entries of the same value."""
    return mapping.join(changes.select("source_value"), "source_value", "left_anti").select(*MAPPING).unionByName(changes.select(*MAPPING))


def delete(mapping: DataFrame, values: Sequence[str]) -> DataFrame:
    return mapping.where(~F.col("source_value").isin(list(values)))


def mark_unmatched(mapping: DataFrame, values: Sequence[str], note: str = "will not match") -> DataFrame:
    rows = mapping.sparkSession.createDataFrame([(v, None, None, note) for v in values], "source_value string, target_id long, confidence double, notes string")
    return upsert(mapping, rows)
