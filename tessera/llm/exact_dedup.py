"""Exact dedup by skew-safe combining, with DataFrame functions only.

Copies are combined in three stages, each of which groups by the digest and by the whole text:
every task combines its own rows (the partial aggregate), salted digest groups are merged over the
cluster, and the winners of the salts are combined for each digest. A group that holds a third of
all rows thus reaches any single task as one row for each upstream task or salt at most.

Defined results: null text counts as empty; a null id is smaller than any other; rows that share id
and text are one row seen twice and carry the same decision (`drop_exact_duplicates` keeps one of
them); extra columns, whatever their names, do not take part; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, text_of


def _winners(base: DataFrame, salts: int) -> DataFrame:
    local = base.groupBy("_d", "_t", F.pmod(F.xxhash64("_i"), F.lit(salts)).alias("_s")).agg(
        F.max("_i").alias("_k"), F.count(F.lit(1)).alias("_n")
    )
    # dealt by the digest alone, so that texts of one digest meet and can be told apart
    whole = local.repartition("_d").groupBy("_d", "_t").agg(F.max("_k").alias("keep_id"), F.sum("_n").alias("group_size"))
    return whole.select("_d", F.xxhash64("_t").alias("_f"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    The winners were separated by whole texts; rows find theirs by SHA-256 plus an independent
    64-bit hash. Should two different texts ever agree in both, the query fails instead of mixing them.
    """
    base = docs.select(F.col(id_col).alias("_i"), text_of(text_col).alias("_t")).withColumn("_d", F.unhex(F.sha2("_t", 256)))
    winners = _winners(base, salts).groupBy("_d", "_f").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts")
    )
    group_size = F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two texts share a SHA-256 digest and a 64-bit hash")).cast("long")
    )
    narrow = base.select("_i", "_d", F.xxhash64("_t").alias("_f"))
    return narrow.join(winners, ["_d", "_f"]).select(
        F.col("_i").alias("doc_id"),
        "keep_id",
        group_size.alias("group_size"),
        F.col("_i").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_d")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of docs, all columns, that stay: of equal texts the one with the largest id, once."""
    groups = exact_groups(docs, id_col, text_col, salts).where("kept")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    i, n, d, row = fresh(docs.columns, "id", "null", "digest", "row")
    keep = groups.select(known("doc_id").alias(i), F.col("doc_id").isNull().alias(n), F.unhex("text_sha256").alias(d)).distinct()
    keyed = docs.withColumns({i: known(id_col), n: F.col(id_col).isNull(), d: F.unhex(F.sha2(text_of(text_col), 256))})
    # the window needs no shuffle besides the join's
    once = Window.partitionBy(i, n, d).orderBy(F.col(text_col).desc_nulls_last())
    rows = keyed.join(keep, [i, n, d], "left_semi")
    return rows.withColumn(row, F.row_number().over(once)).where(F.col(row) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
