"""The corpus pipeline: quality rules, exact dedup, near dedup, removal of repeated strings, packing.

Each stage is written as Parquet and read again as the next one's documents, so that a lost executor
costs a reread. All but the last return the columns of `documents`. Whether a stage can be written in SQL
is told by its operator; MinHash, learned rules and suffixes cannot, so that there is no SQL for the
whole (ORACLE_SQL is None) and the tests hold it against a brute-force version.

Defined results: a document with a null, empty or blank text fails the base rules of the first stage; labels may be missing or of one
kind only, then the base rules alone decide there; rows that share an id are judged one by one, stay or go together in near dedup,
and are ordered by a hash of their texts when repeats are removed; texts of any length go through whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, exact_dedup, near_dedup, packing, quality, suffix_dedup
from tessera.llm.queries import tokenizer

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose 5-word shingles agree to 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a 100-byte string repeats from an earlier place; n_chars follows the text.

    Where a cut would split a character, the rest of that character goes too.
    """
    return suffix_dedup.documents_without_repeats(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in as few sequences as best-fit finds."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("best_fit_packing", best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with common.scratch() as kept:  # what a stage writes on its way goes once its result is written
            docs = kept(common.materialize(stage(spark, before, sf_dir), name))
        common.dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
