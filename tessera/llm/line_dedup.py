"""Line dedup against a sharded minimal perfect hash of all line keys.

A line's key is the line without the white space [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased. Keys of at least
`min_chars` code points found in at least two documents lose their lines everywhere but in the
smallest id that holds them.

1. Every slice of documents combines its own keys (128-bit hash, number of documents, smallest and
   largest id) and deals them to shards. A shard's keys get a minimal perfect hash (levels of bit
   arrays with ranks), whose slots index three arrays: 64-bit fingerprints, saturating document
   counts and smallest ids. The shards are written to the shared folder.
2. Documents probe the arrays: a slice's distinct (key, document) pairs go to the key's shard, which
   answers with the keys to drop. Slot and fingerprint together test the whole 128-bit hash but for
   a chance of 2**-64 a probe.
3. Keys in so many documents that their probes would swell one shard are at most `HOT_KEYS` by
   construction (a key counts as hot from 1/HOT_KEYS of all possible lines on); they are sent to every task.

Defined results: null or empty text is one empty line; a null id is one document, smaller than
any other; rows that share an id are one document; empty tables give empty results; extra columns
take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, slices, text_of

_SPACE = b" \t\n\x0b\x0c\r"
NULL_ID = -(2**63)
HOT_KEYS = 50_000
#: characters of text behind one shard: bounds its keys, whatever the number of documents
SHARD_CHARS = 24_000_000
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
STAT = np.dtype([("a", "<u8"), ("b", "<u8"), ("n", "<i8"), ("lo", "<i8"), ("hi", "<i8")])
PROBE = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8")])


def line_digests(text: str, min_chars: int) -> list[bytes | None]:
    """For each line the 128-bit hash of its key; None where the key is too short to count."""
    out = []
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(_SPACE)
        n = len(key)
        if n < min_chars or (n < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _pairs(batch: pa.RecordBatch, min_chars: int) -> np.ndarray:
    """Distinct (key, document) of a slice."""
    digests, owners = [], []
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        own = {d for d in line_digests(text, min_chars) if d is not None}
        digests += own
        owners += [NULL_ID if i is None else i] * len(own)
    out = np.empty(len(digests), PROBE)
    keys = np.frombuffer(b"".join(digests), KEY)
    out["a"], out["b"], out["doc"] = keys["a"], keys["b"], owners
    return out


def _combine(stats: np.ndarray) -> np.ndarray:
    """One entry per key: documents added up, smallest and largest id."""
    if not len(stats):
        return stats
    stats = stats[np.lexsort((stats["b"], stats["a"]))]
    first = np.flatnonzero(np.r_[True, (stats["a"][1:] != stats["a"][:-1]) | (stats["b"][1:] != stats["b"][:-1])])
    out = stats[first].copy()
    out["n"] = np.add.reduceat(stats["n"], first)
    out["lo"] = np.minimum.reduceat(stats["lo"], first)
    out["hi"] = np.maximum.reduceat(stats["hi"], first)
    return out


def _dealt(entries: np.ndarray, shards: int) -> pa.RecordBatch:
    shard = (entries["a"] % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    entries, shard = entries[order], shard[order]
    names, first = np.unique(shard, return_index=True)
    parts = [entries[s:e].tobytes() for s, e in zip(first, [*first[1:], len(entries)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(parts, pa.binary())], ["shard", "entries"])


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: at each level, keys alone in their bit stay; the others go on."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.ranks = np.r_[np.uint64(0), np.cumsum(np.bitwise_count(words).astype(np.uint64))]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix64(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(keys):
            size = max(64, -(-2 * len(keys) // 64) * 64)
            at = cls._at(keys, level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
            level += 1
            if level > 64:
                raise ValueError("keys repeat")
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has it (never so for a member)."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = self._at(keys[left], level, size) + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.uint64)
            out[left[hit]] = (self.ranks[word] + below)[hit].astype(np.int64)
            left, base = left[~hit], base + size
        return out


INDEX = "shard int, sizes array<long>, bits binary, fingerprints binary, counts binary, first_ids binary, hot binary"


def build_index(docs: DataFrame, id_col: str, text_col: str, min_chars: int, shards: int, hot_at: int) -> DataFrame:
    """One row per shard: the perfect hash, the three arrays and the shard's hot keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 16 << 20):
                pairs = _pairs(batch, min_chars)
                stats = np.empty(len(pairs), STAT)
                stats["a"], stats["b"], stats["n"], stats["lo"], stats["hi"] = pairs["a"], pairs["b"], 1, pairs["doc"], pairs["doc"]
                yield _dealt(_combine(stats), shards)

    def index(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        stats = _combine(np.frombuffer(b"".join(parts["entries"]), STAT))
        # the level hash sees both halves, so that keys alike in one half stay apart
        mph = PerfectHash.build(_slot_key(stats["a"], stats["b"]))
        slot = mph.slots(_slot_key(stats["a"], stats["b"]))
        by_slot = np.empty_like(stats)
        by_slot[slot] = stats
        several = by_slot["lo"] != by_slot["hi"]
        counts = np.where(several, np.clip(by_slot["n"], 2, 255), 1).astype(np.uint8)
        hot = stats[(stats["n"] >= hot_at) & (stats["lo"] != stats["hi"])]
        return pd.DataFrame(
            {
                "shard": [key[0]],
                "sizes": [mph.sizes],
                "bits": [mph.words.tobytes()],
                "fingerprints": [by_slot["b"].tobytes()],
                "counts": [counts.tobytes()],
                "first_ids": [by_slot["lo"].tobytes()],
                "hot": [hot.tobytes()],
            }
        )

    rows = docs.select(F.col(id_col).cast("long"), text_of(text_col))
    return materialize(rows.mapInArrow(keys, "shard int, entries binary").groupBy("shard").applyInPandas(index, INDEX), "line-index")


def _slot_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ mix64(b)


def _answers(key: tuple, index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, key) to drop, of one shard's probes."""
    out = {"doc_id": [], "key": []}
    if len(index) and len(probes):
        row = index.iloc[0]
        mph = PerfectHash(list(row["sizes"]), np.frombuffer(row["bits"], np.uint64))
        prints, counts, first = np.frombuffer(row["fingerprints"], np.uint64), np.frombuffer(row["counts"], np.uint8), np.frombuffer(row["first_ids"], np.int64)
        for part in probes["entries"]:
            asked = np.frombuffer(part, PROBE)
            slot = mph.slots(_slot_key(asked["a"], asked["b"]))
            drop = (slot >= 0) & (prints[slot] == asked["b"]) & (counts[slot] >= 2) & (first[slot] != asked["doc"])
            found = asked[drop]
            keys = np.empty(len(found), KEY)
            keys["a"], keys["b"] = found["a"], found["b"]
            out["doc_id"] += found["doc"].tolist()
            out["key"] += [k.tobytes() for k in keys]
    return pd.DataFrame(out).astype({"doc_id": "int64"})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, digests_only: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, and the kept text (or its SHA-256 alone)."""
    spark = docs.sparkSession
    chars = docs.select(F.sum(F.length(F.col(text_col)))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    hot_at = max(1000, chars // (min_chars + 1) // HOT_KEYS)
    index = build_index(docs, id_col, text_col, min_chars, shards, hot_at)
    hot = np.concatenate([np.frombuffer(r["hot"], STAT) for r in index.select("hot").where(F.length("hot") > 0).collect()] or [np.empty(0, STAT)])
    keys = np.empty(len(hot), KEY)
    keys["a"], keys["b"] = hot["a"], hot["b"]
    first_of = spark.sparkContext.broadcast(dict(zip([k.tobytes() for k in keys], hot["lo"].tolist(), strict=True)))  # at most HOT_KEYS entries
    hot_keys = np.sort(hot["a"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 16 << 20):
                pairs = _pairs(batch, min_chars)
                if len(hot_keys):  # hot keys are answered at the document
                    at = np.searchsorted(hot_keys, pairs["a"])
                    maybe = np.flatnonzero(hot_keys[np.minimum(at, len(hot_keys) - 1)] == pairs["a"])
                    asked = np.empty(len(maybe), KEY)
                    asked["a"], asked["b"] = pairs["a"][maybe], pairs["b"][maybe]
                    known = first_of.value
                    pairs = np.delete(pairs, [i for i, k in zip(maybe, asked, strict=True) if k.tobytes() in known])
                yield _dealt(pairs, shards)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = first_of.value
        for whole in batches:
            for batch in slices(whole, 1):
                rows = []
                for i, text, drop in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    own = NULL_ID if i is None else i
                    if not known and not drop:
                        n, kept = text.count("\n") + 1, text
                        gone = 0
                    else:
                        drop, lines = set(drop or ()), text.split("\n")
                        digests = line_digests(text, min_chars)
                        keep = [d is None or not (d in drop or known.get(d, own) != own) for d in digests]
                        n, gone = len(lines), len(lines) - sum(keep)
                        kept = "\n".join([x for x, k in zip(lines, keep, strict=True) if k]) if gone else text
                    rows.append((i, n, gone, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest() if digests_only else kept))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                    ["doc_id", "n_lines", "n_dropped", "kept_sha256" if digests_only else "text"],
                )

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    probes = rows.select("i", "t").mapInArrow(probe, "shard int, entries binary")
    drops = index.drop("hot").groupBy("shard").cogroup(probes.groupBy("shard")).applyInPandas(_answers, "doc_id long, key binary")
    by_doc = drops.groupBy("doc_id").agg(F.collect_list("key").alias("drop"))  # at most the document's own lines
    joined = rows.join(by_doc, rows["k"] == by_doc["doc_id"], "left").select("i", "t", "drop")
    return joined.mapInArrow(apply, f"doc_id long, n_lines long, n_dropped long, {'kept_sha256' if digests_only else 'text'} string")
