"""Token ids in files of shuffled bit planes.

A file holds the documents of one stretch of ascending ids. Its ids are cut into blocks of a fixed
number; each block is transposed into planes (plane k holds bit k, or byte k, of every id), planes
without a set bit are left out, and the others are compressed with zstandard one by one. A chunk
index of (position, sizes of the planes) for each block and a document index of (doc_id, tokens)
come first, so that a reader can fetch one block alone.

    magic "BPF1" | u32 width, block, documents, blocks, planes, ids (u64) | zstd(document index)
    | chunk index: u64 position and u32 sizes of the planes, for each block | planes

The files are rows (shard, file, n_documents, n_tokens, content) of a Parquet table, which any
store that Spark writes to can hold and whose commit survives lost executors. A file closes at the
first document's end past `file_tokens`, so that its size is bounded by that and one document.

Null text is empty: a document of the end id alone. Null ids come first. Rows that share an id follow each other in
the order of their texts. An empty table gives no file. Extra columns take no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, text_of
from .tokens import chunk_encoder

_HEAD = struct.Struct("<4sIIIIIQI")
#: stands for a null id in a document index
NULL_ID = -(2**63)


def planes_of(ids: np.ndarray, width: int) -> list[bytes]:
    """width 1: bit planes, packed; width 8: byte planes."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if width == 8:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int, width: int) -> np.ndarray:
    if width == 8:
        raw = np.stack([np.frombuffer(p, np.uint8)[:n] if p else np.zeros(n, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") if p else np.zeros(n, np.uint8) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def write_file(doc_ids: list[int], lengths: list[int], ids: np.ndarray, width: int = 1, block: int = 65_536, level: int = 3) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=level)
    index, body, at = [], [], 0
    count = 32 // width
    for start in range(0, len(ids), block):
        packed = [squeeze.compress(p) if any(p) else b"" for p in planes_of(ids[start : start + block], width)]
        index.append(struct.pack(f"<Q{count}I", at, *map(len, packed)))
        body += packed
        at += sum(map(len, packed))
    docs = squeeze.compress(np.array([doc_ids, lengths], np.int64).tobytes())
    head = _HEAD.pack(b"BPF1", width, block, len(doc_ids), len(index), count, len(ids), len(docs))
    return b"".join([head, docs, *index, *body])


def read_index(content: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
    """Header, document index (2 x documents: ids and tokens), and the place of the chunk index."""
    magic, width, block, n_docs, blocks, count, n, size = _HEAD.unpack_from(content)
    if magic != b"BPF1":
        raise ValueError("not a bit-plane token file")
    docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(content[_HEAD.size : _HEAD.size + size]), np.int64).reshape(2, n_docs)
    entry = struct.Struct(f"<Q{count}I")
    at = _HEAD.size + size
    chunks = [entry.unpack_from(content, at + k * entry.size) for k in range(blocks)]
    return {"width": width, "block": block, "n": n, "body": at + blocks * entry.size}, docs, chunks


def read_block(content: bytes, head: dict, chunks: list, k: int) -> np.ndarray:
    expand = zstandard.ZstdDecompressor()
    at, *sizes = chunks[k]
    at += head["body"]
    planes = []
    for size in sizes:
        planes.append(expand.decompress(content[at : at + size]) if size else b"")
        at += size
    return ids_of(planes, min(head["block"], head["n"] - k * head["block"]), head["width"])


FILES = "shard int, file int, n_documents long, n_tokens long, content binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 1 << 20, width: int = 8) -> DataFrame:
    """Writes the files into the shared folder, in ascending order of ids over (shard, file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, file = chunk_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], np.uint32).tobytes()
        ids, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            content = write_file(ids, lengths, np.frombuffer(b"".join(parts), np.uint32), width)
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "file": file, "n_documents": len(ids), "n_tokens": held, "content": content}],
                pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("n_documents", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.binary())]),
            )

        for whole in batches:
            for batch in slices(whole, 1):
                for i, x in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    ids.append(NULL_ID if i is None else i)
                    parts.append(x + tail)
                    lengths.append(len(x) // 4 + 1)
                    held += lengths[-1]
                    if held >= file_tokens:
                        yield close()
                        ids, lengths, parts, held, file = [], [], [], 0, file + 1
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    in_order = rows.repartitionByRange("i").sortWithinPartitions("i", "t")
    return materialize(in_order.mapInArrow(run, FILES), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32 (and shard, file)."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("_all"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = totals.select("shard", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_shard"))
    within = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    names = files.select("shard", "file", "n_tokens").withColumn("_file", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    bases = names.join(shards, "shard").select("shard", "file", (F.col("_shard") + F.col("_file")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                head, docs, chunks = read_index(row["content"])
                held, base, k = np.zeros(0, np.uint32), 0, 0
                ends = np.cumsum(docs[1])
                crcs = []
                for n, end in zip(docs[1], ends, strict=True):
                    while base + len(held) < end:
                        held = np.concatenate([held, read_block(row["content"], head, chunks, k)])
                        k += 1
                    crcs.append(zlib.crc32(held[end - n - base : end - base].tobytes()))
                    if end - base > head["block"]:
                        held, base = held[end - base :], int(end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[0], mask=docs[0] == NULL_ID),
                        pa.array(np.full(len(ends), row["shard"], np.int32)),
                        pa.array(np.full(len(ends), row["file"], np.int32)),
                        pa.array(ends - docs[1]),
                        pa.array(docs[1]),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "shard", "file", "start_in_file", "n_tokens", "ids_crc32"],
                )

    found = files.select("shard", "file", "content").mapInArrow(run, "doc_id long, shard int, file int, start_in_file long, n_tokens long, ids_crc32 long")
    return found.join(bases, ["shard", "file"]).select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32", "shard", "file")
