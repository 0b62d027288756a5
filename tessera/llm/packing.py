"""Best-fit packing of documents into sequences of at most `capacity` tokens, in bulk-synchronous supersteps.

Documents go by length class, longest first; the sequences begun so far have gaps. In a superstep

1. the documents of a class and the gaps are range-sorted together by size: a size with very many is several stretches, and each
   row learns its place among its equals from its rank in its stretch and the sizes of the stretches before;
2. a sweep from large to small matches every document with the successor of its length, the smallest free gap that
   holds it. The sweep is a stack (gaps are pushed, documents pop the gap pushed last), and a pop and its
   push are those neighbours that have the stack at the same height. Heights follow from the ranks and from how many documents and
   gaps each size has, so that all heights are swept at once, each a group of two rows for each size at most;
3. where more documents want a gap than it can hold, ranks decide, and the others wait;
4. the gaps shrink by what they took.

Supersteps repeat until no gap holds a document of the class. What is left then opens sequences: as many
documents in each as fill it, in order of length. Only the numbers of documents and of gaps for each size and stretch reach the driver (`capacity`
numbers each, and one more for each million rows); it learns from them where heights begin and when a class is done.

Only documents longer than the capacity are cut: whole pieces of `capacity` tokens, the first piece
being the shorter remainder, if any. Null text is empty: a document of the end id alone. Rows that share an id
are packed one by one. An empty table gives an empty result. Extra columns take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, materialize, slices, text_of
from .tokens import chunk_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece, with the crc32 of its ids and, if asked for, the ids themselves."""
    tail = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, 1):
                rows = []
                for i, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    ids += tail
                    for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * at : 4 * (at + n)]
                        rows.append((i, k, at, n, zlib.crc32(part), part))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    return docs.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(run, PIECES + ", ids binary" * with_ids)


PLACED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


#: where pieces have no more lengths than these, each has supersteps of its own
FEW_LENGTHS = 32


def length_classes(capacity: int, lengths: Collection[int]) -> list[tuple[int, int]]:
    """(low, high): lengths over low, up to high, longest first. Sequences hold 1, 2, 3, 4 to 7, 8 to 15, ..., 64 or more documents of a
    class. Few lengths are a class each, but for those of which only one fits: neighbours may then fill sequences that they could not share."""
    if len(lengths) <= FEW_LENGTHS:
        return [(capacity // 2, capacity), *((n - 1, n) for n in sorted(lengths, reverse=True) if n <= capacity // 2)]
    out, least = [], 1
    while least <= capacity:
        most = least if least < 4 else 2 * least - 1 if least < 64 else capacity
        out.append((capacity // (most + 1), capacity // least))
        least = most + 1
    return [(low, high) for low, high in out if low < high]


def slots(room: int, low: int, high: int) -> list[int]:
    """What a gap offers to documents over low, up to high long: itself, or places that hold any of them and the rest."""
    if room <= high:
        return [room] if room > low else []
    return [high] * (room // high) + [room % high] * (room % high > low)


def _slots(room: Column, low: int, high: int) -> Column:
    """The same as an expression."""
    rest = F.when(room % high > low, F.array((room % high).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    full = F.concat(F.array_repeat(F.lit(high), F.floor(room / high).cast("int")), rest)
    return F.when(room > high, full).otherwise(F.array(room.cast("int")))


def sweep_counts(documents: dict[int, int], offered: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """Of a sweep from large to small: the stack's height before each size, and how many documents of it find a gap."""
    height = held = 0
    before, matched = {}, {}
    for size in sorted({*documents, *offered}, reverse=True):
        before[size] = height
        held += offered.get(size, 0)
        matched[size] = min(held, documents.get(size, 0))
        held -= matched[size]
        height += offered.get(size, 0) - documents.get(size, 0)
    return before, matched


def _table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of whole numbers, sent to every task; rows are bounded by the capacity, and by the stretches for very many documents."""
    return F.broadcast(spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})))


def _ranked(rows: DataFrame, key: list[str], counts: dict[tuple[int, int], int], per_group: int) -> DataFrame:
    """Adds `rank`, 0.. among the rows of one (size, kind): the place in a stretch plus the stretches before.

    A size has one stretch for each `per_group` of its `counts`, chosen by a hash. Only the rows of each stretch are counted, and only
    where a size has several.
    """
    spark = rows.sparkSession
    stretches = {k: -(-n // per_group) for k, n in counts.items()}
    salted = rows.join(_table(spark, ["size", "kind", "stretches"], [(*k, n) for k, n in stretches.items()]), ["size", "kind"])
    salted = salted.withColumn("stretch", F.pmod(F.xxhash64(*key), F.col("stretches"))).drop("stretches")
    many = {(*k, 0): counts[k] for k in stretches}
    if any(n > 1 for n in stretches.values()):
        many = {(r[0], r[1], r[2]): r[3] for r in salted.groupBy("size", "kind", "stretch").count().collect()}
    starts, before = [], {}
    for size, kind, stretch in sorted(many):
        starts.append((size, kind, stretch, before.get((size, kind), 0)))
        before[size, kind] = starts[-1][3] + many[size, kind, stretch]
    own = F.row_number().over(Window.partitionBy("size", "kind", "stretch").orderBy(*key))
    ranked = salted.withColumn("_own", own).join(_table(spark, ["size", "kind", "stretch", "_first"], starts), ["size", "kind", "stretch"])
    return ranked.withColumn("rank", F.col("_own") - 1 + F.col("_first")).drop("stretch", "_own", "_first")


def _counts(rows: DataFrame, size: str) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy(size).count().collect()}  # sizes are at most `capacity`


def superstep(documents: DataFrame, gaps: DataFrame, counts: dict[int, int], rooms: dict[int, int], low: int, high: int, per_group: int) -> tuple[DataFrame, dict[int, int]] | None:
    """Each document with the sequence whose gap it takes, else null, and the numbers left; None where no gap holds any."""
    offered, wanted = {}, sum(counts.values())
    most = high  # the largest room that need be offered: smaller ones come first anyway
    for room in sorted(rooms):
        if room > high and sum(offered.values()) >= wanted:
            break
        most = max(most, room)
        for slot in slots(room, low, high):
            offered[slot] = offered.get(slot, 0) + rooms[room]
    before, matched = sweep_counts(counts, offered)
    if not sum(matched.values()):
        return None
    free = gaps.where((F.col("room") > low) & (F.col("room") <= most)).select("sequence_id", F.posexplode(_slots(F.col("room"), low, high)).alias("slot", "size"))
    pushed = free.select(F.col("size").cast("long").alias("size"), F.lit(0).cast("long").alias("kind"), F.col("sequence_id").alias("key"), F.col("slot").cast("long").alias("slot"))
    popped = documents.select(F.col("length").alias("size"), F.lit(1).cast("long").alias("kind"), F.col("row").alias("key"), F.lit(0).cast("long").alias("slot"), F.struct(*documents.columns).alias("d"))
    events = _ranked(pushed.unionByName(popped, allowMissingColumns=True), ["key", "slot"], {**{(s, 0): n for s, n in offered.items()}, **{(s, 1): n for s, n in counts.items()}}, per_group)
    events = events.join(_table(documents.sparkSession, ["size", "height", "slots"], [(s, h, offered.get(s, 0)) for s, h in before.items()]), "size")
    at = F.when(F.col("kind") == 0, F.col("height") + F.col("rank") + 1).otherwise(F.col("height") + F.col("slots") - F.col("rank"))
    at_height = Window.partitionBy("at").orderBy(F.desc("size"), "kind")
    events = events.select("size", "kind", "key", "d", at.alias("at")).withColumns({"_kind": F.lag("kind").over(at_height), "_sequence": F.lag("key").over(at_height)})
    taken = events.where("kind = 1").select("d.*", F.when(F.col("_kind") == 0, F.col("_sequence")).alias("sequence_id"))
    return taken, {s: n - matched[s] for s, n in counts.items() if n > matched[s]}


def opening(counts: dict[int, int], begun: int, capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(size, rank from, rank to, documents before, each, first sequence) of new sequences, and how many are begun then.

    Lengths that fill a sequence with equally many documents make whole sequences in order of length. What stays over of each
    such stretch, fewer documents than a sequence holds, fills sequences one after the other.
    """
    rows, rest = [], []
    sizes = sorted(counts, reverse=True)
    for each in sorted({capacity // s for s in sizes}):
        own = [s for s in sizes if capacity // s == each]
        whole = sum(counts[s] for s in own) // each * each
        place = 0
        for s in own:
            here = min(counts[s], whole - place)
            if here:
                rows.append((s, 0, here, place, each, begun))
            if here < counts[s]:
                rest.append((s, here, counts[s]))
            place += here
        begun += whole // each
    room = 0
    for s, at, end in rest:
        while at < end:
            if room < s:
                begun, room = begun + 1, capacity
            here = min(end - at, room // s)
            rows.append((s, at, at + here, 0, here, begun - 1))
            at, room = at + here, room - here * s
    return rows, begun


def open_sequences(documents: DataFrame, counts: dict[int, int], begun: int, capacity: int, per_group: int) -> tuple[DataFrame, int]:
    """Documents with the new sequences that they fill in order of length; and how many are begun then."""
    rows, begun = opening(counts, begun, capacity)
    places = _table(documents.sparkSession, ["size", "low", "high", "before", "each", "base"], rows)
    sized = documents.withColumns({"size": F.col("length"), "kind": F.lit(1).cast("long")})
    ranked = _ranked(sized, ["row"], {(s, 1): n for s, n in counts.items()}, per_group).join(places, "size")
    number = F.col("base") + F.floor((F.col("before") + F.col("rank") - F.col("low")) / F.col("each"))
    return ranked.where("rank >= low and rank < high").select(*documents.columns, (-1 - number).alias("sequence_id")), begun


def place(pieces: DataFrame, capacity: int, per_group: int = 1_000_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    columns = pieces.columns
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = _counts(pieces, "length")
    classes = length_classes(capacity, counts)
    # of the longest class each begins a sequence, which takes the number of its row; later ones count down from -1
    first = pieces.where(F.col("length") > classes[0][0]).withColumn("sequence_id", F.col("row"))
    gaps = first.where(F.col("length") < capacity).select("sequence_id", (F.lit(capacity) - F.col("length")).alias("room"))
    placed, begun = [first.withColumn("step", F.lit(0))], 0
    rooms = {capacity - n: k for n, k in counts.items() if classes[0][0] < n < capacity}
    for low, high in classes[1:]:
        left = {n: k for n, k in counts.items() if low < n <= high}
        documents = pieces.where((F.col("length") > low) & (F.col("length") <= high))
        while left:
            found = superstep(documents, gaps, left, rooms, low, high, per_group)
            if found is None:
                taken, begun = open_sequences(documents, left, begun, capacity, per_group)
                left = {}
            else:
                taken, left = found
            taken = materialize(taken, "superstep")
            here = taken.where("sequence_id is not null")
            placed.append(here.withColumn("step", F.lit(len(placed))))
            used, before = here.select("sequence_id", (-F.col("length")).alias("room")), gaps
            if found is None:
                gaps = gaps.unionByName(used.groupBy("sequence_id").agg((F.lit(capacity) + F.sum("room")).alias("room")))
            else:
                gaps = gaps.unionByName(used).groupBy("sequence_id").agg(F.sum("room").alias("room"))
            gaps = materialize(gaps.where("room > 0"), "gaps")
            dropped(before)
            rooms = _counts(gaps, "room")
            documents = taken.where("sequence_id is null").drop("sequence_id")
    together = placed[0]
    for more in placed[1:]:
        together = together.unionByName(more)
    so_far = Window.partitionBy("sequence_id").orderBy("step", "row").rowsBetween(Window.unboundedPreceding, -1)  # a sequence has at most `capacity` rows
    return together.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0))).select(*columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and where in its sequence."""
    return place(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), capacity).select(*PLACED)


def packed_sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, ids (array of int), pieces (doc_id, piece, offset, length).

    A sequence has at most `capacity` pieces, so that its group is bounded.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids=True).withColumn("_row", F.monotonically_increasing_id()), "sequences")
    with_ids = place(pieces.select("_row", "doc_id", "piece", "length"), capacity).join(pieces.select("_row", "ids"), "_row")
    return (
        with_ids.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("_p"))
        .select(
            "sequence_id",
            F.transform("_p", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("pieces"),
            F.expr("unhex(array_join(transform(_p, p -> hex(p.ids)), ''))").alias("ids_le_u32"),
        )
    )
