"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Every byte covered by a `length`-byte string that also starts earlier (smaller id, or earlier in the
document) goes. Not all suffixes need sorting to find those strings:

1. Anchors. In each window of `length` bytes the `GRAM`-byte string of least hash is the window's anchor. Equal
   windows have equal anchors at equal places, so windows are told apart at their anchors only, about
   one suffix in 35. An anchor whose string is seen nowhere else cannot lie in a repeated window: hashes are
   counted in shards, each slice sending a hash once however often it has it.
2. Runs. Tasks cut the suffixes at the remaining anchors (and what lies left of them), sort them, keep one of
   equal ones, and send each range of suffixes as a front-coded run: for each suffix the length of the prefix
   it shares with the one before, and the rest.
   A range is a stretch of the order; an anchor string with more suffixes than a range holds (a line that a third of
   all documents have) is parted by the anchor's place in the window and by the bytes that equal windows then share.
3. Merge. A range's runs meet in a loser tree that carries common-prefix lengths: of two suffixes the one that
   shares more with the last winner is smaller, and only suffixes that share equally much are compared,
   from there on. The merge puts out the order and the common prefixes of neighbours.
4. Windows. Two windows are equal if their anchors' suffixes share the bytes to the right and the bytes
   to the left match too. Common prefixes of neighbours in both orders make these classes; of each
   class all but the earliest window are repeated. Their spans go back to the documents.

Hashes only choose what is sorted, and order rows that share an id; whether strings are equal is decided by their bytes.

Defined results: null text is empty; a null id comes before all others; rows that share an id are ordered by a
hash of their text, and rows with the same id and text are one document (each gets its result); texts shorter
than `length` stay whole; an empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, mix64, slices, text_of, utf8

NULL_ID = -(2**63)
#: bytes of an anchor's string
GRAM = 32
#: characters of text behind one shard of hashes
SHARD_CHARS = 48_000_000
#: suffixes of one run, and suffixes behind one range
RUN_ITEMS, RANGE_ITEMS = 50_000, 60_000
#: most borders of ranges, which every task holds; beyond that many ranges, each is dealt further by its anchors' hashes
MOST_BORDERS = 4096
#: sampled suffixes for each border (they affect balance only)
BORDER_SAMPLE = 64
#: stretches of anchor offsets that part an anchor string with more suffixes than a range holds
STRETCHES = 4
_BLOCK = 1 << 17
_BYTE = np.random.default_rng(20210714).integers(0, 2**64, 256, np.uint64)
ENTRY = np.dtype([("gram", "<u8"), ("place", "<u8")])  # 48 bits of hash and the row; position, bytes before and after
ROW = np.dtype([("id", "<i8"), ("text", "<i8")])


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    h, m = _BYTE[raw], 1
    while m < GRAM:
        h = h[:-m] * np.uint64(0x9E3779B97F4A7C15 + 2 * m) + h[m:]
        m *= 2
    return mix64(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (width - m)], x[width - m :]) if width > m else x


def anchors(off: np.ndarray, raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows in the texts: row, position, first and last window start, hash. Positions within raw."""
    width = length - GRAM + 1
    parts = []
    for lo in range(0, len(raw) - length + 1, _BLOCK):
        block = raw[lo : lo + _BLOCK + length - 1]
        hashes = _gram_hashes(block)
        keys = (hashes & ~np.uint64(0x3FFFF)) | np.arange(len(hashes), dtype=np.uint64)
        at = (_sliding_min(keys, width) & np.uint64(0x3FFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        parts.append((at[new] + lo, new + lo, np.r_[new[1:], len(at)] - 1 + lo, hashes[at[new]]))
    if not parts:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    at, first, last, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    joined = np.r_[False, at[1:] == at[:-1]]  # an anchor whose windows two blocks share
    start = np.flatnonzero(~joined)
    at, hashes, last, first = at[start], hashes[start], np.r_[last[start[1:] - 1], last[-1]], first[start]
    # windows lie within one text: an anchor's windows are cut at the borders of its own
    row = np.searchsorted(off, at, "right") - 1
    first, last = np.maximum(first, off[row]), np.minimum(last, off[row + 1] - length)
    fits = (first <= last) & (at + GRAM <= off[row + 1])
    return row[fits], at[fits], first[fits], last[fits], hashes[fits]


def _key(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def _dealt(shard: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    return names, np.split(entries[order], first[1:])


def repeated_anchors(rows: DataFrame, length: int, shards: int) -> DataFrame:
    """(id, text hash, places): anchors whose string has the hash of another one somewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 8 << 20):
                off, raw = utf8(batch.column(2))
                row, at, first, last, hashes = anchors(off, raw, length)
                table = np.empty(batch.num_rows, ROW)
                table["id"], table["text"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                place = ((at - off[row]).astype(np.uint64) << np.uint64(16)) | ((at - first).astype(np.uint64) << np.uint64(8)) | (at - last).astype(np.uint64)
                _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
                several = count[back] > 1
                known = np.empty(int(several.sum()), [("row", ROW), ("place", "<u8")])
                known["row"], known["place"] = table[row[several]], place[several]
                once = np.ones(len(hashes), bool)
                once[several] = False
                lone = np.unique(np.where(several, hashes, np.uint64(0)))  # each repeated hash goes out once, without a row
                lone = lone[np.isin(lone, hashes[several])] if several.any() else lone[:0]
                entries = np.empty(int(once.sum()) + len(lone), ENTRY)
                entries["gram"] = np.r_[(hashes[once] & ~np.uint64(0xFFFF)) | row[once].astype(np.uint64), (lone & ~np.uint64(0xFFFF)) | np.uint64(0xFFFF)]
                entries["place"] = np.r_[place[once], np.zeros(len(lone), np.uint64)]
                shard = (mix64(entries["gram"] >> np.uint64(16)) % np.uint64(shards)).astype(np.int32)
                names, parts = _dealt(shard, entries)
                rows_of, blobs = [], []
                for part in parts:
                    own = (part["gram"] & np.uint64(0xFFFF)).astype(np.int64)
                    real = own != 0xFFFF
                    used, new = np.unique(own[real], return_inverse=True)
                    part["gram"][real] = (part["gram"][real] & ~np.uint64(0xFFFF)) | new.astype(np.uint64)
                    rows_of.append(table[used].tobytes())
                    blobs.append(part.tobytes())
                rider = zlib.crc32(table[:1].tobytes()) % max(1, len(blobs))  # places known already ride along with one shard, another one for each slice
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array(rows_of, pa.binary()), pa.array(blobs, pa.binary()), pa.array([known.tobytes() if i == rider else b"" for i in range(len(blobs))], pa.binary())],
                    ["shard", "table", "entries", "known"],
                )

    def meet(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(x, [("row", ROW), ("place", "<u8")]) for x in parts["known"]]
        grams, which = [], []
        for k, blob in enumerate(parts["entries"]):
            grams.append(np.frombuffer(blob, ENTRY))
            which.append(np.full(len(grams[-1]), k))
        entries, which = np.concatenate(grams), np.concatenate(which)
        gram = entries["gram"] >> np.uint64(16)
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        twin = np.zeros(len(gram), bool)
        twin[1:] |= gram[1:] == gram[:-1]
        twin[:-1] |= gram[1:] == gram[:-1]
        hit = order[twin]
        hit = hit[(entries["gram"][hit] & np.uint64(0xFFFF)) != 0xFFFF]
        ids, texts, places = [np.concatenate([f["row"]["id"] for f in found])], [np.concatenate([f["row"]["text"] for f in found])], [np.concatenate([f["place"] for f in found])]
        for k, table in enumerate(parts["table"]):
            own = hit[which[hit] == k]
            rows = np.frombuffer(table, ROW)[(entries["gram"][own] & np.uint64(0xFFFF)).astype(np.int64)]
            ids.append(rows["id"])
            texts.append(rows["text"])
            places.append(entries["place"][own])
        return pd.DataFrame({"id": np.concatenate(ids), "text": np.concatenate(texts), "place": np.concatenate(places).view(np.int64)})

    dealt = rows.mapInArrow(run, "shard int, `table` binary, entries binary, known binary")
    return dealt.groupBy("shard").applyInPandas(meet, "id long, text long, place long").groupBy("id", "text").agg(F.collect_set("place").alias("places"))


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, which share `at` bytes for certain."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 8
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


RUN = np.dtype([("shared", "u1"), ("rest", "u1"), ("left", "u1"), ("first", "u1"), ("last", "u1"), ("row", "<u4"), ("at", "<u4")])


def _pack(items: list[tuple], table: np.ndarray) -> bytes:
    """A front-coded run of sorted (suffix, left, bytes to the first window, to the last, row, position)."""
    fields = np.empty(len(items), RUN)
    before, rests, lefts, rows = b"", [], [], []
    shares, sizes = [], []
    for suffix, left, _, _, row, _ in items:
        n = common_prefix(before, suffix, 0) if before[:1] == suffix[:1] else 0
        shares.append(n)
        rests.append(suffix[n:])
        sizes.append(len(suffix) - n)
        lefts.append(left)
        rows.append(row)
        before = suffix
    used, new = np.unique(np.array(rows, np.int64), return_inverse=True)
    fields["shared"], fields["rest"], fields["left"] = shares, sizes, [len(x) for x in lefts]
    fields["first"], fields["last"], fields["row"], fields["at"] = [x[2] for x in items], [x[3] for x in items], new, [x[5] for x in items]
    return b"".join([np.array([len(items), len(used)], "<i8").tobytes(), fields.tobytes(), table[used].tobytes(), *rests, *lefts])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], bytes]:
    """Fields, rows, suffixes (front-coding undone) and the joined left parts."""
    n, used = np.frombuffer(blob, "<i8", 2)
    fields = np.frombuffer(blob, RUN, n, 16)
    at = 16 + n * RUN.itemsize
    rows = np.frombuffer(blob, ROW, used, at)
    at += used * ROW.itemsize
    suffixes, before = [], b""
    for shared, rest in zip(fields["shared"].tolist(), fields["rest"].tolist(), strict=True):
        before = before[:shared] + blob[at : at + rest]
        at += rest
        suffixes.append(before)
    return fields, rows, suffixes, blob[at:]


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser tree over sorted runs of (suffixes, common prefix with the one before).

    Returns (run, index) in order, and the common prefix of each with its predecessor. Known prefixes are never compared
    again: each contender carries what it shares with the last winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [0] * k
    sizes = [len(r[0]) for r in runs] + [0] * (k - len(runs))
    share = [0] * k  # of each run's head with the last winner
    current = [runs[i][0][0] if i < len(runs) and sizes[i] else None for i in range(k)]
    losers = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes that with the winner."""
        a, b = current[x], current[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        if share[x] != share[y]:
            return (x, y) if share[x] > share[y] else (y, x)
        n = common_prefix(a, b, share[x])
        if n == len(a) or (n < len(b) and a[n] < b[n]):
            share[y] = n
            return x, y
        share[x] = n
        return y, x

    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        upper = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            losers[node + i // 2] = lost
            upper.append(w)
        level = upper
    winner = level[0]
    order, shares = [], []
    while current[winner] is not None:
        order.append((winner, heads[winner]))
        shares.append(share[winner])
        heads[winner] += 1
        i = heads[winner]
        if i < sizes[winner]:
            current[winner] = runs[winner][0][i]
            share[winner] = runs[winner][1][i]
        else:
            current[winner] = None
        w, node = winner, (winner + k) // 2
        while node:
            a, other = current[w], losers[node]
            b = current[other]
            if b is not None:
                if a is None or share[other] > share[w]:
                    losers[node], w = w, other
                elif share[other] == share[w]:
                    w, losers[node] = play(w, other)
            node //= 2
        winner = w
    return order, shares


def _left_order(lefts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by the left parts read backwards, and common prefixes of neighbours in it."""
    text = np.zeros((len(lefts), -(-width // 8) * 8), np.uint8)
    size = np.array([len(x) for x in lefts])
    flat = np.frombuffer(b"".join([x[::-1] for x in lefts]), np.uint8)
    row = np.repeat(np.arange(len(lefts)), size)
    text[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    words = text.view(">u8")
    order = np.lexsort(tuple(words[:, j] for j in reversed(range(words.shape[1]))))
    differ = text[order[1:]] != text[order[:-1]]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])


def repeated_windows(suffix_share: np.ndarray, lefts: list[bytes], first: np.ndarray, last: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, bytes before the anchor) of all windows that equal one of lower rank. Items in suffix order."""
    n = len(lefts)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_left, left_share = _left_order(lefts, length - GRAM + 1)
    items, befores = [], []
    for before in range(int(last.min()), int(first.max()) + 1):
        own = np.flatnonzero((first >= before) & (last <= before))
        if len(own) < 2:
            continue
        right = np.cumsum(np.r_[0, suffix_share[1:] < length - before])
        left = np.empty(n, np.int64)
        left[by_left] = np.cumsum(np.r_[0, left_share < before])
        kind = right[own] * n + left[own]
        order = np.lexsort((rank[own], kind))
        new = np.r_[True, kind[order][1:] != kind[order][:-1]]
        earliest = rank[own][order][new][np.cumsum(new) - 1]
        again = rank[own][order] != earliest
        items.append(own[order[again]])
        befores.append(np.full(len(items[-1]), before))
    return (np.concatenate(items), np.concatenate(befores)) if items else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spans(rows: np.ndarray, starts: np.ndarray, length: int) -> pd.DataFrame:
    """Window starts of rows as merged spans."""
    order = np.lexsort((starts, rows["text"], rows["id"]))
    rows, starts = rows[order], starts[order]
    if not len(rows):
        return pd.DataFrame({"id": [], "text": [], "lo": [], "hi": []}).astype("int64")
    new = np.r_[True, (rows["id"][1:] != rows["id"][:-1]) | (rows["text"][1:] != rows["text"][:-1]) | (starts[1:] > starts[:-1] + length)]
    at = np.flatnonzero(new)
    return pd.DataFrame({"id": rows["id"][at], "text": rows["text"][at], "lo": starts[at], "hi": np.r_[starts[at[1:] - 1], starts[-1]] + length})


def _rank(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in the order of documents; equal for one place of a row that is there twice."""
    order = np.lexsort((at, rows["text"], rows["id"]))
    new = (rows["id"][order][1:] != rows["id"][order][:-1]) | (rows["text"][order][1:] != rows["text"][order][:-1]) | (at[order][1:] != at[order][:-1])
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.cumsum(np.r_[0, new])[: len(rows)]
    return rank


@dataclass(frozen=True)
class Dealing:
    """Which range an anchor's suffix goes to. Equal windows always meet; the choice affects balance only."""

    borders: list[bytes]  # sorted, GRAM bytes each, so that equal anchors meet
    parts: int  # each range is dealt to so many by the hash of the anchor
    hot: frozenset[bytes]  # anchors with more suffixes than a range holds
    hot_ranges: int

    def targets(self, suffix: bytes, left: bytes, first: int, last: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(range, first, last): windows with an anchor offset from last to first go there.

        A hot anchor's windows are parted by their offset. Those of one stretch of offsets share, if equal, more bytes around
        the anchor, and are dealt by these.
        """
        anchor = suffix[:GRAM]
        if anchor not in self.hot:
            yield bisect_right(self.borders, anchor) * self.parts + (zlib.crc32(anchor) % self.parts if self.parts > 1 else 0), first, last
            return
        base, width = (len(self.borders) + 1) * self.parts, -(-(length - GRAM + 1) // STRETCHES)
        for low in range(0, length - GRAM + 1, width):
            high = min(low + width - 1, length - GRAM)
            f, e = min(first, high), max(last, low)
            if e <= f:
                yield base + zlib.crc32(left[len(left) - low :] + suffix[: length - high], low) % self.hot_ranges, f, e


def suffix_runs(cut: DataFrame, dealing: Dealing, length: int) -> DataFrame:
    """(range, run, known): front-coded runs by range; known has the spans of items equal to an earlier one of their own run."""

    def flush(items: list[tuple], table: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = np.array(table, ROW)
        items.sort(key=lambda x: (x[0], x[1], x[2], x[3], table[x[4]], x[5]))
        spans, before = [], None
        by_range: dict[int, list] = {}
        for x in items:
            if before is not None and x[:4] == before[:4]:
                if x[5] == before[5] and table[x[4]] == table[before[4]]:
                    continue  # a row that is there twice
                spans.append((table[x[4]][0], table[x[4]][1], x[5] - x[2], x[5] - x[3] + length))
                continue
            before = x
            suffix, left, first, last, row, at = x
            for name, f, e in dealing.targets(suffix, left, first, last, length):
                by_range.setdefault(name, []).append(x if (f, e) == (first, last) else (suffix[: length - e], left[first - f :], f, e, row, at))
        items.clear()
        names = list(by_range)
        rider = zlib.crc32(rows[:1].tobytes()) % max(1, len(names))  # the spans ride along with one range, another one for each run
        known = [np.array(spans, "<i8").tobytes() if i == rider else b"" for i in range(len(names))]
        for start in range(0, len(names), 64):
            some = names[start : start + 64]
            packed = [_pack(sorted(by_range.pop(r)), rows) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary()), pa.array(known[start : start + 64], pa.binary())], ["range", "run", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, table = [], []
        for whole in batches:
            for batch in slices(whole, 2):
                off, raw = utf8(batch.column(2))
                data = raw.tobytes()
                places = batch.column(3)
                flat = places.flatten().to_numpy().view(np.uint64)
                count = np.diff(places.offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), count)
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                known = -1
                for lo in range(0, len(flat), RUN_ITEMS):  # a long text fills several runs
                    part = flat[lo : lo + RUN_ITEMS]
                    at, first, last = (part >> np.uint64(16)).astype(np.int64), ((part >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (part & np.uint64(255)).astype(np.int64)
                    for r, a, f, e in zip(row[lo : lo + RUN_ITEMS].tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True):
                        if r != known or not table:
                            table.append((ids[r], texts[r]))
                            known = r
                        p = int(off[r]) + a
                        items.append((data[p : p - e + length], data[p - f : p], f, e, len(table) - 1, a))
                    if len(items) >= RUN_ITEMS:
                        yield from flush(items, table)
                        items, table = [], []
        if items:
            yield from flush(items, table)

    return cut.mapInArrow(run, "range int, run binary, known binary")


def _merge(length: int):
    def meet(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        unpacked = [_unpack(blob) for blob in parts["run"]]
        order, shares = merge_runs([(u[2], u[0]["shared"].tolist()) for u in unpacked])
        share = np.array(shares, np.int64)
        joint = np.concatenate([u[0] for u in unpacked])
        start = np.cumsum([0, *(len(u[0]) for u in unpacked)])
        index = np.array([start[r] + i for r, i in order], np.int64)
        rows = np.concatenate([u[1][u[0]["row"]] for u in unpacked])[index]
        lefts: list[bytes] = []
        for fields, _, _, flat in unpacked:
            ends = np.cumsum(fields["left"].astype(np.int64)).tolist()
            lefts += [flat[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        joint = joint[index]
        lefts = [lefts[i] for i in index]
        first, last, at = joint["first"].astype(np.int64), joint["last"].astype(np.int64), joint["at"].astype(np.int64)
        # only suffixes that share an anchor with a neighbour can have an equal window
        meets = np.r_[False, share[1:] >= GRAM]
        live = np.flatnonzero(meets | np.r_[meets[1:], False])
        share = np.where(meets, share, 0)[live]
        rows, first, last, at, lefts = rows[live], first[live], last[live], at[live], [lefts[i] for i in live]
        rank = _rank(rows, at)
        item, before = repeated_windows(share, lefts, first, last, rank, length)
        found = _spans(rows[item], at[item] - before, length)
        known = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 4) for x in parts["known"]])
        return pd.concat([found, pd.DataFrame(known, columns=["id", "text", "lo", "hi"])], ignore_index=True)

    return meet


def deal(rows: DataFrame, places: DataFrame, items: int) -> Dealing:
    """Ranges of about RANGE_ITEMS of the `items` suffixes, by a bounded sample of them."""
    ranges = max(1, -(-items // RANGE_ITEMS))
    if ranges < 2:
        return Dealing([], 1, frozenset(), 1)
    parts = -(-ranges // MOST_BORDERS)
    size = BORDER_SAMPLE * -(-ranges // parts)
    every = max(1, items // (16 * size))  # documents; of their suffixes those that a hash chooses
    chosen = F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0
    some = max(1, items // every // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                off, raw = utf8(batch.column(0))
                data, flat = raw.tobytes(), batch.column(1).flatten().to_numpy().view(np.uint64)
                start = np.repeat(off[:-1], np.diff(batch.column(1).offsets.to_numpy()))
                at = (start + (flat >> np.uint64(16)).astype(np.int64))[mix64(flat + start.view(np.uint64)) % np.uint64(some) == 0]
                yield pa.RecordBatch.from_arrays([pa.array([data[a : a + GRAM] for a in at.tolist()], pa.binary())], ["p"])

    sampled = rows.where(chosen).join(places.where(chosen), ["id", "text"]).select("t", "places")
    sample = sorted(bytes(r["p"]) for r in sampled.mapInArrow(run, "p binary").limit(8 * size).collect())  # about `size`; the limit is there for a document of very many
    if not sample:
        return Dealing([], ranges, frozenset(), 1)
    cuts = -(-ranges // parts)
    counted = Counter(sample)
    hot = frozenset(p for p, n in counted.items() if n * ranges > 2 * len(sample) and n > 8)
    hot_ranges = max(1, -(-3 * ranges * sum(counted[p] for p in hot) // len(sample)))
    cold = [p for p in sample if p not in hot]
    return Dealing(sorted({cold[len(cold) * k // cuts] for k in range(1, cuts)}) if cold else [], parts, hot, hot_ranges)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (id, text hash, t), and spans (id, text hash, spans as array of (lo, hi)), bytes to remove."""
    if not 2 * GRAM <= length <= 255:
        raise ValueError(f"length must be from {2 * GRAM} to 255")
    chars = docs.agg(F.sum(F.length(F.col(text_col)))).first()[0] or 0
    rows = docs.select(_key(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text"), text_of(text_col).alias("t"))
    long_enough = rows.where(F.octet_length("t") >= length)
    places = materialize(repeated_anchors(long_enough, length, max(1, -(-chars // SHARD_CHARS))), "anchors")
    dealing = deal(rows, places, places.agg(F.sum(F.size("places"))).first()[0] or 0)
    cut = rows.join(places, ["id", "text"]).select("id", "text", "t", "places")
    found = suffix_runs(cut, dealing, length).groupBy("range").applyInPandas(_merge(length), "id long, text long, lo long, hi long")
    return rows, found.groupBy("id", "text").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def union_spans(spans: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, digests_only: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, and the kept bytes (or their SHA-256 alone)."""
    rows, spans = repeated_spans(docs, id_col, text_col, length)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                off, raw = utf8(batch.column(1))
                data, out = raw.tobytes(), []
                for i, (s, e, found) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), batch.column(2).to_pylist(), strict=True)):
                    text, at, parts = data[s:e], 0, []
                    gone = union_spans(found)
                    for lo, hi in gone:
                        parts.append(text[at:lo])
                        at = hi
                    kept = b"".join([*parts, text[at:]])
                    out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest() if digests_only else kept))
                cols = list(zip(*out, strict=True))
                ids = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NULL_ID), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string() if digests_only else pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests_only else "kept"],
                )

    joined = rows.join(spans, ["id", "text"], "left").select("id", "t", "spans")
    last = "kept_sha256 string" if digests_only else "kept binary"
    return joined.mapInArrow(apply, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def documents_without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, chars_col: str = "n_chars") -> DataFrame:
    """The rows and columns of docs with the kept text; chars_col, if there, is counted anew.

    A span's ends move outwards to whole characters, so that what stays is valid UTF-8. A null text stays null.
    """
    rows, spans = repeated_spans(docs, id_col, text_col, length)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, names.index(text_col)):
                texts = []
                for text, found in zip(batch.column(names.index(text_col)).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                    if text is None or not found:
                        texts.append(text)
                        continue
                    data, at, parts = text.encode(), 0, []
                    for lo, hi in union_spans(found):
                        while lo > at and data[lo] & 0xC0 == 0x80:
                            lo -= 1
                        while hi < len(data) and data[hi] & 0xC0 == 0x80:
                            hi += 1
                        parts.append(data[at:lo])
                        at = max(at, hi)
                    texts.append(b"".join([*parts, data[at:]]).decode())
                columns = [pa.array(texts, batch.column(i).type) if n == text_col else batch.column(i) for i, n in enumerate(names)]
                if chars_col in names:
                    i = names.index(chars_col)
                    columns[i] = pa.array([old if t is None else len(t) for t, old in zip(texts, columns[i].to_pylist(), strict=True)], columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    own_id, own_text, own_spans = fresh(names, "id", "text", "spans")
    keyed = docs.withColumns({own_id: _key(id_col), own_text: F.xxhash64(text_of(text_col))})
    spans = spans.select(F.col("id").alias(own_id), F.col("text").alias(own_text), F.col("spans").alias(own_spans))
    return keyed.join(spans, [own_id, own_text], "left").select(*[F.col(f"`{c}`") for c in names], own_spans).mapInArrow(cut, docs.schema)
