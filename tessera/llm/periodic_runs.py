"""Periodic runs of words, by the linear-time method of Ellert and Fischer.

A run is a stretch of words with smallest period q that no neighbouring word extends. Each run is an extension of a Lyndon
word, that is of a step from a suffix to the next smaller one, in one of two opposite orders of the words. So for both orders a
text is swept once from left to right. The sweep holds the suffixes that still wait for a smaller one; a new suffix is
compared with the last of them, and what the comparison matched is kept with the pair. Later pairs take over from there:

* two waiting suffixes next to each other have been compared, so that the new one is compared with the second only from where it
  left the first, and only if both left it at one place;
* a pair inside the stretch that reaches farthest to the right is a copy of a pair before, whose extension is known.

Words are compared only beyond the farthest place reached so far, so that comparisons stay in proportion to the text. There is no
suffix array or tree and no hash: words get their ranks by sorting. Steps whose matched extension is long enough are extended to the left
by less than one period; a step that can go farther is not the first of its run.

A word that is there fewer than `least_periods` times lies in no run, so that texts are first cut at such words, and the parts likewise.

Defined results: words are what lies between the white space [\\x20\\x09-\\x0D]; null, empty and blank texts have no words and no runs, and
collapse to the empty text. Rows are judged one by one, so that repeated rows and ids give repeated rows; a null id stays null. Of runs
with the same exponent the first, then the one of the smaller period is the greatest. Texts of any length are read whole, in
memory of some 200 bytes a word; an empty table gives an empty table; other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of
from .quality import _WS, _let

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_steps(s: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix of s the place of the next smaller suffix (len(s): none), and how many words both begin with alike.

    A suffix is smaller than one that it begins. The Lyndon array is the distance to that place."""
    n = len(s)
    after, alike = [n] * n, [0] * n  # next smaller suffix
    before, common = [-1] * n, [0] * n  # previous smaller suffix: the sweep's waiting suffixes are i - 1, before[i - 1], ...
    start = end = shift = 0  # s[start:end] equals s[start - shift:end - shift]; no pair reached beyond end
    for i in range(1, n):
        p, k, held = i - 1, 0, 0  # s[p:] and s[i:] begin with k words alike at least; held: s[p:] and the suffix passed last
        while p >= 0:
            if held < k:  # s[p:] leaves the suffix passed last before s[i:] does, and is smaller than both
                before[i], common[i] = p, held
                break
            if held == k:
                if i < end:
                    a, b = (p - shift if p >= start else p), i - shift
                    known = alike[a] if after[a] == b else common[b] if before[b] == a else -1
                    if known > k:
                        k = known if i + known < end else max(k, end - i)
                while i + k < n and s[p + k] == s[i + k]:
                    k += 1
                if i + k > end:
                    start, end, shift = i, i + k, i - p
                if i + k < n and s[p + k] < s[i + k]:
                    before[i], common[i] = p, k
                    break
            after[p], alike[p], held = i, k, common[p]
            p = before[p]
    return after, alike


def runs_of(s: list[int], least_words: int = 6, least_periods: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of s with at least `least_words` words and `least_periods` periods (3 or more)."""
    n, found = len(s), set()
    for sign in (1, -1):
        after, alike = lyndon_steps(s if sign > 0 else [-x for x in s])
        reached: dict[int, int] = {}  # period -> end of its last run
        for p in range(n):
            j = after[p]
            q = j - p
            # the first step of a run starts within its first period
            if j == n or 2 * q + alike[p] <= max(least_words, least_periods * q) - 1 or reached.get(q, 0) - p >= q:
                continue
            left = 0
            while left < q and p > left and s[p - 1 - left] == s[j - 1 - left]:
                left += 1
            length = left + q + alike[p]
            if left < q and length >= max(least_words, least_periods * q):
                found.add((p - left, length, q))
                reached[q] = j + alike[p]
    return sorted(found)


def _parts(s: list[int], at: int, least: int, least_words: int) -> Iterator[tuple[int, list[int]]]:
    """The stretches of s, with their places, between words that are there fewer than `least` times, cut until none is left."""
    todo = [(at, s)]
    while todo:
        at, s = todo.pop()
        if len(s) < least_words:
            continue
        ranks = np.array(s)
        _, back, count = np.unique(ranks, return_inverse=True, return_counts=True)
        often = count[back] >= least
        if often.all():
            yield at, s
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
        todo += [(at + a, s[a:b]) for a, b in edges.reshape(-1, 2).tolist()]


def _ranks(words: list[bytes], least: int) -> tuple[list[int], bool]:
    """The words as ranks in their order, and whether any word is there `least` times."""
    order = sorted(range(len(words)), key=words.__getitem__)
    ranks, rank, last, run, often = [0] * len(words), 0, None, 0, False
    for i in order:
        w = words[i]
        if w == last:
            run += 1
            often = often or run >= least
        else:
            rank, last, run = rank + 1, w, 1
        ranks[i] = rank
    return ranks, often


def text_runs(words: list[bytes], least_words: int = 6, least_periods: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    if len(words) < least_words:
        return []
    ranks, often = _ranks(words, least_periods)
    if not often:
        return []
    return sorted((at + a, n, q) for at, part in _parts(ranks, 0, least_periods, least_words) for a, n, q in runs_of(part, least_words, least_periods))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside all runs and in the first period of each, unless another run drops them, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; runs come by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, least_periods: int = 4, digests_only: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_runs, the greatest run (start, length, period, exponent_milli), and all runs and the
    collapsed text, or their SHA-256 alone (runs as lines `start,length,period`)."""
    if least_periods < 3:
        raise ValueError("runs of fewer than three periods are not searched for")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                rows = []
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    words = text.split()  # bytes are split at the six characters of white space, and at no other
                    found = text_runs(words, least_words, least_periods)
                    top = greatest(found)
                    kept = collapsed(words, found)
                    if digests_only:
                        said = "".join(f"{a},{n},{q}\n" for a, n, q in found)
                        out = hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
                    else:
                        out = [{"start": a, "length": n, "period": q} for a, n, q in found], kept.decode()
                    rows.append((len(words), len(found), *(top or (None, None, None)), top and 1000 * top[1] // top[2], *out))
                cols = list(zip(*rows, strict=True))
                last = (pa.string(), pa.string()) if digests_only else (_RUNS, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 6, *last), strict=True)]], names)

    last = ["runs_sha256", "collapsed_sha256"] if digests_only else ["runs", "collapsed"]
    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", *last]
    kind = "string" if digests_only else "array<struct<start: long, length: long, period: long>>"
    schema = ", ".join(f"{n} long" for n in names[:7]) + f", {last[0]} {kind}, {last[1]} string"
    return docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t")).mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (id and text) with repetitions put into a tenth of the texts, from a place and with a period that the id's checksum gives.

    A text without words and a row without id stay as they are."""
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tiled(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " "))

    text = text_of(text_col)
    planted = F.when(h % 10 == 0, _let(F.filter(F.split(text, _WS, -1), lambda w: w != ""), tiled))
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(planted, text).alias(text_col))
