"""Language identification by a convolutional network over bytes, trained here with numpy.

A text's UTF-8 bytes are cut into windows of `WINDOW` bytes, each of which begins before the last one ends, so that no string of up
to `max(WIDTHS)` bytes falls between two; the last window is filled up with zeros. Bytes are looked up in a small table,
filters of several widths run over all places of a window, the greatest answer of each filter goes on (max pooling), and a softmax over
the languages follows. The network is applied to batches of windows in the executors; a text's answer is the mean of its windows' answers,
weighted by their bytes. Whole texts are read.

The network learns from documents that are not held out and have a language, text and nothing else: at most `max_labelled` of them (a
documented bound, by default 8,000, in equal parts for the languages, chosen by a hash of id and text, so that the same table gives the
same sample; of the 200 most frequent languages, should a table have more) and `WINDOWS_EACH` windows of each, spread over its length. Only these windows reach the driver, where the network is
fitted by Adam from a fixed start. Adding documents changes which are chosen, not how many.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text where no document teaches a language. A
null id counts as empty text in the checksum, and is held out; rows are judged one by one; of rows that repeat, one teaches. A text with
letters gets one of the learned languages, also where it is in none of them. An empty table gives an empty table; other columns take no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of, utf8

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 20  # of each width
SIZE = 8  # numbers for each byte
WINDOWS_EACH = 3
#: what no language was found for
UNKNOWN = "und"
_WIDE = max(WIDTHS)
_STEP = WINDOW - _WIDE + 1
_BATCH = 128


@dataclass
class ByteNet:
    """Parameters: a row for each byte, a column for each filter (zeros beyond its width), filter biases, output layer."""

    languages: list[str]
    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, languages: list[str], seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        normal = lambda shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        filters = normal((_WIDE * SIZE, n), 1) * mask() / np.sqrt(np.float32(_WIDE * SIZE))
        return cls(languages, normal((256, SIZE), 0.5), filters, np.zeros(n, np.float32), normal((n, len(languages)), 0.1), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.bias, self.out, self.out_bias]

    def places(self, windows: np.ndarray) -> np.ndarray:
        """The table's rows of `_WIDE` bytes in a row, for each place of each window: (windows, places, _WIDE * SIZE)."""
        rows = np.take(self.table, windows, axis=0)
        n, length, _ = rows.shape
        view = np.lib.stride_tricks.as_strided(rows, (n, length - _WIDE + 1, _WIDE * SIZE), (rows.strides[0], rows.strides[1], rows.strides[2]))
        return np.ascontiguousarray(view)

    def answers(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each window."""
        # a product for each window is small enough for numpy to stay in the task's own thread
        return softmax(np.maximum(greatest(self.places(windows) @ self.filters) + self.bias, 0) @ self.out + self.out_bias)

    def gradients(self, windows: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy. Through the pooling, only the place with the greatest answer of each filter learns."""
        at = self.places(windows)
        n, raw = len(at), at @ self.filters
        where = raw.argmax(axis=1)
        pooled = np.take_along_axis(raw, where[:, None, :], axis=1)[:, 0] + self.bias
        active = np.maximum(pooled, 0)
        error = softmax(active @ self.out + self.out_bias)
        error[np.arange(n), wanted] -= 1
        error /= n
        back = (error @ self.out.T) * (pooled > 0)
        seen = at[np.arange(n)[:, None], where]  # windows, filters, wide
        filters = np.einsum("nf,nfw->wf", back, seen, optimize=True) * mask()
        down = (back[:, :, None] * self.filters.T[None]).reshape(n, -1, _WIDE, SIZE)
        bytes_at = windows[np.arange(n)[:, None, None], where[:, :, None] + np.arange(_WIDE)]
        one = np.zeros((256, SIZE), np.float32)
        for k in range(SIZE):
            one[:, k] = np.bincount(bytes_at.ravel(), down[..., k].ravel(), minlength=256)
        return [one, filters, back.sum(axis=0), active.T @ error, error.sum(axis=0)]


def greatest(x: np.ndarray) -> np.ndarray:
    """The maximum over axis 1, by halves."""
    while x.shape[1] > 16:
        half, odd = divmod(x.shape[1], 2)
        upper = np.maximum(x[:, :half], x[:, half : 2 * half])
        if odd:
            np.maximum(upper[:, 0], x[:, -1], out=upper[:, 0])
        x = upper
    return x.max(axis=1)


def mask() -> np.ndarray:
    """Ones where a filter of its width has a weight."""
    widths = np.repeat(WIDTHS, FILTERS)
    return (np.arange(_WIDE * SIZE)[:, None] < SIZE * widths[None, :]).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, wanted: np.ndarray, languages: list[str], epochs: int = 6, rate: float = 4e-3, seed: int = 7) -> ByteNet:
    """Fits the network by Adam; the rate falls to zero over all steps."""
    net, rng = ByteNet.start(languages, seed), np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    steps, t = epochs * -(-len(windows) // _BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), _BATCH):
            part = order[a : a + _BATCH]
            t += 1
            now = rate * (1 - (t - 1) / steps)
            for p, g, m, v in zip(net.parameters(), net.gradients(windows[part], wanted[part]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: Column) -> Column:
    """A fifth of the documents, told by a checksum of the id as text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def labelled_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_labelled: int, max_languages: int = 200) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, the number of each one's language, and the languages: of at most `max_labelled` documents that are not held out, in
    the `max_languages` most frequent languages."""
    taught = docs.where(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    taught = taught.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("g"))
    most = taught.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "g").limit(max_languages)
    counts = {r["g"]: r["n"] for r in most.collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    each = max(1, max_labelled // len(counts))
    # a share of the hashes for each language that holds what is wanted of it and some more
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, 1.2 * each / n + 20 / n))])
    chosen = taught.where(((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < share[F.col("g")]) & has_letter(F.col("t")))
    data, size = F.col("t").cast("binary"), F.octet_length("t")
    parts = F.transform(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_EACH - 1)), lambda k: F.floor(F.greatest(size - WINDOW, F.lit(0)) * k / max(WINDOWS_EACH - 1, 1)).cast("int"))),
        lambda a: F.substring(data, a + 1, F.lit(WINDOW)),
    )
    sample = chosen.select("h", "g", parts.alias("w")).groupBy("h", "g").agg(F.min("w").alias("w"))
    taken: dict[str, list] = {g: [] for g in counts}
    for row in sample.limit(3 * max_labelled + 100 * len(counts)).collect():
        taken[row["g"]].append((row["h"], row["w"]))
    languages = sorted(g for g, rows in taken.items() if rows)
    windows, wanted = [], []
    for k, g in enumerate(languages):
        for _, parts in sorted(taken[g], key=lambda x: x[0])[:each]:
            for part in parts:
                windows.append(bytes(part).ljust(WINDOW, b"\0"))
                wanted.append(k)
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array(wanted, np.int64), languages


def text_answers(net: ByteNet, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Mean answer of each text raw[off[i]:off[i + 1]]."""
    size = np.diff(off)
    count = np.maximum(1, -(-(size - _WIDE + 1) // _STEP))
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = off[owner] + nth * _STEP
    left = np.minimum(off[owner + 1] - begin, WINDOW)
    total = np.zeros((len(size), len(net.languages)))
    padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
    inside = np.arange(WINDOW)
    for a in range(0, len(owner), _BATCH):
        b = a + _BATCH
        windows = padded[np.minimum(begin[a:b, None] + inside, len(padded) - 1)]
        windows[inside >= left[a:b, None]] = 0
        np.add.at(total, owner[a:b], net.answers(windows) * np.maximum(left[a:b], 1)[:, None])
    return total / np.bincount(owner, np.maximum(left, 1), minlength=len(size))[:, None]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_labelled: int = 8000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the mean probability of that language)."""
    windows, wanted, languages = labelled_windows(docs, id_col, text_col, lang_col, max_labelled)
    net = train(windows, wanted, languages) if languages else None
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 5,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in slices(whole, 1):
                letters = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), bool)
                names, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
                asked = np.flatnonzero(letters)
                if known is not None and len(asked):
                    answers = text_answers(known, *utf8(batch.column(1).take(pa.array(asked))))
                    best = answers.argmax(axis=1)
                    names[asked] = np.array(known.languages, object)[best]
                    scores[asked] = np.clip(answers[np.arange(len(asked)), best], 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"), held_out(F.col(id_col)).alias("o"), has_letter(text_of(text_col)).alias("l"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
