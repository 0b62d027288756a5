"""Spelling variants: words one edit apart, found by generating the full neighbourhood of every word.

Words are counted over all texts with DataFrame functions. From each word of the vocabulary all distinct deletions, replacements
and insertions over the observed alphabet are made, and candidates meet the vocabulary in a hash join: what is found there is near, and no
distance is computed. Each candidate is made once: one letter out of a row of equal ones is deleted, and a letter is inserted only where
it does not follow itself.

A neighbourhood has some hundred candidates for each word, of which hardly any is a word. So that they need not be shuffled, candidates
are made as hashes (XOR of a number for each place and letter: a candidate's hash takes one step from the word's) and asked first in
a Bloom filter of the vocabulary, which is built by the executors and broadcast: 32 to 64 bits for each word up to `MAX_BITS`
(32 MB), whatever the vocabulary; a larger one only lets more candidates through to the join. The join is by hash, and what meets there is
confirmed by making the candidate's text and comparing it with the word, so that neither the filter nor the hash decides.

A word's form is the most frequent near word that is at least `ratio` times as frequent. Counts grow along a chain of forms by that
factor at each step, so that chains are short; their ends are found by pointer doubling.

Defined results: null and empty texts have no words; a null id counts as empty text in the checksum that damages words; rows
are counted one by one, so that repeated rows count again; words of any length are treated alike, in blocks of their places; an
empty table or vocabulary gives an empty table; other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, text_of

#: maximal runs of these are words
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: bits of the Bloom filter at most
MAX_BITS = 1 << 28
#: candidates made at once
_BLOCK = 1 << 20
_CANDIDATES = "own long, hash long, place int, skips int, letter string"


def _lower(word: Column) -> Column:
    """A-Z alone in lower case."""
    some = F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(some)


def lower_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word): every letter run of every text, A-Z lower-cased; id as text."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(text_col), F.lit(LETTERS), F.lit(0))).alias("run"))
    return runs.select("id", _lower(F.col("run")).alias("word"))


def with_damaged_words(runs: DataFrame, one_in: int = 97) -> DataFrame:
    """The words, of which one in `one_in` loses a letter, both told by a checksum of id and word."""
    h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
    at = (h % F.length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return runs.select(F.when(h % one_in == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the words of that length and frequency at least."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _number(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A 64-bit number for a code point at a place (-1 and more)."""
    return mix64((place.astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15) ^ mix64(code.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for length, rows in _by_length(words):
        step = max(1, _BLOCK // max(length, 1))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            codes = _codes([words[i] for i in part], length)
            out[part] = np.bitwise_xor.reduce(_number(np.arange(length)[None, :], codes), axis=1)
    return out


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        if length:
            yield length, np.flatnonzero(lengths == length)


def _running(x: np.ndarray, backward: bool = False) -> np.ndarray:
    """XOR of each row's first 0, 1, ... numbers; backward: of the numbers from 0, 1, ... to the end."""
    out = np.zeros((x.shape[0], x.shape[1] + 1), np.uint64)
    if backward:
        out[:, :-1] = np.bitwise_xor.accumulate(x[:, ::-1], axis=1)[:, ::-1]
    else:
        out[:, 1:] = np.bitwise_xor.accumulate(x, axis=1)
    return out


def neighbourhoods(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """Hashes of all distinct candidates of words of one length, a block at a time: (hashes, places, skips, codes, is a candidate).

    The arrays have the shape (words, places, letters). A candidate is the word's first `place` letters, the letter (a deletion has none),
    and the word from `place + skips` on."""
    n, length = codes.shape
    at = np.arange(length)[None, :]
    head = _running(_number(at, codes))
    stay, left, right = (_running(_number(at + d, codes), backward=True) for d in (0, -1, 1))
    follows = np.concatenate([np.full((n, 1), -1, np.int64), codes.astype(np.int64)], axis=1)  # the letter before each place
    step = max(1, _BLOCK // (n * len(alphabet)))
    letters = alphabet.astype(np.int64)[None, None, :]
    for a in range(0, length + 1, step):
        place = np.arange(a, min(a + step, length + 1))
        numbers = _number(place[:, None], alphabet[None, :])[None]
        yield (head[:, place] ^ right[:, place])[:, :, None] ^ numbers, place, 0, alphabet, letters != follows[:, place, None]
        place = place[place < length]
        if len(place):
            own = codes[:, place].astype(np.int64)
            yield (head[:, place] ^ stay[:, place + 1])[:, :, None] ^ numbers[:, : len(place)], place, 1, alphabet, letters != own[:, :, None]
            yield (head[:, place] ^ left[:, place + 1])[:, :, None], place, 1, np.zeros(1, np.uint32), (own != follows[:, place])[:, :, None]


def _filter_bits(words: int) -> int:
    bits = 1 << 15
    while bits < 32 * words and bits < MAX_BITS:
        bits *= 2
    return bits


def _bloom(hashed: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes: two bits for each hash, set block by block in the executors."""
    low = F.col("hash").bitwiseAND(F.lit(bits - 1))
    high = F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1))
    places = hashed.select(F.explode(F.array(low, high)).alias("p"))
    blocks = places.groupBy(F.shiftright("p", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("set"))
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.collect():  # bits / 8 bytes in all
        out[row["block"] * 4096 : row["block"] * 4096 + 4096] = np.frombuffer(row["set"], np.uint8)
    return out


def _asked(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter knows."""
    mask = np.uint64(8 * len(held) - 1)

    def is_set(x: np.ndarray) -> np.ndarray:
        p = x & mask
        return (held[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

    found = np.flatnonzero(is_set(hashes))
    return found[is_set(hashes[found] >> np.uint64(32))]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every word of the vocabulary (word, n, hash) with each word one edit away."""
    spark = words.sparkSession
    letters = [r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct().collect()]  # no more than LETTERS has
    alphabet = np.array(sorted(map(ord, letters)), np.uint32)
    held = spark.sparkContext.broadcast(_bloom(words, _filter_bits(words.count())))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            own = np.asarray(batch.column(1)).astype(np.int64)
            for length, rows in _by_length(texts):
                step = max(1, _BLOCK // ((length + 1) * len(alphabet)))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    for hashes, place, skips, codes, wanted in neighbourhoods(_codes([texts[i] for i in part], length), alphabet):
                        flat = hashes.ravel()
                        found = _asked(flat, held.value)
                        found = found[wanted.ravel()[found]]
                        i, k, c = np.unravel_index(found, hashes.shape)
                        letter = ["" if x == 0 else chr(x) for x in codes[c].tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[part[i]]), pa.array(flat[found].view(np.int64)), pa.array(place[k].astype(np.int32)), pa.array(np.full(len(found), skips, np.int32)), pa.array(letter, pa.string())],
                            ["own", "hash", "place", "skips", "letter"],
                        )

    made = words.select("word", "hash").mapInArrow(candidates, _CANDIDATES)
    near = words.select(F.col("hash"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    base = words.select(F.col("hash").alias("own"), "word", "n")
    text = F.concat(F.substring(F.col("word"), F.lit(1), F.col("place")), F.col("letter"), F.substring(F.col("word"), F.col("place") + F.col("skips") + 1, F.length("word")))
    met = made.join(near.hint("shuffle_hash"), "hash").join(base.hint("shuffle_hash"), "own")
    return met.where(text == F.col("near")).select("word", "n", "near", "near_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): the end of each word's chain of forms, by pointer doubling."""
    at = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = materialize(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """One row per word of a vocabulary (word, n): word, form, root, n, n_near, form_n."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word_hashes(batch.column(0).to_pylist()).view(np.int64))], ["word", "n", "hash"])

    table = materialize(words.select("word", F.col("n").cast("long")).mapInArrow(hashed, "word string, n long, hash long"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best")
    around = near_pairs(table).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = table.join(around, "word", "left")
    more = -F.col("best.m") >= ratio * F.col("n")
    formed = materialize(
        joined.select("word", F.when(more, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(more, -F.col("best.m")).alias("form_n")),
        "forms",
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
