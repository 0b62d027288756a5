"""BPE encoding and decoding by dynamic programming over the prefixes of each word.

The encoding of a word has one property that the whole method rests on: cut after any of its tokens,
it is the encoding of that prefix. So every prefix of a word has exactly one last token, which is the
vocabulary entry that ends there and is compatible with the last token of the prefix before it.
Two tokens are compatible if no merge across their border would come before the merges that build
them. A suffix automaton over the vocabulary (failure links lead from each match to the next shorter
one) names the entries that end at each position; following the stored last tokens back from the
whole word emits the ids.

Words come from the file's own normaliser and splitting pattern: for Latin text by the same pattern here, for any
other by the library. A bounded dictionary of words spares most of the work.

Null text is empty: no ids, empty decoded text. Special tokens in a text are recognised as the
library does. Rows that share an id are encoded one by one; texts of any length are encoded as a whole. An empty table
gives an empty table. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of
from .tokens import Known, in_bytes, is_latin, latin_words, load_tokenizer

_CHUNK = re.compile(r"[^ \n]+")
#: entries of the word dictionary of one worker
CHUNK_ENTRIES = 600_000
#: marks the last symbol of a word in the automaton's alphabet
_LAST = 0x10000


class PrefixEncoder:
    """Encoder and decoder of one vocabulary file with merges and an end-of-word suffix or none."""

    def __init__(self, path: str, entries: int = CHUNK_ENTRIES):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = {self._key(t): i for t, i in model["vocab"].items()}
        self.names = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = load_tokenizer(path)
        #: by id: rank of the merge that makes it (-1: a symbol), its halves, and by halves the rank
        self.rank: dict[int, int] = dict.fromkeys(self.ids.values(), -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            ka, kb = self._key(a), self._key(b)
            pair, made = (self.ids[ka], self.ids[kb]), self.ids[ka + kb]
            self.merges[pair] = rank
            self.halves[made], self.rank[made] = pair, rank
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        #: entries that their own string's encoding never gives; few or none
        self.unsound = {i for i in self.ids.values() if not self._reachable(i)}
        self.latin = latin_words(spec) if self.library.normalizer else None
        self.words, self.chunks = Known(self._latin_word, entries), Known(self._chunk, entries // 4)

    def _key(self, token: str) -> str:
        """A token in the automaton's alphabet: its last symbol takes the end-of-word mark in."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _LAST)
        return token

    def _border(self, a: int, b: int) -> int | None:
        """Rank of the first merge across the border of a and b while they are built, else None.

        A part stands at the border from its own merge on until its parent's. Of merges of one rank the
        left one comes first.
        """
        first = None
        parent_a = len(self.merges) + 1
        while True:
            x, parent_b = b, len(self.merges) + 1
            while True:
                rank = self.merges.get((a, x))
                if rank is not None and rank < parent_a and rank <= parent_b and (first is None or rank < first):
                    first = rank
                if x not in self.halves:
                    break
                parent_b, x = self.rank[x], self.halves[x][0]
            if a not in self.halves:
                return first
            parent_a, a = self.rank[a], self.halves[a][1]

    def _reachable(self, t: int) -> bool:
        """A merge's result is its string's encoding only if no earlier merge breaks its halves' border."""
        got = self.sound.get(t)
        if got is None:
            if t in self.halves:
                a, b = self.halves[t]
                got = self._reachable(a) and self._reachable(b) and self._border(a, b) == self.rank[t]
            else:
                got = True
            self.sound[t] = got
        return got

    def _compatible(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            got = self._border(a, b) is None
            if len(self.pairs) < 2_000_000:
                self.pairs[a, b] = got
        return got

    def word(self, word: str) -> list[int]:
        """Ids of one word given in the byte alphabet of the vocabulary."""
        text = word[:-1] + chr(ord(word[-1]) + _LAST) if self.suffix else word
        whole = self.ids.get(text)
        unsound, length, pairs = self.unsound, self.length, self.pairs
        if whole is not None and whole not in unsound:
            return [whole]
        last = [-1] * (len(text) + 1)  # by the length of the prefix; -1: no encoding ends here
        done = -1
        for end, t in self.automaton.iter(text):
            if end == done or t in unsound:
                continue
            start = end + 1 - length[t]
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get((before, t))
                if not (self._compatible(before, t) if fits is None else fits):
                    continue
            last[end + 1] = t
            done = end
        out, at = [], len(text)
        while at > 0:
            t = last[at]
            if t < 0:
                raise ValueError(f"no encoding of {word!r}")
            out.append(t)
            at -= length[t]
        return out[::-1]

    def _latin_word(self, word: str) -> tuple[bytes, str]:
        ids = self.word(in_bytes(word))
        return array("I", ids).tobytes(), self.decode(ids)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """A white-space-delimited chunk of any text, normalised and split by the library."""
        ids: list[int] = []
        for part in self.special_at.split(chunk) if self.special_at else [chunk]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part) if self.library.normalizer else part):
                    ids += self.word(piece)
        return array("I", ids).tobytes(), self.decode(ids)

    def decode(self, ids) -> str:
        """The file names no decoder: the library then joins the tokens with spaces."""
        return " ".join([self.names[i] for i in ids])

    def __call__(self, text: str) -> tuple[bytes, str]:
        """Ids (little-endian unsigned 32-bit) and decoded text of a whole text."""
        if self.latin and is_latin(text):
            got = map(self.words.__getitem__, self.latin(text))
        else:
            got = map(self.chunks.__getitem__, _CHUNK.findall(text))
        got = list(got)
        if not got:
            return b"", ""
        ids, words = zip(*got, strict=True)
        return b"".join(ids), " ".join(filter(None, words))


_encoders: dict = {}


def prefix_encoder(path: str) -> PrefixEncoder:
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian u32) and decoded, or their SHA-256 alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = prefix_encoder(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, 1):
                n, ids, decoded = [], [], []
                for text in batch.column(1).to_pylist():
                    x, y = encode(text)
                    n.append(len(x) // 4)
                    ids.append(hashlib.sha256(x).hexdigest() if digests_only else x)
                    decoded.append(hashlib.sha256(y.encode()).hexdigest() if digests_only else y)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests_only else pa.binary()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests_only else ("ids", "decoded"))],
                )

    ids, text = ("ids_sha256 string", "decoded_sha256 string") if digests_only else ("ids binary", "decoded string")
    return docs.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(run, f"doc_id long, n_tokens long, {ids}, {text}")
