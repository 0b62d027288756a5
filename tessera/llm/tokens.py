"""Token ids of whole texts, a piece of text at a time.

A text in Latin letters is cut into the words of the vocabulary's own splitting pattern, which no token
spans (lower-cased first, where the vocabulary does so). Any other text is cut into chunks: a run of spaces
and line feeds with what follows up to the next one, whose start no token spans either; where a text has
other white space next to such a start, it goes to the encoder whole. A text's ids are those of its
pieces in order, and a bounded dictionary of pieces spares most of the encoding.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

#: entries of the chunk dictionary of one worker; texts beyond it are encoded without being stored
CHUNK_ENTRIES = 1_000_000
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_UNSAFE = re.compile(r"[^\S \n][ \n]")
#: letters whose case and class are alike in all Unicode versions and which are in composed form
LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e"
_LATIN = re.compile(f"[\\t\\n\\r\\x20-\\x7e{LETTERS}]*")
_loaded: dict = {}


def latin_words(spec: dict) -> Callable[[str], list[str]] | None:
    """Splits Latin text as a tokenizer file's normaliser and pattern do; None for a file with other ones."""
    before = spec.get("pre_tokenizer") or {}
    letters = f"A-Za-z{LETTERS}"
    if spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return re.compile(rf" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{letters}0-9]+| ?[0-9]+|\s+(?!\S)|\s+").findall
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = before.get("pretokenizers", [])
    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    if kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0].get("invert") and steps[0]["pattern"].get("Regex") == words:
        find = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[^\s{letters}0-9]+|[0-9]").findall
        return lambda text: find(text.lower())
    return None


def is_latin(text: str) -> bool:
    """Latin text without anything like a special token."""
    return "<|" not in text and _LATIN.fullmatch(text) is not None


def load_tokenizer(path: str):
    """The tokenizers library's encoder in this file, once for each worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTES = byte_alphabet()


def in_bytes(word: str) -> str:
    return word.encode().decode("latin-1").translate(BYTES)


class Known(dict):
    """A bounded dictionary that learns what it lacks."""

    def __init__(self, learn: Callable, entries: int):
        super().__init__()
        self.learn, self.entries = learn, entries

    def __missing__(self, key):
        got = self.learn(key)
        if len(self) < self.entries:
            self[key] = got
        return got


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = CHUNK_ENTRIES):
        self.library = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            self.split = latin_words(json.load(f))
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.words = Known(_by_ranks(ranks) if os.path.exists(ranks) else self._by_model, entries)
        self.chunks = Known(self.whole, entries // 4)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _by_model(self, word: str) -> bytes:
        return array("I", [t.id for t in self.library.model.tokenize(in_bytes(word))]).tobytes()

    def encode(self, text: str) -> bytes:
        if self.split and is_latin(text):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        if _UNSAFE.search(text):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


def _by_ranks(path: str) -> Callable[[str], bytes]:
    """The same vocabulary as ranks, whose encoder is faster."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda word: array("I", encode(word)).tobytes()


_encoders: dict = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
