"""Tokens, packing, files and BPE against the tokenizers library and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import bpe, packing, token_files, tokens
from tessera.llm.queries import tokenizer

low = lambda i: -(2**63) if i is None else i


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, t


def odd_texts():
    rng = random.Random(3)
    out = ["", " ", "\n\n a", "a\t  b", "a \n\n  b  \n", "x<|endoftext|>y <|startoftext|>", "ΣΑΣ İı ŉ ſ ǅ", "don't 'RE we'll", "日本語 😀   　 \x1c\x85", "1234 4½ ①"]
    for _ in range(150):
        out.append("".join(chr(rng.choice([rng.randrange(1, 0x500), rng.randrange(1, 128), 32, 10, 9, rng.randrange(0x2000, 0x3100), rng.randrange(0x10000, 0x1F700)])) for _ in range(120)))
        out.append("".join(rng.choice("aabnl oe\n'stREé.,ßÀ") for _ in range(150)))
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piecewise_ids_are_the_library_s(name):
    encode, _ = library(name)
    ours = tokens.ChunkEncoder(tokenizer(name), entries=500)
    for text in odd_texts():
        assert ours.encode(text) == np.array(encode(text), np.uint32).tobytes(), repr(text)


def test_prefix_encoder_is_the_library():
    encode, t = library("word_bpe_49k.json")
    ours = bpe.PrefixEncoder(tokenizer("word_bpe_49k.json"), entries=500)
    for text in odd_texts():
        ids = encode(text)
        assert ours(text) == (np.array(ids, np.uint32).tobytes(), t.decode(ids, skip_special_tokens=False)), repr(text)


def test_every_prefix_is_encoded_by_the_tokens_before():
    """The property that the dynamic programming rests on."""
    ours = bpe.PrefixEncoder(tokenizer("word_bpe_49k.json"))
    for word in ("internationalisation", "aaaaaaa", "bananabanana"):
        ids = ours.word(word)
        names = [ours.names[i] for i in ids]
        assert "".join(names) == word + "</w>"
        for k in range(1, len(ids)):
            assert ours._compatible(ids[k - 1], ids[k])


def test_encode_decode(docs, corpus, empty):
    encode, t = library("word_bpe_49k.json")
    want = Counter()
    for i, text in corpus:
        ids = encode(text)
        want[i, len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    path = tokenizer("word_bpe_49k.json")
    assert Counter(map(tuple, bpe.encode_decode(docs, path, digests_only=True).collect())) == want
    assert bpe.encode_decode(empty, path).count() == 0


@pytest.mark.parametrize(("width", "file_tokens"), [(1, 1 << 20), (8, 300)])
def test_token_files(docs, corpus, empty, width, file_tokens):
    encode, _ = library("word_bpe_49k.json")
    path = tokenizer("word_bpe_49k.json")
    files = token_files.write_token_files(docs, path, file_tokens=file_tokens, width=width)
    start, want = 0, Counter()
    for i, text in sorted(corpus, key=lambda r: (low(r[0]), (r[1] or "").encode())):
        ids = np.array([*encode(text), 2], np.uint32)
        want[i, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    got = token_files.read_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert Counter(map(tuple, got)) == want
    assert token_files.read_token_files(token_files.write_token_files(empty, path)).count() == 0


@pytest.mark.parametrize("width", [1, 8])
def test_blocks_alone(width):
    ids = np.random.default_rng(1).integers(0, 2**32, 1000, np.uint32)
    content = token_files.write_file([1, 2], [400, 600], ids, width, block=128)
    head, docs, chunks = token_files.read_index(content)
    assert docs.tolist() == [[1, 2], [400, 600]]
    assert len(chunks) == 8
    assert (token_files.read_block(content, head, chunks, 7) == ids[896:]).all()


def best_fit_decreasing(lengths, capacity):
    """Number of sequences when each document, longest first, goes to the fullest sequence that has room."""
    import bisect

    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, length)
        if k < len(rooms):
            room = rooms.pop(k)
        else:
            room, n = capacity, n + 1
        if room > length:
            bisect.insort(rooms, room - length)
    return n


def lengths_of(kind, rng):
    return {
        "even": lambda: [rng.randint(1, 1024) for _ in range(1500)],
        "short": lambda: [rng.choice([1, 2, 3, 17, 30, 60, 100]) for _ in range(2500)],
        "alike": lambda: [300] * 700 + [333] * 300 + [40] * 90,
        "bimodal": lambda: [rng.randint(900, 1024) for _ in range(500)] + [rng.randint(1, 90) for _ in range(900)],
        "middle": lambda: [rng.randint(257, 512) for _ in range(900)],
    }[kind]()


@pytest.mark.parametrize("kind", ["even", "short", "alike", "bimodal", "middle"])
def test_as_few_sequences_as_best_fit_decreasing(spark, kind):
    lengths = lengths_of(kind, random.Random(1))
    pieces = spark.createDataFrame([(k % 50, 0, 0, n, k) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    rows = packing.place(pieces, 1024, per_group=20).collect()
    assert sorted((r.ids_crc32, r.length) for r in rows) == list(enumerate(lengths))
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    best = best_fit_decreasing(lengths, 1024)
    print(kind, len(used), best, -(-sum(lengths) // 1024))
    assert len(used) <= best + best // 200


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_few_lengths_take_no_more_sequences_than_best_fit_decreasing(spark, seed):
    """Lengths beside the places where one more document fits, and random ones."""
    rng = random.Random(seed)
    kinds = [204, 205, 256, 257, 340, 341, 342, 511, 512] if seed == 0 else rng.sample(range(100, 900), 8)
    lengths = [rng.choice(kinds) for _ in range(3000)]
    pieces = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    rows = packing.place(pieces, 1024, per_group=500).collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(used.values()) == sum(lengths)
    assert max(used.values()) <= 1024
    assert len(used) <= best_fit_decreasing(lengths, 1024)


def test_sweep_counts_are_those_of_a_stack():
    rng = random.Random(2)
    for _ in range(50):
        documents, offered = Counter(rng.choices(range(1, 30), k=40)), Counter(rng.choices(range(1, 30), k=30))
        before, matched = packing.sweep_counts(documents, offered)
        stack, height = 0, 0
        for size in range(29, 0, -1):
            assert before.get(size, height) == height
            stack, height = stack + offered[size], height + offered[size] - documents[size]
            taken = min(stack, documents[size])
            assert matched.get(size, 0) == taken
            stack -= taken


def test_pack(docs, corpus, empty):
    encode, _ = library("byte_bpe_50k.json")
    path = tokenizer("byte_bpe_50k.json")
    want = Counter()
    for i, text in corpus:
        ids = np.array([*encode(text), 2], np.uint32)
        first = len(ids) % 256 or 256
        for k, at in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[at : first if k == 0 else at + 256]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packing.pack(docs, path, capacity=256).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= 1.05 * sum(r.length for r in rows) / 256 + 1
    assert packing.pack(empty, path).count() == 0


def test_packed_sequences(spark):
    from .conftest import made

    df = made(spark, [(1, "hello world"), (2, "a longer text of some more words"), (3, None)])
    out = packing.packed_sequences(df, tokenizer("byte_bpe_50k.json"), capacity=16).collect()
    assert sum(len(r.ids_le_u32) for r in out) == 4 * sum(p.length for r in out for p in r.pieces)
