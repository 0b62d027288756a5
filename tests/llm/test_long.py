"""Texts of several megabytes go through every operator as a whole."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import bpe, exact_dedup, line_dedup, packing, quality, token_files, url_filters
from tessera.llm.queries import URL_RULES, tokenizer

from .conftest import made
from .test_dedup import kept_lines, repeats
from .test_text import brute_statistics, brute_verdict
from .test_tokens import library


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 14)))
    lines = [line() for _ in range(45_000)]
    return [(1, "\n".join(lines)), (2, "\n".join(lines[100:140] + [line() for _ in range(20)])), (3, "x" * 300_000), (4, "\n".join(lines)), (5, "short")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    assert max(len(t) for _, t in rows) > 2_000_000
    return made(spark, rows).repartition(2).cache()


def test_lines_of_a_long_text(docs, rows):
    assert Counter(map(tuple, line_dedup.dedup_lines(docs, digests_only=True).collect())) == kept_lines(rows)


def test_long_copies(docs, rows):
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: 4, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()} == {2, 3, 4, 5}


def test_statistics_of_a_long_text(docs, rows):
    got = quality.statistics(docs).select("doc_id", *quality.BASE).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_statistics(t)) for i, t in rows)


def test_ids_of_a_long_text(docs, rows):
    encode, t = library("word_bpe_49k.json")
    path, want, files, start = tokenizer("word_bpe_49k.json"), Counter(), Counter(), 0
    for i, text in rows:
        ids = encode(text)
        want[i, len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        files[i, start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], np.uint32).tobytes())] += 1
        start += len(ids) + 1
    assert Counter(map(tuple, bpe.encode_decode(docs, path, digests_only=True).collect())) == want
    read = token_files.read_token_files(token_files.write_token_files(docs, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert Counter(map(tuple, read.collect())) == files


def test_pieces_of_a_long_text(docs, rows):
    encode, _ = library("byte_bpe_50k.json")
    out = packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect()
    assert {i: sum(r.length for r in out if r.doc_id == i) for i, _ in rows} == {i: len(encode(t)) + 1 for i, t in rows}
    assert max(r.length for r in out) == 1024
    assert len({r.sequence_id for r in out}) <= -(-sum(r.length for r in out) // 1024) + 2


def test_long_repeats(spark):
    rng = random.Random(22)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, text), (2, text[5_000:5_400] + "own words " * 3 + text[390_000:390_150]), (3, text[7_000:7_099])]
    from tessera.llm import suffix_dedup

    assert Counter(map(tuple, suffix_dedup.remove_repeats(made(spark, rows), digests_only=True).collect())) == repeats(rows, 100)


def test_long_urls(spark):
    urls = ["http://" + "a." * 2000 + "example.com/en/7" + "x/" * 50_000, "http://net" + "/de/" * 20_000, "http://" + "b" * 500_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, url_filters.rules_frame(spark, URL_RULES)).collect()}
    assert got == {i: brute_verdict(u, URL_RULES) for i, u in enumerate(urls)}
