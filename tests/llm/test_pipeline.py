"""The stages' contracts, and the rows of every stage and of the whole against brute force on a small corpus."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import suffix_dedup

from .conftest import made
from .test_dedup import near
from .test_text import brute_statistics
from .test_tokens import best_fit_decreasing, library

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def rows():
    """Texts of 40 to 140 words: copies, near copies, shared passages, umlauts, junk, nulls, an empty and a long text."""
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioustnrléü") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, "\n".join(text(rng.randint(20, 35)) for _ in range(rng.randint(2, 4)))) for i in range(40)]
    out += [(100 + i, out[i % 6][1]) for i in range(12)]
    for i in range(15):
        copy = out[10 + i % 4][1].split(" ")
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = f"changed{i}"
        out.append((200 + i, " ".join(copy)))
    passage = text(30)
    out += [(300 + i, f"{text(40)} {passage} {text(25)}") for i in range(8)]
    out += [(400, None), (401, ""), (402, "too short"), (403, "again and again and " * 30), (404, text(3000)), (405, "ü" * 150 + " " + text(60)), (406, "ü" * 150 + " " + text(60))]
    out += [(500 + i, " ".join(f"{rng.choice(words)}#$%" for _ in range(70))) for i in range(30)]
    return out


def written(spark, path, rows, labels):
    made(spark, rows).select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("sf"), rows, [(i, 1, 0) for i in range(40)] + [(500 + i, 0, 0) for i in range(30)])


def passes(text):
    """The base rules, and junk of symbols, which the labels tell apart from all else."""
    n, _, symbols, _, repeated = brute_statistics(text)
    return n >= 50 and 100 * repeated <= 50 * n and symbols < n


def without_repeats(rows, length=100):
    """Kept texts: bytes covered by a string that starts earlier go, and the rest of the characters that they cut."""
    seen, out = set(), []
    for i, text in sorted(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept, at = [], 0
        for c in text:
            size = len(c.encode())
            if not any(gone[at : at + size]):
                kept.append(c)
            at += size
        out.append((i, "".join(kept)))
    return out


def brute_stages(rows):
    kept = [(i, t) for i, t in rows if passes(t)]
    yield kept
    largest = {}
    for i, t in kept:
        largest[t] = max(i, largest.get(t, i))
    kept = [(i, t) for i, t in kept if largest[t] == i]
    yield kept
    stays = {i for i, _, _, k in near(kept, 5, 80) if k}
    kept = [(i, t) for i, t in kept if i in stays]
    yield kept
    yield without_repeats(kept)


def pieces(rows):
    encode, _ = library("byte_bpe_50k.json")
    for i, text in rows:
        ids = np.array([*encode(text), 2], np.uint32)
        first = len(ids) % 1024 or 1024
        for k, at in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[at : first if k == 0 else at + 1024]
            yield i, k, at, len(part), zlib.crc32(part.tobytes())


def held_against_brute_force(out, kept):
    want = Counter(pieces(kept))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    assert len(used) <= best_fit_decreasing([n for *_, n, _ in want.elements()], 1024) + 1


def test_every_stage_is_the_brute_force_one(spark, rows, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "minhash_near_dedup", "suffix_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:-1], brute_stages(rows), strict=True):
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        docs = corpus_pipeline.common.materialize(out, name)
        assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == sorted((i, t, len(t)) for i, t in kept), name
    assert 5 < len(kept) < len(rows) - 40
    held_against_brute_force(corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect(), kept)


def test_run(spark, rows, folder):
    *_, kept = brute_stages(rows)
    held_against_brute_force(corpus_pipeline.run(spark, folder).collect(), kept)


def test_without_rows_or_labels(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).collect() == []


def test_unlabelled_tables_keep_what_the_base_rules_pass(spark, rows, tmp_path):
    path = written(spark, tmp_path, rows, [])
    out = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    want = {i for i, t in rows if passes(t) or i >= 500}
    assert {r.doc_id for r in out.collect()} == want


def test_cut_characters_go_as_a_whole(spark):
    rows = [(1, "ü" * 150), (2, "é" * 49 + "ü" * 120)]
    out = suffix_dedup.documents_without_repeats(made(spark, rows)).collect()
    assert {r.doc_id: r.text for r in out} == dict(without_repeats(rows))


def test_tables_of_the_stages_go(spark, rows, folder, tmp_path, monkeypatch):
    """After a run only the last stage's tables and its input are there; the rows can still be read."""
    from tessera.operators import shared

    monkeypatch.setattr(shared, "shared_folder", lambda s: f"file://{tmp_path}/way")
    out = corpus_pipeline.run(spark, folder)
    left = {p.name.split("-")[1] for p in (tmp_path / "way").iterdir()}
    assert left <= {"suffix_dedup", "pieces", "superstep", "gaps"}
    *_, kept = brute_stages(rows)
    held_against_brute_force(out.collect(), kept)
