"""Exact, line, near and suffix dedup against brute force."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import components, exact_dedup, line_dedup, near_dedup, shingles, suffix_dedup

from .conftest import INSIDE, made

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
low = lambda i: -(2**63) if i is None else i


def test_exact_groups(docs, corpus, empty):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    want = Counter((i, max(groups[t or ""], key=low), len(groups[t or ""]), low(i) == max(map(low, groups[t or ""])), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in corpus)
    assert Counter(map(tuple, exact_dedup.exact_groups(docs, salts=3).collect())) == want
    assert exact_dedup.exact_groups(empty).count() == 0


def assert_extra_columns_untouched(rows):
    assert all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in INSIDE)


def test_exact_keeps_one_row_of_each_text(docs, corpus, empty):
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert_extra_columns_untouched(rows)
    assert Counter(r.text or "" for r in rows) == Counter(dict.fromkeys({t or "" for _, t in corpus}, 1))
    assert exact_dedup.drop_exact_duplicates(empty).columns == empty.columns


def kept_lines(corpus, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in corpus:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(low(i))
    out = []
    for i, t in corpus:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == low(i)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("shard_chars", "hot"), [(24_000_000, 50_000), (2_000, 50_000), (2_000, 10**9)])
def test_lines(docs, corpus, empty, monkeypatch, shard_chars, hot):
    monkeypatch.setattr(line_dedup, "SHARD_CHARS", shard_chars)
    if hot > 50_000:  # every key found in several documents is hot
        build = line_dedup.build_index
        monkeypatch.setattr(line_dedup, "build_index", lambda d, i, t, m, s, hot_at: build(d, i, t, m, s, 2))
    assert Counter(map(tuple, line_dedup.dedup_lines(docs, digests_only=True).collect())) == kept_lines(corpus)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64)
    mph = line_dedup.PerfectHash.build(keys)
    assert sorted(mph.slots(keys)) == list(range(5000))


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset({tuple(words)} if words else ())


def near(corpus, width, percent):
    rows = [(i, shingle_set(t, width)) for i, t in corpus]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(rows):
        for b, y in rows[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    out = []
    for i, s in rows:
        c = None if i is None else find(i)
        out.append((i, len(s), c, i == c))
    return Counter(out)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near(docs, corpus, empty, width, percent):
    assert Counter(map(tuple, near_dedup.near_duplicates(docs, width=width, percent=percent).collect())) == near(corpus, width, percent)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_links_besides_a_refuted_star(spark):
    """The smallest id of a bucket is like neither of two others that are alike."""
    base = [f"w{k}" for k in range(300)]
    other = base[:200] + [f"x{k}" for k in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join([*other[:-3], "y", "z", "q"])), (4, " ".join([*base[:-3], "y", "z", "q"]))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(made(spark, rows), width=3, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1}


def chain_behind_foreign_hubs():
    """r is like y and y like x, but not r like x; smaller ids that are like none of them share every key of y and x that r lacks."""
    rng = random.Random(1)
    y = [f"w1x{k}" for k in range(200)]
    hubs = [y[:40] + rng.sample(y[40:160], 86) for _ in range(40)]
    return [(i, " ".join(t)) for i, t in [(1, y[40:]), *enumerate(hubs, 2), (100, y), (101, y[:160])]]


def test_near_link_of_a_member_other_than_the_root(spark):
    """Of the component of r and y, y alone shares longer keys with x."""
    rows = chain_behind_foreign_hubs()
    want = near(rows, 1, 80)
    assert {i: c for i, _, c, _ in want}[101] == 1
    assert Counter(map(tuple, near_dedup.near_duplicates(made(spark, rows).coalesce(1), width=1, percent=80).collect())) == want


def near_copies(seed, n=240, words=120, vocabulary=None):
    """Copies of one text with few to many edits (words replaced, dropped, put in; some from a small vocabulary), many just above or below a link."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    rows = [(1, " ".join(base))]
    for i in range(2, n + 2):
        text, edits = list(base), rng.choice([1, 2, 3, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 12, 15])
        for k in range(edits):
            at, kind = rng.randrange(len(text)), rng.random()
            new = f"v{rng.randrange(vocabulary)}" if vocabulary else f"n{i}x{k}"
            text[at : at + (kind < 0.8)] = [] if kind > 0.92 else [new] if kind < 0.8 else [new, text[at]]
        if rng.random() < 0.1:
            text = text[: rng.randrange(60, len(text))]
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "percent", "vocabulary"), [(1, 3, 85, None), (2, 5, 80, None), (3, 3, 85, 3), (4, 1, 90, 2), (5, 1, 85, None)])
def test_near_copies_of_one_text(spark, seed, width, percent, vocabulary):
    rows = near_copies(seed, vocabulary=vocabulary)
    assert Counter(map(tuple, near_dedup.near_duplicates(made(spark, rows).repartition(4), width=width, percent=percent).collect())) == near(rows, width, percent)


def test_centred_filter_leaves_out_no_link(spark):
    """Whatever the centre, every link between documents of which not both are linked with it is a pair; few others are."""
    rows = near_copies(7, n=150)
    sets = {i: shingle_set(t, 3) for i, t in rows}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    texts = spark.createDataFrame(rows, "id long, t string")
    for centre in (1, 30, 77):
        groups = spark.createDataFrame([(centre, i, i) for i in sets], "c long, id long, root long")
        deltas = near_dedup.differences(groups, texts, 3, 85).selectExpr("*", "monotonically_increasing_id() row").cache()
        got = {(r.a, r.b) for r in near_dedup.centred_pairs(deltas, 85).collect()}
        near_centre = {i for i in sets if linked(centre, i)}
        assert {r.x for r in deltas.where("linked").collect()} == near_centre - {centre}
        want = {(a, b) for a in sets for b in sets if a < b and centre not in (a, b) and linked(a, b) and not (a in near_centre and b in near_centre)}
        assert want <= got
        assert len(got) < len(sets) ** 2 // 8


def test_drop_near(docs):
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert_extra_columns_untouched(kept.collect())
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()}


def test_shingles_of_long_texts():
    text = ("alpha beta gamma " * 200_000).encode()
    sets, places = shingles.shingle_sets(np.array([0, len(text)]), np.frombuffer(text, np.uint8), 3)
    assert list(places) == [0, 3]
    assert len(sets) == 3


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in [*range(1, 41), 100]}, 200: 200, 201: 200}


def repeats(corpus, length, key=lambda r: (low(r[0]), r[1] or "")):
    order = sorted(set(corpus), key=key)
    seen, out = set(), {}
    for i, t in order:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cover[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        out[i, t] = (len(b), sum(cover), sum(1 for p in range(len(b)) if cover[p] and (p == 0 or not cover[p - 1])), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    return Counter((i, *out[i, t]) for i, t in corpus)


@pytest.mark.parametrize(("shard_chars", "items"), [(48_000_000, 60_000), (3_000, 40)])
def test_suffixes(spark, corpus, empty, monkeypatch, shard_chars, items):
    """Several ranges, shards and runs; rows that share an id but not the text are ordered by a hash, so they are left out here."""
    monkeypatch.setattr(suffix_dedup, "SHARD_CHARS", shard_chars)
    monkeypatch.setattr(suffix_dedup, "RANGE_ITEMS", items)
    monkeypatch.setattr(suffix_dedup, "MOST_BORDERS", 5)
    rows = [r for r in corpus if r[0] not in (13, None)] + [(None, "no id " * 20)]
    docs = made(spark, rows).repartition(5)
    for length in (64, 100):
        assert Counter(map(tuple, suffix_dedup.remove_repeats(docs, length=length, digests_only=True).collect())) == repeats(rows, length)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffixes_of_rows_that_share_an_id(spark, corpus):
    """The tie rule: rows of one id, and of none, come in the order of their texts' hashes."""
    from pyspark.sql import functions as F

    rng = random.Random(17)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) for _ in range(n))
    parts = [words(30) for _ in range(4)]
    rows = [(i, f"{words(5)} {rng.choice(parts)} {words(4)} {rng.choice(parts)}") for i in [13] * 12 + [None] * 12 + [14, 12, 13, None]]
    docs = made(spark, rows)
    tie = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    got = Counter(map(tuple, suffix_dedup.remove_repeats(docs.repartition(4), digests_only=True).collect()))
    assert got == repeats(rows, 100, lambda r: (low(r[0]), tie[r]))
    assert sum(r[2] > 0 for r in got) > 15


def common_line(n):
    """Documents that all hold one line, each between texts of its own; some of them share a window around the line."""
    rng, line = random.Random(9), "a line that every document of this table holds, of 70 bytes in all, ok"
    letters = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    ends = [(letters(60), letters(60)) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        left, right = rng.choice(ends), rng.choice(ends)
        rows.append((i, letters(rng.randrange(40)) + left[0][rng.randrange(60) :] + line + right[1][: rng.randrange(60)] + letters(rng.randrange(60))))
    return rows


@pytest.mark.parametrize("hot", [True, False])
def test_an_anchor_of_all_documents_is_parted(spark, monkeypatch, hot):
    rows = common_line(160)
    seen = []
    monkeypatch.setattr(suffix_dedup, "RANGE_ITEMS", 20 if hot else 60_000)
    deal = suffix_dedup.deal
    monkeypatch.setattr(suffix_dedup, "deal", lambda *x: seen.append(deal(*x)) or seen[-1])
    assert Counter(map(tuple, suffix_dedup.remove_repeats(made(spark, rows).repartition(3), digests_only=True).collect())) == repeats(rows, 100)
    assert bool(seen[0].hot) == hot


def test_stretches_hold_every_window_once():
    rng = random.Random(4)
    dealing = suffix_dedup.Dealing([], 1, frozenset([b"x" * 32]), 7)
    for _ in range(300):
        last = rng.randrange(69)
        first = rng.randrange(last, 69)
        left, suffix = bytes(rng.choices(b"ab", k=first)), b"x" * 32 + bytes(rng.choices(b"ab", k=68 - last))
        parts = list(dealing.targets(suffix, left, first, last, 100))
        assert sorted(o for _, f, e in parts for o in range(e, f + 1)) == list(range(last, first + 1))


def test_batches_of_many_short_rows():
    import pyarrow as pa

    from tessera.llm.common import slices

    cut = [x.num_rows for x in slices(pa.RecordBatch.from_arrays([pa.array(["a"] * 150_000)], ["t"]), 0)]
    assert max(cut) <= 65_000
    assert sum(cut) == 150_000


def test_suffixes_of_one_long_document(spark):
    rng = np.random.default_rng(3)
    part = "".join(map(chr, rng.integers(97, 123, 5_000)))
    rows = [(1, part + "".join(map(chr, rng.integers(97, 123, 200_000))) + part), (2, part[1000:1100]), (3, part[1000:1099])]
    assert Counter(map(tuple, suffix_dedup.remove_repeats(made(spark, rows), digests_only=True).collect())) == repeats(rows, 100)


def test_documents_without_repeats(spark):
    text = "é" * 80 + "".join(chr(200 + k) for k in range(100))
    rows = [(1, text), (2, "x" + text + "y"), (3, None), (4, "short")]
    out = {r.doc_id: r for r in suffix_dedup.documents_without_repeats(made(spark, rows)).collect()}
    assert_extra_columns_untouched(out.values())
    # bytes C3 A9 repeat from the third byte on, up to the C3 that the next letter begins with: that letter goes as a whole
    assert out[1].text == "é" + text[81:]
    assert out[1].n_chars == len(out[1].text)
    assert out[2].text == "xy"
    assert out[2].n_chars == 2
    assert out[3].text is None
    assert out[4].text == "short"


def test_loser_tree():
    rng = np.random.default_rng(2)
    runs = []
    for _ in range(7):
        words = sorted(bytes(rng.integers(97, 99, rng.integers(0, 6)).tolist()) for _ in range(rng.integers(0, 30)))
        runs.append((words, [suffix_dedup.common_prefix(a, b, 0) for a, b in zip([b"", *words], words, strict=False)]))
    order, shares = suffix_dedup.merge_runs(runs)
    merged = [runs[r][0][i] for r, i in order]
    assert merged == sorted(w for r in runs for w in r[0])
    assert all(s == suffix_dedup.common_prefix(a, b, 0) for a, b, s in zip(merged, merged[1:], shares[1:], strict=False))
