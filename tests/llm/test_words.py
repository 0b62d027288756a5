"""Periodic runs, language identification and spelling variants."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import language, periodic_runs, spelling
from tessera.llm.queries import op11_periodic_runs, op12_language_id, op13_spelling_variants

from .conftest import made


def brute_runs(words, least_words=6, least_periods=4):
    """By every period, every stretch of words that equal the word a period before."""
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least_words, least_periods * q):
                part = words[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out)


def repeated(rng, letters, n):
    out = []
    while len(out) < n:
        out += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
    return out[:n]


def test_runs_are_those_of_a_search_by_every_period():
    rng = random.Random(3)
    for _ in range(1500):
        s = repeated(rng, rng.randint(1, 4), rng.randint(0, 70))
        for limits in ((6, 4), (1, 3), (9, 5)):
            assert periodic_runs.runs_of(s, *limits) == brute_runs(s, *limits)
            assert periodic_runs.text_runs([b"%d" % x for x in s], *limits) == brute_runs(s, *limits)


def fibonacci(n):
    a, b = [1], [1, 0]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


SEQUENCES = {
    "one word": lambda n: [0] * n,
    "Fibonacci": fibonacci,
    "Thue-Morse": lambda n: [i.bit_count() & 1 for i in range(n)],
    "ruler": lambda n: [((i + 1) & -(i + 1)).bit_length() for i in range(n)],
    "growing blocks": lambda n: [x for k in range(int((2 * n) ** 0.5) + 1) for x in [0] * k + [1]][:n],
    "shrinking blocks": lambda n: [x for k in range(int((2 * n) ** 0.5) + 1, 0, -1) for x in [0] * k + [1]][:n],
    "blocks": lambda n: ([0] * 50 + [1]) * (n // 51),
    "powers": lambda n: (fibonacci(int(n**0.5)) * n)[:n],
    "falling": lambda n: list(range(n, 0, -1)),
}


@pytest.mark.parametrize("name", SEQUENCES)
def test_comparisons_grow_with_the_text(name):
    """Reads of words, each comparison two, stay below a multiple of the text's length that does not grow."""

    class Read(list):
        reads = 0

        def __getitem__(self, i):
            Read.reads += 1
            return list.__getitem__(self, i)

    for sign in (1, -1):
        for n in (3000, 30_000):
            s = Read(sign * x for x in SEQUENCES[name](n))
            Read.reads = 0
            after, alike = periodic_runs.lyndon_steps(s)
            assert Read.reads <= 12 * n
        plain = list(s)[:300]
        after, alike = periodic_runs.lyndon_steps(plain)
        for i in range(0, 300, 7):
            smaller = next((j for j in range(i + 1, 300) if plain[j:] < plain[i:]), 300)
            assert after[i] == smaller
            if smaller < 300:
                assert alike[i] == next((k for k in range(300) if smaller + k == 300 or plain[i + k] != plain[smaller + k]), 0)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(i, text):
    words = words_of(text)
    n = len(words)
    if i is None or zlib.crc32(str(i).encode()) % 10 or not n:
        return words
    g = zlib.crc32(str(i).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k if k < a else a + (k - a) % p] for k in range(n)]


def brute_row(i, words):
    runs = brute_runs(words)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {k for a, n, q in runs for k in range(a + q, a + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    said = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *(top or (None, None, None)), top and 1000 * top[1] // top[2], sha(said), sha(kept))


RUNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.fixture(scope="module")
def repeating(corpus):
    rng = random.Random(8)
    rows = [(1000 + k, " ".join("ab c\xa0d é"[x * 2 : x * 2 + 2].strip() or "z" for x in repeated(rng, 4, rng.randint(1, 90)))) for k in range(120)]
    return corpus + rows + [(2000, "a\x1cb a\x1cb " * 9), (2001, "a \t\n\x0b\x0c\r" * 8), (2002, "x y " * 4000 + "x"), (2003, "one two one two one two"), (2004, "é É " * 3)]


def test_periodic_runs(spark, repeating):
    docs = made(spark, repeating).repartition(4)
    got = periodic_runs.find_runs(periodic_runs.with_planted_runs(docs), digests_only=True).select(*RUNS).collect()
    assert Counter(map(tuple, got)) == Counter(brute_row(i, planted(i, t)) for i, t in repeating)
    assert sum(r.n_runs for r in got) > 100
    plain = periodic_runs.find_runs(docs).collect()
    want = Counter((i, len(words_of(t)), tuple(brute_runs(words_of(t)))) for i, t in repeating)
    assert Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs)) for r in plain) == want
    assert {r.collapsed for r in plain if r.doc_id == 2002} == {"x y"}


def test_no_texts_no_runs(empty):
    assert periodic_runs.find_runs(periodic_runs.with_planted_runs(empty)).count() == 0
    with pytest.raises(ValueError, match="three"):
        periodic_runs.find_runs(empty, least_periods=2)


def test_runs_of_long_texts(spark):
    rng = random.Random(4)
    own = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    rows = [(1, " ".join(own)), (2, " ".join(own[:7] * 40_000)), (3, "x" * 2_000_000), (4, "y " * 500_000)]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(made(spark, rows)).collect()}
    assert got == {1: [], 2: [(0, 280_000, 7)], 3: [], 4: [(0, 500_000, 1)]}


LANGUAGES = {"xa": "the of and ing tion with thorn", "xb": "der und ein schen keit über größe", "xc": "что это как для мир слово", "xd": "です ます 日本 語 の は"}


def spoken(rng, lang, n):
    parts = LANGUAGES[lang].split(" ")
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def labelled(rng):
    rows = [(k, lang := rng.choice(list(LANGUAGES)), spoken(rng, lang, rng.randint(1, 60))) for k in range(800)]
    return [(i, t, g) for i, g, t in rows]


def test_languages_of_held_out_texts(spark):
    rng = random.Random(6)
    rows = labelled(rng) + [(900 + k, spoken(rng, g, 8000), None) for k, g in enumerate(LANGUAGES)] + [(None, spoken(rng, "xc", 9), "xc")]
    rows += [(950, None, "xa"), (951, "", "xa"), (952, "12 34 !?", "xb"), (953, "á", None), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' held_out", "1 score", "2 h", "3 g", "4 t", "'de' lang_pred")
    got = language.identify(df.repartition(3))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(rows)
    assert all(out == is_held_out(i) for i, out, *_ in found)
    assert all(0 <= s <= 1 for *_, s in found)
    by_id = {i: (g, s) for i, _, g, s in found}
    wanted = {i: g for i, t, g in rows if i is not None and is_held_out(i) and i < 900}
    assert len(wanted) > 100
    assert sum(by_id[i][0] == g for i, g in wanted.items()) / len(wanted) >= 0.97
    assert [by_id[900 + k][0] for k in range(4)] == list(LANGUAGES)
    assert by_id[950] == by_id[951] == by_id[952] == ("und", 0.0)
    assert by_id[953][0] in LANGUAGES


def test_languages_come_from_other_texts_alone(spark):
    """Labels of held-out documents, other columns and the own label change nothing."""
    rows = labelled(random.Random(9))[:400]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    base = {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in language.identify(df(rows)).collect()}
    turned = [(i, t, "zz" if is_held_out(i) else g) for i, t, g in rows]
    assert {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in language.identify(df(turned)).collect()} == base


def test_the_sample_is_bounded(spark):
    rng = random.Random(2)
    rows = [(k, spoken(rng, "xa" if k % 9 else "xb", 30), "xa" if k % 9 else "xb") for k in range(3000)] + [(7, "the same text", "xa")] * 500
    windows, wanted, languages = language.labelled_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 200)
    assert languages == ["xa", "xb"]
    assert len(windows) == len(wanted) <= 200 * language.WINDOWS_EACH
    assert min(np.bincount(wanted)) >= 100
    few = spark.createDataFrame([(k, "text of it", f"l{k % 40}") for k in range(400)], "g long, t string, h string")  # names from inside
    windows, _, languages = language.labelled_windows(few, "g", "t", "h", 50, max_languages=5)
    assert len(languages) == 5
    assert 5 <= len(windows) <= 50


def test_no_language_is_taught(spark, empty):
    assert language.identify(empty).count() == 0
    rows = [(1, "some text", None), (2, None, "xa")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = language.ByteNet.start(["a", "b", "c"])
    windows, wanted = rng.integers(0, 256, (4, 40)).astype(np.uint8), np.array([0, 1, 2, 1])
    for p, g in zip(net.parameters(), net.gradients(windows, wanted), strict=True):
        p[...] = p.astype(np.float32)
        for at in [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g).ravel())[:3]]:
            held, loss = p[at].copy(), []
            for step in (1e-2, -1e-2):
                p[at] = held + np.float32(step)
                loss.append(-np.log(net.answers(windows)[np.arange(4), wanted]).mean())
            p[at] = held
            assert abs((loss[0] - loss[1]) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at]))


def damaged(i, word):
    h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
    return word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]


def brute_variants(words, ratio=2):
    """From the counts of words, by comparing every two."""
    gone = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}

    def near(a, b):
        if a != b and len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return a in gone(b) if len(b) == len(a) + 1 else b in gone(a) if len(a) == len(b) + 1 else False

    around = {a: [b for b in words if near(a, b)] for a in words}
    form = {a: min(bs, key=lambda b: (-words[b], b.encode()), default=None) for a, bs in around.items()}
    form = {a: b if b is not None and words[b] >= ratio * words[a] else None for a, b in form.items()}
    rows = Counter()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows[w, form[w], root, n, len(around[w]), form[w] and words[form[w]]] += 1
    return rows


VARIANTS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants(spark, corpus):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 7))) for _ in range(25)]
    rows = []
    for k in range(300):
        words = [rng.choice(base) for _ in range(12)]
        for _ in range(3):
            at = rng.randrange(12)
            w = list(words[at])
            w[rng.randrange(len(w)) :][:1] = rng.choice(["", "a", "ab", "É"])
            words[at] = "".join(w).title() if rng.random() < 0.3 else "".join(w)
        rows.append((None if k % 50 == 0 else k, ", ".join(words)))
    rows += [r for r in corpus if r[0] != 410] + [(5000 + k, "hours hour hourx1hourx hours×÷ Ärger ärger aaaaa aaaaaa") for k in range(4)]
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            count[damaged(i, re.sub("[A-Z]", lambda m: m[0].lower(), run))] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    docs = made(spark, rows).repartition(4)
    vocabulary = spelling.vocabulary(spelling.with_damaged_words(spelling.lower_runs(docs)))
    got = spelling.group_variants(vocabulary).select(*VARIANTS).collect()
    want = brute_variants(words)
    assert Counter(map(tuple, got)) == want
    assert sum(r[1] is not None for r in want) > 10
    assert len(want) > 200


def test_candidates_are_made_once_and_all():
    rng = random.Random(5)
    alphabet = np.array(sorted(map(ord, "abé")), np.uint32)
    for word in ["a", "aab", "abéba", *["".join(rng.choice("abé") for _ in range(9)) for _ in range(20)]]:
        made_ = Counter()
        for hashes, place, skips, codes, wanted in spelling.neighbourhoods(spelling._codes([word], len(word)), alphabet):
            for _, k, c in zip(*np.nonzero(wanted), strict=True):
                text = word[: place[k]] + (chr(codes[c]) if codes[c] else "") + word[place[k] + skips :]
                made_[text] += 1
                if text:
                    assert hashes[0, k, c] == spelling.word_hashes([text])[0]
        cut = [word[:k] + word[k + 1 :] for k in range(len(word))]
        other = [word[:k] + x + word[k + 1 :] for k in range(len(word)) for x in "abé"]
        more = [word[:k] + x + word[k:] for k in range(len(word) + 1) for x in "abé"]
        assert made_ == Counter(set(cut + other + more) - {word})


def test_long_words_and_chains(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    words = {long: 9, long[:5000] + long[5001:]: 3, long[:-1] + "x": 4, "aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = Counter(map(tuple, spelling.group_variants(df).select(*VARIANTS).collect()))
    assert got == brute_variants(words)
    assert ("aaaaa", "aaaab", "bbbbb", 3, 1, 6) in got


def test_no_words_no_variants(spark, empty):
    words = spelling.vocabulary(spelling.with_damaged_words(spelling.lower_runs(empty)))
    got = spelling.group_variants(words)
    assert got.count() == 0
    assert got.columns == VARIANTS
    one = spark.createDataFrame([("alone", 5)], "word string, n long")
    assert list(map(tuple, spelling.group_variants(one).select(*VARIANTS).collect())) == [("alone", None, "alone", 5, 0, None)]


def test_queries_return_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert op11_periodic_runs(spark, sf).columns == RUNS
    assert op12_language_id(spark, sf).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert op13_spelling_variants(spark, sf).columns == VARIANTS
