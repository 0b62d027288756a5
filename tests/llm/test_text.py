"""Quality rules, URL filters, quotation linking."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import quality, quotes, url_filters
from tessera.llm.queries import URL_RULES, op3_url_filters

from .conftest import INSIDE, made


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs, corpus, empty):
    got = quality.statistics(docs).select("doc_id", *quality.BASE).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_statistics(t)) for i, t in corpus)
    assert quality.statistics(empty).count() == 0


def labelled(spark):
    good = [(i, " ".join(f"word{i}x{k}" for k in range(80))) for i in range(120)]
    bad = [(1000 + i, " ".join(f"w{i}x{k}$%" for k in range(80))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:90]] + [(i, 0) for i, _ in bad[:45]], "doc_id long, quality int")
    return made(spark, good + bad), labels


def test_learned_rules_hold_out(spark):
    docs, labels = labelled(spark)
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept == set(range(120))
    rows = quality.keep_good(docs, labels)
    assert rows.columns == docs.columns
    assert {r.doc_id for r in rows.collect()} == kept
    assert all(r[n] == f"{n} of {r.doc_id}" for r in rows.collect() for n in INSIDE)


def test_repeated_ids_count_once_in_the_sample(spark):
    """The sample's bound holds for rows, whichever ids repeat."""
    docs = made(spark, [(1, f"{k} " + "word " * 60) for k in range(50)] + [(2, f"w{k} " * 60) for k in range(3)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, quality int")
    assert len(quality.labelled_sample(docs, labels, "doc_id", "text", 20_000)) <= 2


def test_without_labels_only_base_rules_reject(docs, corpus, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Counter((r.doc_id, r.kept) for r in quality.judge(docs, labels).collect())
    want = Counter()
    for i, t in corpus:
        n, *_, repeated = brute_statistics(t)
        want[i, not (n < 50 or 100 * repeated > 50 * n)] += 1
    assert got == want


def test_decision_list_is_native(spark):
    docs, labels = labelled(spark)
    plan = quality.judge(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or ("", ""), (rule, verdict), key=lambda x: (len(x[0].partition("/")[0]), len(x[0])))
    return host, path, best[0] if best else None, best[1] if best else "allow"


URLS = [
    None, "", "no scheme com/en/", "http://com/en/x", "https://a.b.example.com/en/7?x#y", "http://EXAMPLE.com/en/8", "http://example.com-x.org/es/", "http://xexample.com/en/71", "http://net/de/",
    "http://www.example.net/de/81", "http://example.net?/de/8", "http://example.net#/de/8", "ftp://x.org/es/://y", "http:///en/", "http://com./en/", "://com/en/", "http://com/en", "http://m.example.com/en/7", "http://İ.com/en/",
]


@pytest.mark.parametrize("rules", [URL_RULES, [], [("block", "com/"), ("allow", "b.com/"), ("block", "a.b.com/x/"), ("block", "a.b.com/x/y"), ("allow", "example.com/en/")]])
def test_urls(spark, rules):
    urls = [*URLS, *[f"http://{h}/x/y{k}" for k, h in enumerate(["com", "b.com", "a.b.com", "c.a.b.com", "ab.com"])], *["http://hot.example.com/en/1"] * 40]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnRenamed("url", "u").selectExpr("page_id", "u", "'x' host", "1 path", "'k' key")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, url_filters.rules_frame(spark, rules), url_col="u").collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}


def test_url_query_has_the_rules_of_its_contract(spark, tmp_path):
    contract = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    urls = [*URLS, "http://net/de/8", "http://www.net/de/x", "http://example.net/de/7", "http://example.net/de/8", "http://org/es/", "http://org/de/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op3_url_filters(spark, str(tmp_path)).collect()}
    assert got == {i: brute_verdict(u, contract) for i, u in enumerate(urls)}


def test_no_urls(spark):
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string"), url_filters.rules_frame(spark, URL_RULES)).count() == 0


CHAT = [
    (1, 0, "user", "Shall we meet on Friday at noon?\n\nBring the long report, please."),
    (1, 1, "assistant", "> Shall we meet   on Friday at NOON?\n\nYes, noon suits me well."),
    (1, 2, "user", ">> Shall we meet on Friday at noon?\n> Yes, noon suits me well.\nThen it is settled for Friday."),
    (1, 3, "assistant", "> Bring the long report, please.\nI shall print the report."),
    (1, 4, "user", "> nobody ever said this at all\nA stray remark of mine."),
    (1, 5, "user", None),
    (2, 0, "user", "> Shall we meet on Friday at noon?"),
    (None, 0, "user", "> lost message text"),
    (3, None, "user", "text without a turn"),
]


def test_quotes(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' level", "1 own", "2 row")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    assert len(got) == len(CHAT)
    assert {k: r.reply_to for k, r in got.items() if r.reply_to is not None} == {(1, 1): 0, (1, 2): 1, (1, 3): 0}
    assert [got[1, t].depth for t in range(6)] == [0, 1, 2, 1, 0, 0]
    assert [got[1, t].thread for t in range(6)] == [0, 0, 0, 0, 4, 5]
    assert [got[1, t].n_quotes for t in range(6)] == [0, 1, 2, 1, 1, 0]
    assert [got[1, t].n_linked for t in range(6)] == [0, 1, 2, 1, 0, 0]
    assert got[1, 1].body == "Yes, noon suits me well."
    order = [t for _, t in sorted((got[1, t].position, t) for t in range(6))]
    assert order == [0, 1, 3, 2, 4, 5]
    assert got[2, 0].body == ""
    assert got[2, 0].n_linked == 0
    clean = [r.body for r in quotes.conversations_without_quotes(df).where("conv_id = 1").orderBy("position").collect()]
    assert not any(x.startswith(">") for x in clean)
    assert len(clean) == 5


def linked(spark, *texts):
    """reply_to of each message of one conversation."""
    df = spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    return [r.reply_to for r in quotes.link_quotes(df).orderBy("turn").collect()]


def test_short_quotes(spark):
    assert linked(spark, "Thanks!", "Is it 42?\n42", "> 42\nGood.", "> thanks!\nNever mind.", "好的", "> 好的\n是", ">\nEmpty", "> No\nNobody said so.") == [None, None, 1, 0, None, 4, None, None]


def test_excerpts_of_lines_and_paragraphs(spark):
    long = "one fine line\nanother line\na third line\nthe last line\n\nA second\nparagraph here\n\nA third paragraph"
    parts = ["> another line\n> a third line\nYes.", "> A second paragraph\n> here\n>\n> A third paragraph\nNo.", "> a third line\n> another line\nNobody wrote it so."]
    assert linked(spark, "another line", "a third line", long, *parts) == [None, None, None, 2, 2, None]


MARKS = re.compile(r"((?:[ \t]*>)+)[ \t]?")


def plain(text):
    out = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in out)


def pairs_of(items):
    items = [x for x in map(plain, items) if x]
    return set(zip(items, items[1:], strict=False))


def brute_links(rows):
    """(conv, turn, role, body, n_quotes, n_linked, reply_to, depth, thread) of each row, by looking at every earlier message."""
    seen = []
    for conv, turn, role, text in rows:
        lines = (text or "").split("\n")
        body = "\n".join(x for x in lines if not MARKS.match(x)).strip(" \t\n\x0b\x0c\r")
        found, last = [], None
        for at, line in enumerate(lines):
            mark = MARKS.match(line)
            if mark:
                level, rest = mark[1].count(">"), line[mark.end() :]
                if last == (at - 1, level):
                    found[-1][1].append(rest)
                else:
                    found.append((level, [rest]))
                last = (at, level)
        seen.append((conv, turn, role, body, [(n, "\n".join(x)) for n, x in found]))
    units, held = defaultdict(set), defaultdict(set)
    for conv, turn, _, body, _ in seen:
        if conv is not None and turn is not None:
            paragraphs = re.split(r"\n[ \t]*\n", body)
            units[conv, turn] |= {plain(u) for u in (body, *paragraphs, *body.split("\n"))} - {""}
            held[conv, turn] |= pairs_of(body.split("\n")) | pairs_of(paragraphs)
    turns = defaultdict(list)
    for conv, turn in units:
        turns[conv].append(turn)

    def whole(conv, wanted):
        """First turn of which one row alone need not hold all: rows that share a turn count together."""
        return min((t for t in turns[conv] if wanted(units[conv, t], held[conv, t])), default=None)

    out, reply = [], {}
    for conv, turn, _, _, found in seen:
        originals = []
        for level, text in found if conv is not None and turn is not None else ():
            first = whole(conv, lambda u, h: plain(text) in u) if plain(text) else None  # noqa: B023
            if first is None or first >= turn:
                kinds = [pairs_of(text.split("\n")), pairs_of(re.split(r"\n[ \t]*\n", text))]
                parts = [whole(conv, lambda u, h: k <= h) for k in kinds if k]  # noqa: B023
                first = min((t for t in parts if t is not None), default=None)
            originals.append((level, first if first is not None and first < turn else None))
        outer = min((n for n, _ in originals), default=None)
        own = max((t for n, t in originals if n == outer and t is not None), default=None)
        if own is None:
            own = max((t for _, t in originals if t is not None), default=None)
        out.append((len(originals), sum(t is not None for _, t in originals), own))
        if own is not None:
            reply[conv, turn] = max(own, reply.get((conv, turn), own))
    rows = []
    for (conv, turn, role, body, _), (quotes_, linked_, own) in zip(seen, out, strict=True):
        depth, at = 0, turn
        while (conv, at) in reply:
            depth, at = depth + 1, reply[conv, at]
        rows.append((conv, turn, role, body, quotes_, linked_, own, depth, at))
    return rows


def talk(seed):
    """Conversations that quote whole messages, lines, paragraphs and excerpts at several levels, with repeated lines, rows and turns, and nulls."""
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice(["yes", "No", "the", "plan", "on", "Friday", "a", "long", "report", "好的"]) for _ in range(rng.randint(1, 5)))
    rows = []
    for conv in (1, 2, 3, None):
        said = []
        for turn in range(14):
            parts = []
            for _ in range(rng.randint(0, 2)):
                if said:
                    lines = rng.choice(said).split("\n")
                    a = rng.randrange(len(lines))
                    mark = rng.choice(["> ", ">", ">> ", " > > "])
                    parts += [mark + x for x in lines[a : a + rng.randint(1, 4)]] + [""] * rng.randint(0, 1)
            parts += [rng.choice(["", say(), say(), say() + "  " + say()]) for _ in range(rng.randint(0, 4))]
            text = "\n".join(parts)
            said.append(text)
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant"]), None if rng.random() < 0.05 else text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
            if rng.random() < 0.1:
                rows.append((conv, turn, "user", say()))
    rows += [(4, t, "user", ("> " + f"message {t - 1}\n" if t else "") + f"message {t}") for t in range(40)]  # one long thread
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotes_are_those_of_a_search_through_all_messages(spark, seed):
    rows = talk(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' level", "1 row", "2 _h", "3 _r").repartition(5)
    got = quotes.link_quotes(df).collect()
    fields = ["conv_id", "turn", "role", "body", "n_quotes", "n_linked", "reply_to", "depth", "thread"]
    assert Counter(tuple(r[f] for f in fields) for r in got) == Counter(brute_links(rows))
    by_conv = defaultdict(list)
    for r in got:
        by_conv[r.conv_id].append((r.position, *((x is not None, x or 0) for x in (r.thread, r.depth, r.turn))))
    for parts in by_conv.values():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert [p[1:] for p in parts] == sorted(p[1:] for p in parts)
    assert sum(r.n_linked for r in got) > 40


def test_long_messages_are_read_whole(spark):
    long = "\n".join(f"line {k} of a message of two megabytes or so, with some words to fill it" for k in range(30_000))
    quote = "\n".join("> " + x for x in long.split("\n")[-3:])
    assert linked(spark, long, quote + "\nI agree.", "> line 7 of a message of two megabytes or so, with some words to fill it") == [None, 0, 0]


def test_no_conversations(spark):
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
