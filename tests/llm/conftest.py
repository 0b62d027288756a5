import random

import pytest

#: extra columns whose names operators use inside
INSIDE = ["key", "shard", "row", "id", "digest", "spans", "kept_id", "null", "_id", "__i", "__n", "__d", "__row", "__id", "__text", "__spans", "_row", "_c", "size", "kind", "start", "length"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in INSIDE)


def made(spark, rows):
    """Documents with extra columns, each of them holding a text of its row."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *[f"{n} of {i}" for n in INSIDE]) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, repeated lines, odd characters, nulls and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioustnrlé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = text(40), text(6)
    rows = [(i, "\n".join(text(rng.randint(5, 25)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)]
    for i in range(20):
        near = rows[10 + i % 5][1].split(" ")
        near[rng.randrange(len(near))] = "changed"
        rows.append((200 + i, " ".join(near)))
    rows += [(300 + i, f"{text(10)} {passage} {text(12)}\n{line}\n{text(4)}") for i in range(15)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "One"), (405, "a b"), (406, "日本語 😀 Σ\x00 x" * 30), (407, "日本語 😀 Σ\x00 x" * 30), (None, "no id " * 20), (None, None)]
    rows += [(12, rows[12][1]), (13, "another text of a repeated id " + text(30)), (408, "ab" * 300), (409, "\n".join(["same line of text here"] * 5)), (410, "word " * 3000)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return made(spark, corpus).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return made(spark, [])
