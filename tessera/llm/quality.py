"""Quality rules: learned decision lists over text statistics, with DataFrame functions only.

Statistics of every whole text are one native expression. From those of labelled documents a
decision list is learned by sequential covering: rules, conjunctions of thresholds on ratios, are
grown on two thirds of the sample by information gain, pruned on the other third, and accepted only
while they are precise enough there. The list becomes one ordered conditional expression
(`when(rule 1, 'reject') ... otherwise('keep')`) inside Spark's own plan.

The labelled sample is bounded by `max_labelled` documents (default 20,000, chosen by a hash of the id, so that
the same table gives the same sample; of rows that share an id the least text stands for all); only their statistics, a few
numbers each, reach the driver.

Defined results: null text has no words and fails the base rules; documents without a label are
judged like all others; conflicting labels of one id count as bad; without labels of both kinds the
list is empty, and only the base rules reject. Rows that repeat are judged one by one; texts of any length are read whole; an
empty table gives an empty table. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

_WS = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_capitals", "n_marks"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds value to a lambda variable, so that it is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more."""
    window = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(ordered: Column) -> Column:
        n = F.size(ordered)
        twin = F.filter(
            ordered,
            lambda e, j: ((j > 0) & (F.get(ordered, j - 1)["h"] == e["h"])) | ((j < n - 1) & (F.get(ordered, j + 1)["h"] == e["h"])),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twin, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, covered))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(window, counted))


def _counts(text: Column) -> Column:
    """One struct of all counts of a text."""
    without = lambda chars: (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))).cast("long")
    words = F.filter(F.split(text, _WS, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, _WS, "")) > 0)
    by_word = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    repeated = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return F.struct(by_word.alias("w"), repeated.alias("n_dup_lines"), without("#*$%&|<>").alias("n_symbols"), without("A-Z").alias("n_capitals"), without("!?").alias("n_marks"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts BASE + EXTRA of each row's whole text."""
    counted = docs.select(F.col(id_col).alias("doc_id"), _counts(text_of(text_col)).alias("_c"))
    return counted.select("doc_id", "_c.w.n_words", "_c.w.word_chars", "_c.n_symbols", "_c.n_dup_lines", "_c.w.n_repeat_words", "_c.n_capitals", "_c.n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: ratios in thousandths that rules may test: name, numerator, denominator
RATIOS = [
    ("symbols", "n_symbols", "word_chars"),
    ("repeats", "n_repeat_words", "n_words"),
    ("dup_lines", "n_dup_lines", "n_words"),
    ("capitals", "n_capitals", "word_chars"),
    ("marks", "n_marks", "word_chars"),
    ("word_length", "word_chars", "n_words"),
    ("words", "n_words", None),
]


def _ratio(name: str) -> Column:
    _, top, bottom = next(r for r in RATIOS if r[0] == name)
    return F.floor(1000 * F.col(top) / F.greatest(F.col(bottom), F.lit(1))) if bottom else F.col(top)


@dataclass(frozen=True)
class Test:
    ratio: str
    above: bool
    threshold: int

    def column(self) -> Column:
        return _ratio(self.ratio) >= self.threshold if self.above else _ratio(self.ratio) < self.threshold


Rule = tuple[Test, ...]


def _cover(rule: Sequence[Test], masks: dict[Test, int], start: int) -> int:
    for test in rule:
        start &= masks[test]
    return start


def _gain(bad0: int, all0: int, bad1: int, all1: int) -> float:
    return bad1 * (log2(bad1 / all1) - log2(bad0 / all0)) if bad1 else float("-inf")


def learn_rules(rows: list[dict], cuts: int = 24, precision: float = 0.99, least: int = 4, most_tests: int = 4, most_rules: int = 16) -> list[Rule]:
    """Sequential covering. rows: statistics, `bad` (True: reject) and `grow` (False: held for pruning)."""
    names = [r[0] for r in RATIOS]
    values = {}
    for name, top, bottom in RATIOS:
        values[name] = [1000 * r[top] // max(r[bottom], 1) if bottom else r[top] for r in rows]
    masks: dict[Test, int] = {}  # rows that pass, as bits
    for name in names:
        # quantiles of all rows, of the values that occur, and of those of bad rows: a ratio may be 0 nearly everywhere
        places = set()
        for seen in (sorted(values[name]), sorted(set(values[name])), sorted(v for v, r in zip(values[name], rows, strict=True) if r["bad"])):
            places |= {seen[len(seen) * k // cuts] for k in range(cuts)} if seen else set()
        for threshold in sorted(places):
            above = int("".join("1" if v >= threshold else "0" for v in reversed(values[name])), 2)
            masks[Test(name, True, threshold)] = above
            masks[Test(name, False, threshold)] = ((1 << len(rows)) - 1) & ~above
    bits = lambda key: int("".join("1" if r[key] else "0" for r in reversed(rows)) or "0", 2)
    bad, grow = bits("bad"), bits("grow")
    prune = ((1 << len(rows)) - 1) & ~grow
    left, found = (1 << len(rows)) - 1, []
    while len(found) < most_rules:
        here, rule = left & grow, []
        while len(rule) < most_tests and (here & ~bad):
            b0, n0 = (here & bad).bit_count(), here.bit_count()
            if b0 < least:
                break
            best = max(masks, key=lambda t: _gain(b0, n0, (here & masks[t] & bad).bit_count(), (here & masks[t]).bit_count()))  # noqa: B023
            if _gain(b0, n0, (here & masks[best] & bad).bit_count(), (here & masks[best]).bit_count()) <= 0:
                break
            rule.append(best)
            here &= masks[best]
        if not rule:
            break

        def worth(r: Sequence[Test]) -> float:
            covered = _cover(r, masks, left & prune)  # noqa: B023
            b = (covered & bad).bit_count()
            return (2 * b - covered.bit_count()) / covered.bit_count() if covered else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        held, grown = _cover(rule, masks, left & prune), _cover(rule, masks, left & grow)
        exact = lambda m: (m & bad).bit_count() / m.bit_count() if m else 0.0
        if (grown & bad).bit_count() < least or exact(grown) < precision or exact(held) < precision:
            break
        found.append(tuple(rule))
        left &= ~_cover(rule, masks, left)
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int) -> list[dict]:
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows
    # an id that is there several times counts once, by its least text: the bound holds for rows too
    once = known.groupBy("doc_id").agg(F.min(text_of("text")).alias("text"))
    sample = statistics(once).join(F.broadcast(chosen), "doc_id").collect()
    rows = [r.asDict() | {"bad": r["quality"] == 0, "grow": r["doc_id"] % 3 != 0} for r in sorted(sample, key=lambda r: r["doc_id"])]
    return [r for r in rows if r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]]  # the list judges what the base rules pass


def reject(rules: Sequence[Rule]) -> Column:
    """The decision list as one ordered conditional: the number of the rule that rejects, else null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        test = rule[0].column()
        for more in rule[1:]:
            test = test & more.column()
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, BASE statistics, base_failed, kept, rule (which one rejects, else null)."""
    rules = learn_rules(labelled_sample(docs, labels, id_col, text_col, max_labelled))
    judged = statistics(docs, id_col, text_col).withColumns({"base_failed": base_failed(), "rule": reject(rules)})
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, that neither the base rules nor the learned list rejects."""
    rules = learn_rules(labelled_sample(docs, labels, id_col, text_col, max_labelled))
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _counts(text_of(text_col)).alias("_c"))
    flat = counted.select("_row", "_c.w.n_words", "_c.w.word_chars", "_c.n_symbols", "_c.n_dup_lines", "_c.w.n_repeat_words", "_c.n_capitals", "_c.n_marks")
    kept = ~base_failed() & reject(rules).isNull()
    # a generator instead of a filter: a filter would be pushed down and count each text several times
    return flat.select("_row", F.explode(F.when(kept, F.array(F.lit(1))))).select("_row.*")
