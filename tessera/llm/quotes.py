"""Chat formatting by quotation linking, with DataFrame functions only.

A message's lines carry quote levels (the leading `>` marks). Runs of quoted lines of one level are passages. A
passage's normalised text (quote marks gone, white space collapsed, A-Z lower-cased) is hashed and
looked up among the normalised own texts of the conversation: whole messages, their paragraphs and
their lines. The first message with that text, if it is earlier, is the original. A passage of several
lines or paragraphs that is no such unit is an excerpt: its original is the first message, if it is earlier, that
holds all its pairs of successive lines (blank ones left out), or of successive paragraphs. A message replies to the
latest original of its outermost passages; replies then order the conversation: every thread by its
first message, and in a thread each reply after what it replies to, by depth and turn.

Originals are reduced to their first turn for each (conversation, hash) before the join, so that a line
which a third of all messages hold is one row there; no conversation is collected into one task.

Defined results: null text is empty; a message without quotes starts its own thread; a passage that no
earlier message holds is unlinked and just left out of the body; a null conversation or turn is linked with
nothing; of rows that share (conversation, turn), each is given out (placed by a hash of role and body), and either may be
the original; texts of any length are read whole, quotes of any length are looked up; an
empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

_MARKS = r"^((?:[ \t]*>)+)[ \t]?"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _own_text(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(_MARKS))), "\n")


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, passage, text): quoted passages, numbered in each message. messages: conv, turn, lines."""
    quoted = messages.where(F.exists("lines", lambda x: F.regexp_like(x, F.lit(_MARKS))))
    rows = quoted.select("row", "conv", "turn", F.posexplode("lines").alias("pos", "line")).withColumn("level", _level(F.col("line"))).where("level > 0")
    in_message = Window.partitionBy("row").orderBy("pos")
    breaks = (F.lag("pos").over(in_message) == F.col("pos") - 1) & (F.lag("level").over(in_message) == F.col("level"))
    marked = rows.withColumn("_new", F.when(breaks, 0).otherwise(1)).withColumn("passage", F.sum("_new").over(in_message))
    grouped = marked.groupBy("row", "conv", "turn", "level", "passage").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("line", _MARKS, "").alias("line")))).alias("_l")  # one message's lines
    )
    return grouped.select("row", "conv", "turn", "level", "passage", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def _hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def originals(messages: DataFrame) -> DataFrame:
    """(conv, hash, first): first turn whose own text, or a paragraph or line of it, is that text."""
    paragraphs = F.split("own", r"\n[ \t]*\n", -1)
    units = F.array_distinct(F.transform(F.concat(F.array("own"), paragraphs, F.split("own", "\n", -1)), normalised))
    rows = messages.where("conv is not null and turn is not null").select("conv", "turn", F.explode(F.filter(units, lambda x: F.length(x) > 0)).alias("unit"))
    return rows.select("conv", "turn", _hashed(F.col("unit")).alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("first"))


def _pairs(items: Column) -> Column:
    """Hashes of the distinct pairs of successive items."""
    items = F.filter(F.transform(items, normalised), lambda x: x != "")
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(items, 1, n), F.slice(items, 2, n), lambda x, y: _hashed(F.concat(x, F.lit("\n"), y))))


def excerpts(passages: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv, hash, first): first turn whose own text holds all pairs of lines, or of paragraphs, of a passage.

    Equal passages of a conversation count once. Only the messages that hold a passage's rarest pair are looked at for its others.
    passages: conv, hash, text; messages: conv, turn, own."""
    kinds = lambda text: (F.split(text, "\n", -1), F.split(text, r"\n[ \t]*\n", -1))
    each = passages.select("conv", "hash", F.posexplode(F.array(*map(_pairs, kinds(F.col("text"))))).alias("kind", "pairs"))
    wanted = materialize(each.select("conv", "hash", "kind", F.size("pairs").alias("n"), F.explode("pairs").alias("pair")).distinct(), "excerpts")
    known = messages.where("turn is not null").join(wanted.select("conv").distinct(), "conv", "left_semi")
    held = known.select("conv", "turn", F.explode(F.array_distinct(F.concat(*map(_pairs, kinds(F.col("own")))))).alias("pair"))
    held = materialize(held.join(wanted.select("conv", "pair").distinct(), ["conv", "pair"], "left_semi").distinct(), "pairs")
    holders = held.groupBy("conv", "pair").agg(F.count(F.lit(1)).alias("holders"))
    excerpt = ["conv", "hash", "kind", "n"]
    rarest = wanted.join(holders, ["conv", "pair"]).groupBy(*excerpt).agg(F.min(F.struct("holders", "pair")).alias("_r"), F.count(F.lit(1)).alias("_n"))
    rarest = rarest.where("_n = n").select(*excerpt, F.col("_r.pair").alias("pair"))
    maybe = rarest.join(held, ["conv", "pair"]).select(*excerpt, "turn")
    full = maybe.join(wanted, excerpt).join(held, ["conv", "turn", "pair"]).groupBy(*excerpt, "turn").agg(F.count(F.lit(1)).alias("_n")).where("_n = n")
    return full.groupBy("conv", "hash").agg(F.min("turn").alias("first"))


def _roots(replies: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of messages that reply to one, by pointer doubling."""
    at = materialize(replies.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        up = at.select("conv", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        joined = at.join(up, ["conv", "root"], "left")
        at = materialize(
            joined.select("conv", "turn", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("moved")),
            "threads",
        )
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def link_quotes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, body (own text, quotes left out), n_quotes, n_linked, reply_to
    (turn or null), depth, thread (turn of the first message) and position (0.. in reply order)."""
    messages = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.split(text_of(text_col), "\n", -1).alias("lines")
    ).withColumn("own", F.regexp_replace(_own_text(F.col("lines")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    messages = messages.withColumn("row", F.xxhash64("conv", "turn", "role", F.array_join("lines", "\n")))
    found = passages(messages.where("conv is not null and turn is not null").dropDuplicates(["conv", "turn", "row"]))
    known = found.withColumn("hash", _hashed(normalised(F.col("text"))))
    linked = known.join(originals(messages), ["conv", "hash"], "left").withColumn("first", F.when(F.col("first") < F.col("turn"), F.col("first")))
    linked = materialize(linked.withColumn("hash", _hashed(F.col("text"))), "passages")  # by its lines as they are
    parts = excerpts(linked.where("first is null").select("conv", "hash", "text").distinct(), messages).withColumnRenamed("first", "_part")
    linked = linked.join(parts, ["conv", "hash"], "left").withColumn("first", F.coalesce("first", F.when(F.col("_part") < F.col("turn"), F.col("_part"))))
    outer = Window.partitionBy("conv", "turn", "row")
    by_message = (
        linked.withColumn("_outer", F.min("level").over(outer))
        .groupBy("conv", "turn", "row")
        .agg(
            F.count(F.lit(1)).alias("n_quotes"),
            F.count("first").alias("n_linked"),
            F.coalesce(F.max(F.when(F.col("level") == F.col("_outer"), F.col("first"))), F.max("first")).alias("reply_to"),
        )
    )
    by_message = materialize(by_message, "quotes")
    replies = by_message.where("reply_to is not null").groupBy("conv", "turn").agg(F.max("reply_to").alias("reply_to"))
    roots = _roots(replies)
    out = messages.join(by_message, ["conv", "turn", "row"], "left").join(roots, ["conv", "turn"], "left")
    placed = out.select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("own").alias("body"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to",
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("root", "turn").alias("thread"),
    )
    return _positions(placed)


def _positions(placed: DataFrame) -> DataFrame:
    """Adds the 0-based place in (thread, depth, turn) order: rank within a range of all rows, plus the conversation's rows in the ranges before."""
    keyed = placed.withColumns({"_h": F.xxhash64("role", "body"), "_u": F.monotonically_increasing_id()})
    order = ["thread", "depth", "turn", "_h", "_u"]
    # fixes the ranges, which may part one conversation
    ranged = materialize(keyed.repartitionByRange("conv_id", *order).withColumn("_r", F.spark_partition_id()), "positions")
    before = Window.partitionBy("conv_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = ranged.groupBy("conv_id", "_r").count()
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("_r").alias("_t"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_r", "conv_id").orderBy(*order)
    ranked = ranged.withColumn("_own", F.row_number().over(own) - 1)
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_r") == F.col("_t"))
    return ranked.join(sizes, same).withColumn("position", F.col("_own") + F.col("_before")).select(*placed.columns, "position")


def conversations_without_quotes(conversations: DataFrame, **columns: str) -> DataFrame:
    """The bodies in reply order, one row per message, empty bodies left out: conv_id, position, role, body."""
    return link_quotes(conversations, **columns).where("body != ''").select("conv_id", "position", "role", "body")
