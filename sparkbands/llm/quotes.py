"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` marks before its text; blank lines
are left out.  Lines of one level that follow one another are a passage, those
of level 0 a message's own.  Passages are normalised (A-Z lower-cased, white
space single) and hashed whole by two 64-bit hashes; what messages wrote
themselves is hashed in the same way, in every run of own lines that begins with
the first line of some quoted passage and is as long.  A quoted passage is
joined to the earliest message that wrote it: in the same conversation before
the quoting turn if there is one, else in the smallest other conversation.  A
passage of several lines that no message wrote as a whole is joined line by line
to messages of its own conversation.

A message replies to the message of its least deep linked quote (one of its own
conversation before others, then the last one written), else to the turn before
it.  ``position`` numbers a conversation in reply order: a message comes right
after the one that it replies to and that one's earlier answers with all below
them; messages that reply to another conversation begin trees of their own.  A
run of turns that each reply to the one before moves as a whole, so only runs,
as many as there are replies to elsewhere, are numbered by doubling jumps along
the tour of the tree: a conversation of any length and depth takes a logarithm
of its runs in joins, and a row holds no path.

Null and empty texts are empty messages.  A row without conv_id or turn is kept,
links with nothing and has no position.  Repeated rows of a turn are one message,
with the smallest text that is not null.  A very long text is one row of lines.
An empty table gives no rows.  Columns other than conv_id, turn, role and text
are ignored.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

_MARKS = r"^((?:[ \t]*>)*)"
_RUN = 1024
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(line: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), _UPPER, _UPPER.lower())


def split_lines(text: Column) -> Column:
    """Array of (level, body) of the lines of a text that are not blank, bodies normalised."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("level"), normalised(F.regexp_replace(x, _MARKS, "")).alias("body")))
    return F.filter(lines, lambda x: x["body"] != "")


def two_hashes(passage: Column) -> tuple[Column, Column]:
    return F.xxhash64(passage).alias("h"), F.xxhash64(F.lit(1), passage).alias("h2")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, lines) of every quoted passage; lines in order."""
    rows = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>")).withColumn("l", split_lines(F.col("text")))
    # a passage begins where the level differs from the line before
    starts = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: (i == 1) | (F.get("l", i - 1)["level"] != F.get("l", i - 2)["level"]))
    rows = rows.where(F.size("l") > 0).withColumn("s", starts)
    ends = F.transform("s", lambda a, k: F.coalesce(F.get("s", k + 1), F.size("l") + 1))
    rows = rows.select("conv_id", "turn", "l", F.posexplode(F.arrays_zip(F.col("s").alias("a"), ends.alias("b"))).alias("passage", "at"))
    rows = rows.select("conv_id", "turn", "passage", F.slice("l", F.col("at.a"), F.col("at.b") - F.col("at.a")).alias("l"))
    return rows.where(F.get("l", F.lit(0))["level"] > 0).select("conv_id", "turn", "passage", F.get("l", F.lit(0))["level"].alias("level"), F.col("l.body").alias("lines"))


def own_runs(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, h2, conv_id, turn) of the runs of own lines that begin and last like a wanted one (first, n)."""
    lengths = wanted.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    own = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    own = own.select("conv_id", "turn", F.filter(split_lines(F.col("text")), lambda x: x["level"] == 0)["body"].alias("own"))
    begins = own.select("conv_id", "turn", F.posexplode("own").alias("i", "line")).select("conv_id", "turn", "i", F.xxhash64("line").alias("first"))
    begins = begins.join(lengths, "first").groupBy("conv_id", "turn").agg(F.collect_list(F.struct("i", "lengths")).alias("begins"))
    rows = own.join(begins, ["conv_id", "turn"])
    runs = F.flatten(F.transform("begins", lambda b: F.transform(b["lengths"], lambda n: F.struct(b["i"].alias("i"), n.alias("n")))))
    runs = F.filter(runs, lambda r: r["i"] + r["n"] <= F.size("own"))
    text = F.transform(runs, lambda r: F.array_join(F.slice("own", r["i"] + 1, r["n"]), "\n"))
    return rows.select("conv_id", "turn", F.explode(text).alias("run")).select("conv_id", "turn", *two_hashes(F.col("run")))


def joined_to_originals(quoted: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds (to_conv, to_turn) to rows with (h, h2, conv_id, turn): the earliest message that wrote it."""
    near = written(runs.groupBy("h", "h2", "conv_id").agg(F.min("turn").alias("first")), "own-runs")
    # the two smallest conversations of each run, so that one is left where the other is the quoting one
    here, sort = F.struct("conv_id", "first"), W.partitionBy("h", "h2").orderBy("conv_id")
    two = near.withColumn("place", F.row_number().over(sort)).where("place <= 2")
    two = two.groupBy("h", "h2").agg(F.min(F.when(F.col("place") == 1, here)).alias("one"), F.min(F.when(F.col("place") == 2, here)).alias("two"))
    found = quoted.join(near.withColumnRenamed("first", "here"), ["h", "h2", "conv_id"], "left").join(two, ["h", "h2"], "left")
    inside = F.col("here") < F.col("turn")
    other = F.when(F.col("one.conv_id").eqNullSafe(F.col("conv_id")), F.col("two")).otherwise(F.col("one"))
    found = found.withColumn("other", other).withColumns({"to_conv": F.when(inside, F.col("conv_id")).otherwise(F.col("other.conv_id")), "to_turn": F.when(inside, F.col("here")).otherwise(F.col("other.first"))})
    return found.drop("here", "one", "two", "other")


def _numbered(messages: DataFrame) -> DataFrame:
    """Adds ``o``, a message's number in its conversation, and ``before``, the turn before it; a long conversation is worked on in runs of turns."""
    rows = messages.withColumn("run", F.floor(F.col("turn") / _RUN))
    runs = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).groupBy("conv_id", "run").agg(F.max("turn").alias("end"), F.count("*").alias("n"))
    by = W.partitionBy("conv_id").orderBy("run")
    runs = runs.select("conv_id", "run", F.lag("end").over(by).alias("end"), (F.sum("n").over(by) - F.col("n")).alias("base"))
    inner = W.partitionBy("conv_id", "run").orderBy("turn")
    rows = rows.withColumns({"before": F.lag("turn").over(inner), "o": F.row_number().over(inner) - 1}).join(runs, ["conv_id", "run"], "left")
    known = F.col("base").isNotNull()
    return rows.withColumns({"before": F.when(known, F.coalesce("before", "end")), "o": F.when(known, F.col("o") + F.col("base"))}).drop("run", "end", "base")


def linked(conversations: DataFrame) -> DataFrame:
    """One row per message: its number, its quotes, the message it replies to, and its text without quotes."""
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    messages = conversations.where(placed).groupBy("conv_id", "turn").agg(F.min(F.struct(F.col("text").isNull().alias("none"), "text", "role")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    lone = conversations.where(~placed).select("conv_id", "turn", "role", "text")  # each a message of its own
    quoted = written(passages(messages), "passages")
    whole = quoted.select("conv_id", "turn", "passage", "level", "lines", *two_hashes(F.array_join("lines", "\n")))
    wanted = quoted.select(F.xxhash64(F.get("lines", F.lit(0))).alias("first"), F.size("lines").alias("n"))
    single = quoted.where(F.size("lines") > 1).select(F.explode("lines").alias("line")).select(F.xxhash64("line").alias("first"), F.lit(1).alias("n"))
    runs = own_runs(messages, wanted.unionByName(single).distinct())
    whole = written(joined_to_originals(whole, written(runs, "runs")), "whole")
    parts = whole.where(F.col("to_turn").isNull() & (F.size("lines") > 1)).select("conv_id", "turn", "level", F.explode("lines").alias("line"))
    parts = joined_to_originals(parts.select("conv_id", "turn", "level", *two_hashes(F.col("line"))), runs).where(F.col("to_conv").eqNullSafe(F.col("conv_id")))
    units = whole.select("conv_id", "turn", "level", F.size("lines").alias("n"), F.when(F.col("to_turn").isNotNull(), F.size("lines")).otherwise(0).alias("hit"), "to_conv", "to_turn")
    units = units.unionByName(parts.select("conv_id", "turn", "level", F.lit(0).alias("n"), F.lit(1).alias("hit"), "to_conv", "to_turn"))
    links = units.groupBy("conv_id", "turn").agg(
        F.sum("n").alias("n_quoted"),
        F.sum("hit").alias("n_linked"),
        F.max("level").alias("depth"),
        F.max(F.when(F.col("to_turn").isNotNull(), F.struct(-F.col("level"), (F.col("to_conv") == F.col("conv_id")).alias("same"), "to_turn", "to_conv"))).alias("best"),
    )
    out = _numbered(messages).join(links, ["conv_id", "turn"], "left").unionByName(lone, allowMissingColumns=True)
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^[ \t]*>.*(?:\r?\n|$)", "")
    return out.select(
        "conv_id",
        "turn",
        "o",
        "role",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quoted", "n_linked", "depth")),
        F.coalesce("best.to_conv", F.when(F.col("before").isNotNull(), F.col("conv_id"))).alias("reply_conv"),
        F.coalesce("best.to_turn", "before").alias("reply_turn"),
        ((F.col("o") == 0) | (F.col("best.to_turn").isNotNull() & ~(F.col("best.to_conv").eqNullSafe(F.col("conv_id")) & F.col("best.to_turn").eqNullSafe(F.col("before"))))).alias("head"),
        F.trim(plain).alias("plain"),
    )


def threads(messages: DataFrame) -> DataFrame:
    """Rows of linked() with ``position``, a conversation's reply order from 0, sorted by it."""
    every = written(messages, "messages")
    rows, lone = every.where("o is not null"), every.where("o is null")
    # runs of turns that each reply to the one before: head is the number of the first
    rows = rows.withColumns({"run": F.floor(F.col("o") / _RUN), "h": F.when(F.col("head"), F.col("o"))})
    carried = rows.groupBy("conv_id", "run").agg(F.max("h").alias("top"))
    carried = carried.select("conv_id", "run", F.max("top").over(W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    inside = W.partitionBy("conv_id", "run").orderBy("o").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("at", F.max("h").over(inside)).join(carried, ["conv_id", "run"], "left")
    rows = rows.withColumn("seg", F.coalesce("at", "carry")).drop("run", "h", "at", "carry")
    rows = written(rows, "runs-of-turns")
    segs = rows.where("seg is not null").groupBy("conv_id", "seg").agg(F.count("*").alias("n"))
    heads = rows.where("seg = o").select("conv_id", "seg", F.when(F.col("reply_conv") == F.col("conv_id"), F.col("reply_turn")).alias("up_turn"))
    above = rows.select("conv_id", F.col("turn").alias("up_turn"), F.col("o").alias("up_o"), F.col("seg").alias("up"))
    # -1 is the root of a conversation, above all trees
    segs = segs.join(heads, ["conv_id", "seg"]).join(above, ["conv_id", "up_turn"], "left")
    segs = written(segs.select("conv_id", "seg", "n", F.coalesce("up", F.lit(-1)).alias("up"), F.coalesce("up_o", F.lit(-1)).alias("up_o")), "segments")
    many = segs.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").select("conv_id")
    placed = _tour(segs.join(many, "conv_id", "left_semi"))
    out = rows.join(placed, ["conv_id", "seg"], "left")
    out = out.withColumn("position", F.when(F.col("seg").isNotNull(), F.coalesce("begin", F.lit(0)) + F.col("o") - F.col("seg")))
    out = out.drop("o", "head", "seg", "begin").unionByName(lone.drop("o", "head"), allowMissingColumns=True)
    return out.orderBy("conv_id", "position", "turn")


def _tour(segs: DataFrame) -> DataFrame:
    """(conv_id, seg, begin): the messages that come before each run in the tour of its conversation's tree.

    Every run is entered and left once; answers to a later message of a run come
    first, as they are nearer to its end, and answers to one message by turn.
    """
    order = W.partitionBy("conv_id", "up").orderBy(F.desc("up_o"), "seg")
    rows = written(segs.withColumns({"next": F.lead("seg").over(order), "place": F.row_number().over(order)}), "siblings")
    first = rows.where("place = 1").select("conv_id", F.col("up").alias("seg"), F.col("seg").alias("child"))
    rows = rows.join(first, ["conv_id", "seg"], "left")
    # a step is 2 * seg on the way in and 2 * seg + 1 on the way out; no step after it: -1
    go_in = rows.select("conv_id", (F.col("seg") * 2).alias("step"), F.coalesce(F.col("child") * 2, F.col("seg") * 2 + 1).alias("to"), F.col("n").alias("rest"))
    out = F.coalesce(F.col("next") * 2, F.when(F.col("up") >= 0, F.col("up") * 2 + 1), F.lit(-1))
    steps = go_in.unionByName(rows.select("conv_id", (F.col("seg") * 2 + 1).alias("step"), out.alias("to"), F.lit(0).cast("long").alias("rest")))
    steps = written(steps, "steps")
    while not steps.where("to >= 0").isEmpty():
        on = steps.select("conv_id", F.col("step").alias("to"), F.col("to").alias("then"), F.col("rest").alias("more"))
        steps = steps.join(on, ["conv_id", "to"], "left").select("conv_id", "step", F.coalesce("then", F.lit(-1)).alias("to"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest"))
        steps = written(steps, "steps")
    total = segs.groupBy("conv_id").agg(F.sum("n").alias("total"))
    ins = steps.where("step % 2 = 0").join(total, "conv_id")
    return ins.select("conv_id", (F.col("step") / 2).cast("long").alias("seg"), (F.col("total") - F.col("rest")).alias("begin"))
