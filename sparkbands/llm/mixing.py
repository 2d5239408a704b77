"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule is the point frac(i * golden ratio), worked out exactly
on a grid of 2**31, and mapped through the cumulative targets of the sources.
The schedule runs until its slots, of ``block`` words each, hold as many words
as all documents.  The slots of a source are ranked in their order.  Each
source's documents, shuffled by a hash, form an endless stream that begins again
when it has ended, and slot r of a source takes words r * block up to
(r + 1) * block of it: equal-token blocks, joined by rank.  So what a source
gives is decided by the points alone, and comes to within a few blocks of its
target; a document is read ``most`` times at most.

Targets: the sources, ordered by code point with null last, weigh ``weights`` in
turn and share all words; none gets more than ``most`` times its own words, and
what is over is shared again by weight.  Null and empty texts have no words and
take nothing.  Repeated rows count each for themselves; those that agree in id
and size stand in an order of no consequence, as they take alike.  Texts are
only counted, however long; an empty table gives no rows.  Columns other than
doc_id, text, source and those of ``keep`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Points are multiples of the golden ratio's fraction on a grid of 2**31: an odd step, so that all points come before any comes again.
_GRID = 1 << 31
_STEP = 1327217885
#: Cells of the unit line in which points meet sources, and slots that are ranked together.
_CELLS = 1024
_CHUNK = 1 << 14


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size): one level L with sum of min(most * size, L * weight) = all words."""
    known = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here: the windows are over sources, not documents.
    ordered = known.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double")
    rows = ordered.withColumn("w", weigh).withColumn("limit", F.col("source_size") * most)
    every = W.partitionBy()
    by = W.orderBy(F.col("limit") / F.col("w"), "k").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every), "sum_limit": F.sum("limit").over(by), "sum_w": F.sum("w").over(by)})
    # the level if the sources before this one are at their limits and this one and all after it are not
    left = F.col("total") - (F.col("sum_limit") - F.col("limit"))
    rows = rows.withColumn("level", left / (F.col("all_w") - F.col("sum_w") + F.col("w")))
    rows = rows.withColumn("open", F.col("limit") / F.col("w") >= F.col("level"))
    rows = rows.withColumn("at", F.min(F.when(F.col("open"), F.struct("sum_w", "level"))).over(every)["level"])
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("at") * F.col("w"), F.col("limit").cast("double")))
    return rows.select("source", "k", "source_size", target.alias("target"))


def order_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("order")


def placed(rows: DataFrame, keep: tuple = ()) -> DataFrame:
    """Adds ``start``, the words before each document in its source's shuffled stream, without sorting a source in one task."""
    rows = rows.withColumn("b", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    per = rows.groupBy("k", "b").agg(F.sum("size").alias("n"))  # at most 4096 a source
    before = per.withColumn("base", F.sum("n").over(W.partitionBy("k").orderBy("b")) - F.col("n")).select("k", "b", "base")
    inner = W.partitionBy("k", "b").orderBy("order", "doc_id", "size", *keep).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.join(before, ["k", "b"]).withColumn("start", F.col("base") + F.sum("size").over(inner) - F.col("size")).drop("b", "base")


def bands(goal: DataFrame) -> DataFrame:
    """(k, lo, hi): each source's part of the grid, by cumulative targets; goal has a row for each source."""
    by = W.orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = F.floor(F.sum("target").over(by) / F.sum("target").over(W.partitionBy()) * _GRID).cast("long")
    rows = goal.where("target > 0").select("k", edge.alias("hi"))
    return rows.withColumn("lo", F.lag("hi", 1, 0).over(W.orderBy("k"))).where("hi > lo")


def schedule(goal: DataFrame, n_slots: int) -> DataFrame:
    """(k, rank, slot): the source of each of the first ``n_slots`` points, and the slot's rank among those of its source."""
    cell = lambda x: F.floor(x / (_GRID // _CELLS))
    parts = bands(goal).withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    points = goal.sparkSession.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") % _GRID * _STEP % _GRID).alias("x"))
    slots = points.withColumn("cell", cell(F.col("x"))).join(parts, "cell").where("x >= lo and x < hi")
    slots = slots.select("slot", "k", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    per = slots.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    before = per.withColumn("base", F.sum("n").over(W.partitionBy("k").orderBy("chunk")) - F.col("n")).drop("n")
    inner = W.partitionBy("k", "chunk").orderBy("slot")
    return slots.join(before, ["k", "chunk"]).select("k", (F.col("base") + F.row_number().over(inner) - 1).alias("rank"), "slot")


def mix(docs: DataFrame, block: int = 16, seed: str = "mix", weights: tuple = (5, 2, 1), most: int = 3, keep: tuple = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_slots) for each row of docs(doc_id, text, source), and its columns ``keep``, which order rows of one id and size.

    ``first_slot`` is the slot of the schedule in which the document begins
    (null: the mix does not take it), ``n_slots`` those that take words of it.
    """
    rows = docs.select("doc_id", *keep, "source", n_words(F.col("text")).alias("size"))
    rows = written(rows.select("*", order_key(seed)), "mix-sizes")
    goal = written(targets(rows, weights, most), "mix-targets")
    n_slots = (goal.agg(F.sum("source_size")).first()[0] or 0) // block + 1
    slots = written(schedule(goal, n_slots), "mix-slots")
    given = slots.groupBy("k").agg((F.count("*") * block).alias("given"))
    goal = written(goal.join(given, "k", "left").fillna(0, ["given"]), "mix-given")
    rows = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).select("doc_id", *keep, "size", "order", "k", "source_size", "target", "given")
    stream = written(placed(rows, keep), "mix-stream").drop("order")
    # a document in each pass over its source that reaches it, at the slot with the rank of its first block
    at = F.col("start") + F.col("pass") * F.col("source_size")
    visits = stream.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("at", at)
    visits = visits.where("at < given").withColumns({"words": F.least("size", F.col("given") - F.col("at")), "rank": F.floor(F.col("at") / block)})
    visits = visits.join(slots, ["k", "rank"])
    met = F.floor((F.col("at") + F.col("words") - 1) / block) - F.col("rank") + 1
    # a source's documents with words begin at different places of its stream
    taken = visits.groupBy("k", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sum(met).alias("n_slots"))
    taken = taken.withColumn("some", F.lit(True))
    out = stream.withColumn("some", F.col("size") > 0).join(taken, ["k", "start", "some"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *keep, "size", "source_size", "target", zero("taken"), "first_slot", zero("n_slots"))
