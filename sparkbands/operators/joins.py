"""Range and as-of joins between points, windows and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def binned(df: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """One row for each bin that [lo, hi] touches."""
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def points_in(windows: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Pairs of a window and a point inside it, bounds included: an equi-join on bins, then the exact test."""
    at = points.withColumn("bin", F.floor(F.col("pos_bp") / width))
    return binned(windows, "start_bp", "end_bp", width).join(at, ["chrom", "bin"]).where("pos_bp between start_bp and end_bp").drop("bin")


def overlaps(a: DataFrame, b: DataFrame, width: int, strict: bool = True) -> DataFrame:
    """Pairs (id, start_bp, end_bp of a; id2, start2, end2 of b) on one chromosome that overlap; each pair once."""
    right = b.withColumnsRenamed({"id": "id2", "start_bp": "start2", "end_bp": "end2", "source": "source2"})
    pairs = binned(a, "start_bp", "end_bp", width).join(binned(right, "start2", "end2", width), ["chrom", "bin"])
    # the pair is kept in the bin where its overlap begins, so no distinct is needed
    pairs = pairs.where(F.col("bin") == F.floor(F.greatest("start_bp", "start2") / width)).drop("bin")
    return pairs.where("start_bp < end2 and start2 < end_bp" if strict else "start_bp <= end2 and start2 <= end_bp")


def window_snp_membership(windows: DataFrame, points: DataFrame, width: int) -> DataFrame:
    found = points_in(windows.select("chrom", "w", "start_bp", "end_bp"), points, width).groupBy("chrom", "w").agg(F.count("*").alias("n"), F.countDistinct("pos_bp").alias("n_positions"))
    return windows.select("chrom", "w").join(found, ["chrom", "w"], "left").na.fill(0, ["n", "n_positions"])


def unique_snps_in_window_range(windows: DataFrame, points: DataFrame, lo: int, hi: int, width: int) -> DataFrame:
    if lo > hi:
        raise ValueError("the first window is after the last")
    return points_in(windows.where(F.col("w").between(lo, hi)), points, width).select("chrom", "pos_bp").distinct()


def point_in_window_lookup(points: DataFrame, windows: DataFrame, run: int = 1 << 16) -> DataFrame:
    """The window with the largest start at or before each position, if it reaches it; distinct positions.

    Runs of positions keep a chromosome out of one task; the last window of the
    runs before is handed on through a small table.
    """
    probe = points.select("chrom", "pos_bp").distinct().select("chrom", "pos_bp", F.lit(1).alias("kind"), F.lit(None).cast("struct<start_bp:bigint,w:int,end_bp:bigint>").alias("win"))
    starts = windows.select("chrom", F.col("start_bp").alias("pos_bp"), F.lit(0).alias("kind"), F.struct("start_bp", "w", "end_bp").alias("win"))
    rows = probe.unionByName(starts).withColumn("run", F.floor(F.col("pos_bp") / run))
    inner = W.partitionBy("chrom", "run").orderBy("pos_bp", "kind", "win.w").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("near", F.last("win", ignorenulls=True).over(inner))
    ends = rows.groupBy("chrom", "run").agg(F.max("win").alias("end"))
    ends = ends.select("chrom", "run", F.last("end", ignorenulls=True).over(W.partitionBy("chrom").orderBy("run").rowsBetween(W.unboundedPreceding, -1)).alias("end"))
    rows = rows.where("kind = 1").join(ends, ["chrom", "run"]).withColumn("hit", F.coalesce("near", "end"))
    return rows.where("pos_bp <= hit.end_bp").select("chrom", "pos_bp", F.col("hit.w").alias("w"))


def windows_in_range(candidates: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Windows whose middle lies in a candidate, bounds included."""
    mid = windows.select("chrom", "w", ((F.col("start_bp") + F.col("end_bp")) / 2).alias("pos_bp"))
    return points_in(candidates, mid, width).select("id", "chrom", "w")


def interval_overlap_pairs(intervals: DataFrame, width: int) -> DataFrame:
    p = overlaps(intervals, intervals, width).where("id < id2")
    shared = F.least("end_bp", "end2") - F.greatest("start_bp", "start2")
    return p.select("id", "id2", shared.alias("overlap_bp"), ((F.col("start_bp") <= F.col("start2")) & (F.col("end_bp") >= F.col("end2"))).alias("contains"), ((F.col("start2") <= F.col("start_bp")) & (F.col("end2") >= F.col("end_bp"))).alias("inside"))


def source_overlap_counts(intervals: DataFrame, run: int = 1 << 16) -> DataFrame:
    """Per source: intervals that overlap some of each other source, of all others, or of none (bounds included).

    No pairs are made: an interval meets a source if, of that source's intervals
    that begin by its end, the furthest end is not before its start.
    """
    starts = intervals.groupBy("chrom", "source", F.col("start_bp").alias("pos_bp")).agg(F.max("end_bp").alias("reach")).withColumn("probe", F.lit(False))
    ends = intervals.select("chrom", F.col("end_bp").alias("pos_bp")).distinct().join(intervals.select("chrom", "source").distinct(), "chrom")
    rows = starts.unionByName(ends.withColumn("probe", F.lit(True)), allowMissingColumns=True).withColumn("run", F.floor(F.col("pos_bp") / run))
    inner = W.partitionBy("chrom", "source", "run").orderBy("pos_bp", "probe").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("near", F.max("reach").over(inner))
    before = rows.groupBy("chrom", "source", "run").agg(F.max("reach").alias("top"))
    before = before.select("chrom", "source", "run", F.max("top").over(W.partitionBy("chrom", "source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)).alias("top"))
    found = rows.where("probe").join(before, ["chrom", "source", "run"]).withColumn("reach", F.greatest("near", "top")).where("reach is not null")
    found = found.groupBy("chrom", F.col("pos_bp").alias("end_bp")).agg(F.collect_list(F.struct("source", "reach")).alias("met"))
    met = F.filter("met", lambda m: (m["source"] != F.col("source")) & (m["reach"] >= F.col("start_bp")))
    per = intervals.join(found, ["chrom", "end_bp"], "left").select("source", F.coalesce(F.size(met), F.lit(0)).alias("k"))
    others = intervals.select("source").distinct().count() - 1
    return per.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("k") == 0).alias("n_none"), F.count_if(F.col("k") == others).alias("n_all"))


def boundary_scan_range(candidates: DataFrame, radius: float, chrom_len: int) -> DataFrame:
    span = F.col("end_bp") - F.col("start_bp")
    reach = F.when(span > 2 * radius, F.greatest(F.lit(float(radius)), span / 2)).otherwise(F.lit(float(radius)))
    clamp = lambda c: F.least(F.lit(float(chrom_len)), F.greatest(F.lit(0.0), c))
    return candidates.select("id", clamp(F.col("start_bp") - reach).alias("scan_start"), clamp(F.col("end_bp") + reach).alias("scan_end"))


def fraction_in_interval(segments: DataFrame, start: int, end: int, key: str) -> DataFrame:
    """Share of [start, end] that the segments of each key cover, at most 1."""
    part = F.greatest(F.lit(0), F.least("end_bp", F.lit(end)) - F.greatest("start_bp", F.lit(start)))
    return segments.groupBy(key).agg(F.least(F.lit(1.0), F.sum(part) / max(1, end - start)).alias("fraction"))


def common_relatives(kin: DataFrame, first: float = 0.177, second: float = 0.0884) -> DataFrame:
    """For close pairs (a, b): every c close to a and at least second-degree to b."""
    both = kin.select("a", "b", "kinship").unionByName(kin.select(F.col("b").alias("a"), F.col("a").alias("b"), "kinship"))
    pairs = kin.where(F.col("kinship") >= first).select("a", "b")
    to_a = both.where(F.col("kinship") >= first).select("a", F.col("b").alias("c"))
    to_b = both.where(F.col("kinship") >= second).select("b", F.col("a").alias("c"))
    return pairs.join(to_a, "a").join(to_b, ["b", "c"]).where("c <> a and c <> b").select("a", "b", "c")


def near(x: Column, y: Column, most: float) -> Column:
    return F.abs(x - y) < most
