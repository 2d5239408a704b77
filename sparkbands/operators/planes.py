"""Clusters in the plane, modes of a band, slabs, paths of bands and merged intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored
from .clusters import kmeans_1d, silhouette_1d
from .columns import steady_mean
from .kmeans import in_order

_RUN = 1 << 14  # draws in a row


def kmeans_2d(points: DataFrame, k: int = 3, rounds: int = 8, by: str = "w") -> DataFrame:
    """Labels 0 .. k-1 by the centres' x, and the centre of each row of (key, sample_id, x, y); seeds are points at the quantiles (i + 0.5) / k of x, to four digits.

    As in one dimension, a round is one aggregate, and only centres come to the driver.
    """
    rows = stored(points.where("x is not null and y is not null").select(by, "sample_id", "x", "y"))
    at = rows.groupBy(by).agg(*(F.expr(f"percentile_disc({round((i + 0.5) / k, 4)}) within group (order by x)").alias(f"q{i}") for i in range(k)))
    seeds = rows.join(at, by).groupBy(by).agg(*(steady_mean(F.when(F.col("x") == F.col(f"q{i}"), F.col(c))).alias(f"{c}{i}") for i in range(k) for c in "xy"))
    names = [f"{c}{i}" for i in range(k) for c in "xy"]
    centres = {r[by]: list(r)[1:] for r in seeds.select(by, *names).collect()}
    kind = dict(rows.dtypes)[by]
    far = lambda i: (F.col("x") - F.col(f"x{i}")) * (F.col("x") - F.col(f"x{i}")) + (F.col("y") - F.col(f"y{i}")) * (F.col("y") - F.col(f"y{i}"))
    off = F.array(*(far(i) for i in range(k)))

    def labelled() -> DataFrame:
        table = rows.sparkSession.createDataFrame([(w, *c) for w, c in centres.items()], f"{by} {kind}, " + ", ".join(f"{c} double" for c in names))
        return rows.join(table, by).withColumn("j", (F.array_position(off, F.array_min(off)) - 1).cast("int"))

    for _ in range(rounds):
        found = labelled().groupBy(by).agg(*(steady_mean(F.when(F.col("j") == int(n[1:]), F.col(n[0]))).alias(n) for n in names)).collect()
        new = {r[by]: [m if m is not None else old for m, old in zip((r[n] for n in names), centres[r[by]])] for r in found}
        still = all(abs(m - old) <= 1e-12 * max(1.0, abs(old)) for w in new for m, old in zip(new[w], centres[w]))  # sums differ in their last digits
        centres = new
        if still:
            break
    own = lambda c: F.get(F.array(*(F.col(f"{c}{i}") for i in range(k))), "j")
    rank = sum((F.when((F.col(f"x{i}") < own("x")) | ((F.col(f"x{i}") == own("x")) & (F.lit(i) < F.col("j"))), 1).otherwise(0) for i in range(k)), F.lit(0))
    return labelled().select(by, "sample_id", "x", "y", rank.cast("int").alias("k"), own("x").alias("cx"), own("y").alias("cy"))


def uv_rotation(clustered: DataFrame, k: int = 3, by: str = "w") -> DataFrame:
    """u along the line from the first to the last centre, v across it."""
    ends = clustered.groupBy(by).agg(*(F.max(F.when(F.col("k") == i, F.col(c))).alias(f"{c}_{i}") for i in (0, k - 1) for c in ("cx", "cy")))
    a = F.atan2(F.col(f"cy_{k - 1}") - F.col("cy_0"), F.col(f"cx_{k - 1}") - F.col("cx_0"))
    rows = clustered.join(ends.withColumn("angle", F.coalesce(a, F.lit(0.0))), by)
    return rows.select(by, "sample_id", "k", (F.col("x") * F.cos("angle") + F.col("y") * F.sin("angle")).alias("u"), (F.col("y") * F.cos("angle") - F.col("x") * F.sin("angle")).alias("v"))


def residual_suspicion(clustered: DataFrame, limit: float = 2.0, by: str = "w") -> DataFrame:
    """Per sample: mean and largest z, floored at 0, of its distance to its own centre within (key, band), and the share of its most frequent band."""
    d = clustered.withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)))
    s = d.groupBy(by, "k").agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"))
    z = d.join(s, [by, "k"]).withColumn("z", F.when(F.col("sd") > 1e-9, F.greatest(F.lit(0.0), (F.col("d") - F.col("m")) / F.col("sd"))).otherwise(0.0))
    most = z.groupBy("sample_id", "k").agg(F.count("*").alias("n")).groupBy("sample_id").agg((F.max("n") / F.sum("n")).alias("consistency"))
    out = z.groupBy("sample_id").agg(F.avg("z").alias("mean_z"), F.max("z").alias("max_z"), F.count("*").alias("n"))
    return out.join(most, "sample_id").withColumn("suspicious", F.col("max_z") >= limit)


def band_modes(het: DataFrame, rounds: int = 12, least: int = 3, gap: float = 0.15, ratio: float = 2.0) -> DataFrame:
    """Whether a band (key, sample_id, value) has two modes: two means, each of ``least`` samples, apart by ``gap`` and by ``ratio`` pooled deviations."""
    t = kmeans_1d(het, 2, rounds, "key")
    of = lambda f, i: f(F.when(F.col("k") == i, F.col("value")))
    s = t.groupBy("key").agg(*(of(f, i).alias(f"{n}{i}") for i in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    n = F.col("n0") + F.col("n1") - 2
    pooled = F.sqrt(((F.col("n0") - 1) * F.coalesce("v0", F.lit(0.0)) + (F.col("n1") - 1) * F.coalesce("v1", F.lit(0.0))) / F.greatest(n, F.lit(1)))
    apart = F.col("m1") - F.col("m0")
    two = (F.least("n0", "n1") >= least) & (apart >= gap) & ((pooled == 0) | (apart / pooled >= ratio))
    return s.select("key", "n0", "n1", apart.alias("gap"), F.coalesce(two, F.lit(False)).alias("two_modes"))


def slabs(n_windows: int, half: int) -> list[tuple[int, int, int]]:
    """(number, first, last) of slabs of 2 * half + 1 windows, the last one clipped."""
    return [(i, c - half, min(c + half, n_windows - 1)) for i, c in enumerate(range(half, n_windows + half, 2 * half + 1)) if c - half < n_windows]


def nested_band_scan(rows: DataFrame, least: int = 10, limit: float = 0.5) -> DataFrame:
    """Silhouette of three bands for each stratum and window (stratum, w, sample_id, value) of at least ``least`` samples, and whether it exceeds ``limit``."""
    big = rows.groupBy("stratum", "w").agg(F.count("value").alias("n")).where(F.col("n") >= least).select("stratum", "w")
    keyed = rows.join(big, ["stratum", "w"]).select((F.col("stratum") * 100_000 + F.col("w")).alias("w"), "sample_id", "value")
    s = silhouette_1d(kmeans_1d(keyed))
    return s.select(F.floor(F.col("w") / 100_000).alias("stratum"), (F.col("w") % 100_000).alias("w"), "silhouette", (F.col("silhouette") > limit).alias("nested"))


def subsample_control(values: DataFrame, observed: DataFrame, reps: int = 1000) -> DataFrame:
    """Means of as many values of a pool, drawn with replacement, as the observed group has: (id, mean, low, high, p, verdict).

    A draw is a hash of repetition and number, so reruns agree; draws meet the
    pool by index.  A group's draws are made in runs that are dealt over all
    tasks, and meet the pool by merging: no side of that join is small.  values
    is (id, value), observed (id, n, mean).
    """
    pool = in_order(values.select("id", F.col("value").cast("double").alias("value")), ["id"])
    size = pool.groupBy("id").agg(F.count("*").alias("size"))
    runs = observed.where("n > 0").join(size, "id").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _RUN))))
    spread = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.select("id", "rep", "run", "n", "size").repartition(spread, "id", "rep", "run")
    first = F.col("run") * _RUN + 1
    draws = runs.withColumn("d", F.explode(F.sequence(first, F.least(F.col("n").cast("long"), first + (_RUN - 1))).cast("array<int>")))
    draws = draws.select("id", "rep", F.pmod(F.xxhash64("id", "rep", "d"), F.col("size")).alias("i"))
    means = draws.hint("merge").join(pool, ["id", "i"]).groupBy("id", "rep").agg(F.avg("value").alias("m"))
    t = means.join(observed.select("id", F.col("mean").alias("observed")), "id").groupBy("id").agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") <= F.col("observed")).cast("double")).alias("p"))
    return t.withColumn("verdict", F.when(F.col("p") < 0.05, "real_reduction").when(F.col("p") > 0.5, "consistent_with_sample_size").otherwise("inconclusive"))


def best_partners(jaccards: DataFrame, least: float = 0.5) -> DataFrame:
    """(chrom, side, w, k, to_w, to_k, jaccard): the best partner of each band in the next window to the right (side 1) and the left (-1), if it reaches ``least``."""
    j = jaccards.where(F.col("jaccard") >= least)
    return j.select("chrom", (F.col("w2") - F.col("w1")).cast("int").alias("side"), F.col("w1").alias("w"), F.col("a").alias("k"), F.col("w2").alias("to_w"), F.col("b").alias("to_k"), "jaccard")


def single_band_track(partners: DataFrame, seeds: DataFrame) -> DataFrame:
    """From each seed (chrom, w, k), step by step to the best partner either way: (chrom, seed_w, seed_k, w, k, jaccard), a seed itself with 1.

    ``partners`` is best_partners().  Steps are doubled: what is reached within
    2**i windows goes on by jumps of 2**i, for all seeds and chromosomes at once,
    so rounds are a logarithm of the longest track.
    """
    names = ["chrom", "side", "w", "k"]
    jump = stored(partners.select(*names, "to_w", "to_k", "jaccard"))
    one = seeds.select("chrom", F.col("w").alias("seed_w"), F.col("k").alias("seed_k"), "w", "k", F.lit(1.0).alias("jaccard")).distinct()
    sides = F.explode(F.array(F.lit(-1), F.lit(1)))
    reached = stored(one.withColumn("side", sides))
    while not jump.isEmpty():
        onward = jump.withColumnRenamed("jaccard", "next")
        more = reached.join(onward, names).select("chrom", "seed_w", "seed_k", F.col("to_w").alias("w"), F.col("to_k").alias("k"), F.col("next").alias("jaccard"), "side")
        reached = stored(reached.unionByName(more))
        then = jump.select("chrom", "side", F.col("w").alias("to_w"), F.col("k").alias("to_k"), F.col("to_w").alias("w2"), F.col("to_k").alias("k2"), F.col("jaccard").alias("next"))
        jump = stored(jump.join(then, ["chrom", "side", "to_w", "to_k"]).select(*names, F.col("w2").alias("to_w"), F.col("k2").alias("to_k"), F.col("next").alias("jaccard")))
    return reached.where("side = 1 or w <> seed_w").drop("side")


def het_skeleton(track: DataFrame, means: DataFrame, windows: DataFrame) -> DataFrame:
    """Per seed (chrom, seed_w, seed_k) of a track: its windows, where it begins and ends, the band's mean share of the span of band means, and how well steps hold on.

    ``means`` is (chrom, w, k, mean), ``windows`` (chrom, w, start_bp, end_bp).
    """
    span = means.groupBy("chrom", "w").agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    rows = track.join(means, ["chrom", "w", "k"]).join(span, ["chrom", "w"]).join(windows, ["chrom", "w"])
    share = F.when(F.col("hi") > F.col("lo"), (F.col("mean") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    step = F.when(F.col("w") != F.col("seed_w"), F.col("jaccard"))
    return rows.groupBy("chrom", "seed_w", "seed_k").agg(
        F.min("w").alias("s"),
        F.max("w").alias("e"),
        F.min("start_bp").alias("start_bp"),
        F.max("end_bp").alias("end_bp"),
        F.count("*").alias("n_windows"),
        F.avg(share).alias("mean_share"),
        F.coalesce(F.avg(step), F.lit(0.0)).alias("mean_continuity"),
        F.coalesce(F.min(step), F.lit(0.0)).alias("min_continuity"),
    )


def merge_het_intervals(intervals: DataFrame, gap: int = 100_000, least: float = 0.5) -> DataFrame:
    """Intervals (chrom, id, start_bp, end_bp, core) by start: one joins the stretch before it if it is near and its core's Jaccard with the stretch's union reaches ``least``.

    ``core`` is the bitmap of a sample set, an array of (chunk, b0 .. b3).  Where
    an interval is further than ``gap`` from all before it, the gap alone breaks;
    only what lies between such breaks is walked, in order, holding one union.
    """
    by = W.partitionBy("chrom").orderBy("start_bp", "end_bp", "id")  # a row for each interval, without its core
    far = F.max("end_bp").over(by.rowsBetween(W.unboundedPreceding, -1))
    cut = F.coalesce(F.col("start_bp") - far > gap, F.lit(True)).cast("int")
    at = intervals.select("chrom", "id", "start_bp", "end_bp").withColumn("cut", cut).withColumn("part", F.sum("cut").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = intervals.join(at.select("chrom", "id", "part"), ["chrom", "id"]).repartition("chrom", "part").sortWithinPartitions("chrom", "part", "start_bp", "end_bp", "id")
    size = lambda bits: sum(int(w & _ALL).bit_count() for ws in bits.values() for w in ws)

    def run(frames):
        last, union = None, {}
        for f in frames:
            done = []
            for chrom, part, start, end, core in f.itertuples(index=False):
                bits = {c["chunk"]: [int(c[b]) for b in ("b0", "b1", "b2", "b3")] for c in core}
                joins = False
                if last and (last[0], last[1]) == (chrom, part) and start - last[3] <= gap:
                    both = size({k: [x & y for x, y in zip(bits[k], union[k])] for k in bits.keys() & union.keys()})
                    whole = size(bits) + size(union) - both
                    joins = both >= least * whole if whole else least <= 0
                if joins:
                    last[3], last[4] = max(last[3], end), last[4] + 1
                    for k, ws in bits.items():
                        union[k] = [x | y for x, y in zip(ws, union.get(k, (0, 0, 0, 0)))]
                else:
                    if last:
                        done.append((last[0], last[2], last[3], last[4], size(union)))
                    last, union = [chrom, part, start, end, 1], bits
            yield pd.DataFrame(done, columns=["chrom", "start_bp", "end_bp", "n", "n_core"])
        if last:
            yield pd.DataFrame([(last[0], last[2], last[3], last[4], size(union))], columns=["chrom", "start_bp", "end_bp", "n", "n_core"])

    return rows.select("chrom", "part", "start_bp", "end_bp", "core").mapInPandas(run, "chrom string, start_bp long, end_bp long, n int, n_core int")


_ALL = (1 << 64) - 1


def grow_span(windows: DataFrame, focal: DataFrame, target: float, size: str) -> DataFrame:
    """From each focal window (chrom, w), windows are taken in from the side that has given less (left if equal) until they hold ``target`` of ``size``.

    A window is taken when its side has given what lies between it and the focal
    one, so the order is a merge of two rising sequences of running sums, and the
    last window taken is found by bisection on either side.  Null sizes are 0.
    Returns (chrom, w, first, last, held, met, asymmetric): whether the target is
    reached, and whether a chromosome's end forced the side.
    """

    def grow(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("w")
        w, n = rows["w"].to_numpy(np.int64), rows[size].fillna(0).to_numpy(float)
        f = np.flatnonzero(np.isin(w, start["at"].to_numpy(np.int64)))
        sums, m = np.concatenate([[0.0], np.cumsum(n)]), len(w)
        left = lambda i: sums[f] - sums[f - i]  # what the i windows to the left hold
        right = lambda j: sums[f + 1 + j] - sums[f + 1]
        most_l, most_r = f, m - 1 - f

        def first(ok, most):
            """The smallest count up to ``most`` for which ok holds, most + 1 if none."""
            lo, hi = np.zeros(len(f), np.int64), most + 1
            while (lo < hi).any():
                mid = (lo + hi) // 2
                good = ok(np.minimum(mid, most)) | (mid > most)
                lo, hi = np.where(good | (lo >= hi), lo, mid + 1), np.where(good & (lo < hi), mid, hi)
            return lo

        # how many of the other side are taken before: those that come after less (or, to the left, as much)
        rights = lambda i: first(lambda j: (j >= most_r) | (right(j) >= left(i - 1)), most_r)
        lefts = lambda j: first(lambda i: (i >= most_l) | (left(i) > right(j - 1)), most_l)
        need = target - n[f]
        end_l = first(lambda i: (i > 0) & (left(i) + right(rights(np.maximum(i, 1))) >= need), most_l)
        end_r = first(lambda j: (j > 0) & (right(j) + left(lefts(np.maximum(j, 1))) >= need), most_r)
        # the end is the earlier of the two picks: the left one if it comes after no more than the right one
        i, j = np.minimum(end_l, most_l), np.minimum(end_r, most_r)
        by_l, by_r = end_l <= most_l, end_r <= most_r
        l_first = by_l & (~by_r | (left(np.maximum(i, 1) - 1) <= right(np.maximum(j, 1) - 1)))
        a = np.where(l_first, i, np.where(by_r, lefts(np.maximum(j, 1)), most_l))
        b = np.where(l_first, rights(np.maximum(i, 1)), np.where(by_r, j, most_r))
        none = need <= 0
        a, b = np.where(none, 0, a), np.where(none, 0, b)
        held = n[f] + left(a) + right(b)
        # forced: a window was taken when the other side had no more
        last_l, last_r = left(np.maximum(a, 1) - 1), right(np.maximum(b, 1) - 1)
        used_l = (a == most_l) & (b > 0) & ((a == 0) | (last_l <= last_r))
        used_r = (b == most_r) & (a > 0) & ((b == 0) | (last_r < last_l))
        name = start["of"].iloc[0] if len(start) else None
        return pd.DataFrame({"chrom": name, "w": w[f], "first": w[f - a], "last": w[f + b], "held": held, "met": held >= target, "asymmetric": used_l | used_r})

    # names of their own: both sides may come from one table
    focal = focal.select(F.col("chrom").alias("of"), F.col("w").alias("at")).distinct()
    return windows.select("chrom", "w", size).groupBy("chrom").cogroup(focal.groupBy("of")).applyInPandas(grow, "chrom string, w int, first int, last int, held double, met boolean, asymmetric boolean")


def tier_signatures(bins: DataFrame, shown: int = 4) -> DataFrame:
    """Samples with one string of tiers (0, 1, 2 by mean dosage below 0.5, below 1.5, else) over their bins: size and the first few of each group."""
    tier = F.when(F.col("mean") < 0.5, "0").when(F.col("mean") < 1.5, "1").otherwise("2")
    s = bins.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", tier.alias("t")))), lambda x: x["t"]), "").alias("signature"))  # forty bins at most
    first = s.withColumn("i", F.row_number().over(W.partitionBy("signature").orderBy("sample_id")))
    t = first.groupBy("signature").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("i") <= shown, F.col("sample_id")))), ",").alias("representatives"))
    return t


def detect_groups(means: DataFrame, most: int = 4, least: int = 4) -> DataFrame:
    """Groups of samples by their mean (key, sample_id, value): of 2 to ``most`` bands of at least ``least`` samples each, the number with the best silhouette.

    A group has its size, centre, distance to the nearest other centre and, as
    confidence, the silhouette of its key; a key without such bands has no rows.
    """
    found = None
    for k in range(2, most + 1):
        t = stored(kmeans_1d(means, k, by="key").withColumnRenamed("key", "w"))
        ok = t.groupBy("w", "k").agg(F.count("*").alias("m")).groupBy("w").agg(F.min("m").alias("m"), F.count("*").alias("g")).where((F.col("m") >= least) & (F.col("g") == k))
        s = silhouette_1d(t).join(ok, "w", "left_semi").select("w", "silhouette")
        g = t.groupBy("w", "k").agg(F.count("*").alias("n"), F.avg("value").alias("centre")).join(s, "w").withColumn("groups", F.lit(k))
        found = g if found is None else found.unionByName(g)
    found = stored(found)
    best = found.groupBy("w").agg(F.max(F.struct("silhouette", (-F.col("groups")).alias("minus"))).alias("b"))
    rows = found.join(best, "w").where(F.col("groups") == -F.col("b.minus"))
    by = W.partitionBy("w").orderBy("centre")  # a few groups a key
    gap = F.least(F.col("centre") - F.lag("centre").over(by), F.lead("centre").over(by) - F.col("centre"))
    return rows.select(F.col("w").alias("key"), F.col("k").alias("grp"), "n", "centre", "groups", gap.alias("separation"), F.col("silhouette").alias("confidence"))
