"""Grouped aggregates: dosage features, contingency statistics, rank tests, compositions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .annotate import fisher_exact
from .kmeans import in_order

from ..functions.tails import normal_two_sided


def sample_dosage_features(dosage: DataFrame) -> DataFrame:
    d = F.col("dosage")
    return dosage.groupBy("sample_id").agg(F.avg(d).alias("mean"), F.avg(((d > 0.5) & (d <= 1.5)).cast("double")).alias("het_share"), F.count(d).alias("n"))


def het_rate_for_range(dosage: DataFrame, start: int, end: int, exactly: float = 1.0) -> DataFrame:
    v = F.when(F.col("dosage") >= 0, F.col("dosage"))
    rows = dosage.where(F.col("pos_bp").between(start, end))
    return rows.groupBy("sample_id").agg((F.count_if(v == exactly) / F.count(v)).alias("het_rate"), F.count(v).alias("n"))


def dosage_mean_for_range(dosage: DataFrame, start: int, end: int) -> DataFrame:
    v = F.when(F.col("dosage") >= 0, F.col("dosage"))
    return dosage.where(F.col("pos_bp").between(start, end)).groupBy("sample_id").agg(F.avg(v).alias("mean"), F.count(v).alias("n"))


def marker_variance(dosage: DataFrame) -> DataFrame:
    return dosage.groupBy("marker").agg(F.var_pop("dosage").alias("variance"), F.avg("dosage").alias("mean"), F.count("dosage").alias("n"))


def high_variance_markers(dosage: DataFrame, least: int = 20) -> DataFrame:
    """Markers with a variance of at least the middle one (upper middle); all of them if there are few."""
    var = marker_variance(dosage)
    n = var.count()
    if n <= least:
        return var.select("marker", "variance")
    # one number from the distinct markers; percentile by position, not interpolated
    cut = var.agg(F.expr(f"percentile_disc({(n // 2 + 1) / n - 1e-9}) within group (order by variance)")).first()[0]
    return var.where(F.col("variance") >= cut).select("marker", "variance")


def mean_median_in_range(track: DataFrame, lo: int, hi: int) -> DataFrame:
    return track.where(F.col("w").between(lo, hi)).groupBy("sample_id").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.count("value").alias("n"))


def weighted_window_mean(windows: DataFrame, value: str, weight: str) -> DataFrame:
    w = F.when(F.col(weight) > 0, F.col(weight))
    return windows.groupBy("chrom").agg(F.coalesce(F.sum(F.col(value) * w) / F.sum(F.when(F.col(value).isNotNull(), w)), F.avg(value)).alias("mean"))


def fst_window_summary(windows: DataFrame, value: str) -> DataFrame:
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return windows.where("start_bp is not null and end_bp is not null").groupBy("chrom").agg(F.count("*").alias("n_windows"), F.avg(v).alias("mean"), F.max(v).alias("max"))


# -- contingency --------------------------------------------------------------


def label_pairs(labels: DataFrame, gap: int = 1) -> DataFrame:
    """Labels of each sample in a window and in the one ``gap`` later: (w, sample_id, a, b)."""
    later = labels.select((F.col("w") - gap).alias("w"), "sample_id", F.col("k").alias("b"))
    return labels.select("w", "sample_id", F.col("k").alias("a")).join(later, ["w", "sample_id"])


def contingency_table(pairs: DataFrame, by: list) -> DataFrame:
    return pairs.where("a >= 0 and b >= 0").groupBy(*by, "a", "b").agg(F.count("*").alias("n"))


def contingency_scores(table: DataFrame, by: list) -> DataFrame:
    """n, chi-square, df, Cramer's V (non-empty rows and columns), ARI and both NMI forms of each table."""
    row, col, all_ = W.partitionBy(*by, "a"), W.partitionBy(*by, "b"), W.partitionBy(*by)
    t = table.withColumns({"ra": F.sum("n").over(row), "cb": F.sum("n").over(col), "t": F.sum("n").over(all_)})
    two = lambda c: c * (c - 1) / 2
    s = t.groupBy(*by).agg(
        F.max("t").alias("n"),
        F.countDistinct("a").alias("rows"),
        F.countDistinct("b").alias("cols"),
        F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("q"),
        F.sum(two(F.col("n"))).alias("same"),
        F.sum(two(F.col("ra")) * F.col("n") / F.col("ra")).alias("same_a"),
        F.sum(two(F.col("cb")) * F.col("n") / F.col("cb")).alias("same_b"),
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ra") * F.col("cb")))).alias("i"),
        (-F.sum(F.col("n") / F.col("t") * F.log(F.col("ra") / F.col("t")))).alias("ha"),
        (-F.sum(F.col("n") / F.col("t") * F.log(F.col("cb") / F.col("t")))).alias("hb"),
    )
    chi2 = F.col("n") * (F.col("q") - 1)
    least = F.least("rows", "cols") - 1
    v = F.when(F.col("n") < 2, None).when(least < 1, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), chi2 / (F.col("n") * least)))))
    expected = F.when(F.col("n") > 1, F.col("same_a") * F.col("same_b") / two(F.col("n"))).otherwise(0.0)
    top = (F.col("same_a") + F.col("same_b")) / 2
    ari = F.when(F.abs(top - expected) < 1e-12, 1.0).otherwise((F.col("same") - expected) / (top - expected))
    nmi = F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("i") / (F.col("ha") + F.col("hb"))).otherwise(1.0)
    nmi_g = F.when(F.col("ha") * F.col("hb") > 0, F.col("i") / F.sqrt(F.col("ha") * F.col("hb"))).otherwise(0.0)
    return s.select(*by, "n", chi2.alias("chi2"), ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("df"), v.alias("v"), ari.alias("ari"), nmi.alias("nmi"), nmi_g.alias("nmi_geometric"))


def fuse_and_split_events(table: DataFrame, by: list, fuse: float = 0.8, split: float = 0.2) -> DataFrame:
    """Fine labels are a, coarse ones b.  Fused: coarse labels with fuse of two fine ones; split: fine ones over two coarse."""
    t = table.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by, "a")))
    fused = t.where(F.col("share") >= fuse).groupBy(*by, "b").agg(F.count("*").alias("m")).where("m >= 2").groupBy(*by).agg(F.count("*").alias("n_fused"))
    cut = t.where(F.col("share") >= split).groupBy(*by, "a").agg(F.count("*").alias("m")).where("m >= 2").groupBy(*by).agg(F.count("*").alias("n_split"))
    return table.select(*by).distinct().join(fused, by, "left").join(cut, by, "left").na.fill(0, ["n_fused", "n_split"])


def restricted_concordance(pairs: DataFrame, by: list, least: float = 0.85) -> DataFrame:
    c = pairs.groupBy(*by).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("concordance"))
    return c.withColumn("verdict", F.when(F.col("concordance").isNull(), "LOW_POWER").when(F.col("concordance") >= least, "MERGE").otherwise("SEPARATE"))


def band_fingerprint(table: DataFrame, by: list, classes: int) -> DataFrame:
    """Per source band: its target distribution's mode (lowest on ties), entropy and concentration."""
    t = table.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*by, "a")))
    h = t.groupBy(*by, "a").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.max(F.struct("n", (-F.col("b")).alias("minus_b"))).alias("m"))
    return h.select(*by, "a", (-F.col("m.minus_b")).alias("mode"), "entropy", (1 - F.col("entropy") / F.log(F.lit(float(classes)))).alias("concentration"))


def pair_cells(calls: DataFrame, classes: int = 3, block: int = 512) -> DataFrame:
    """(c1, c2, n00, n01, ...): samples of each pair of labels of two candidates, c1 < c2, that share a sample; other labels take no part.

    Candidates are numbered in order and dealt into blocks of ``block`` that
    follow one another.  A sample goes, with its calls in both, to each two
    blocks that it has calls in, and there its pairs are counted into one table
    of cells; so pairs are never rows of a shuffle, and what is shuffled are
    calls, once for each block that a sample's other calls are in.
    """
    known = calls.where(F.col("k").between(0, classes - 1) & F.col("sample_id").isNotNull() & F.col("candidate_id").isNotNull())
    kind = dict(calls.dtypes)["candidate_id"]
    place = in_order(known.select(F.col("candidate_id").alias("value")).distinct(), [])
    known = known.join(place.select(F.col("value").alias("candidate_id"), "i"), "candidate_id")
    code = F.col("i") % block * classes + F.col("k")
    of = known.groupBy("sample_id", F.floor(F.col("i") / block).alias("block")).agg(F.collect_list(code.cast("int")).alias("at"))  # a call for each candidate of the block
    spread = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = of.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("block", "at"))).alias("xs"))
    one = sample.select(F.posexplode("xs").alias("p", "x"), "xs").select("x", F.explode(F.slice("xs", F.col("p") + 1, F.size("xs"))).alias("y"))
    met = one.select(F.col("x.block").alias("b1"), F.col("y.block").alias("b2"), F.col("x.at").alias("x"), F.col("y.at").alias("y"))
    names = place.select(F.floor(F.col("i") / block).alias("block"), (F.col("i") % block).cast("int").alias("at"), "value").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "value")))["value"].alias("names"))
    met = met.repartition(spread, "b1", "b2").sortWithinPartitions("b1", "b2")
    cells = [f"n{i}{j}" for i in range(classes) for j in range(classes)]
    wide = block * classes

    def counted(frames):
        held, table = None, None

        def rows():
            n = table.reshape(block, classes, block, classes).transpose(0, 2, 1, 3).reshape(block, block, -1)
            a, b = np.nonzero(n.any(2))
            return pd.DataFrame({"b1": held[0], "b2": held[1], "i1": a.astype(np.int32), "i2": b.astype(np.int32), **dict(zip(cells, n[a, b].T))})

        for f in frames:
            first = f["b1"].to_numpy() if len(f) else []
            cuts = np.flatnonzero((np.diff(first) != 0) | (np.diff(f["b2"].to_numpy()) != 0)) + 1 if len(f) else []
            for part in np.split(np.arange(len(f)), cuts) if len(f) else []:
                key = (int(f["b1"].iloc[part[0]]), int(f["b2"].iloc[part[0]]))
                if key != held:
                    if held:
                        yield rows()
                    held, table = key, np.zeros(wide * wide, np.int64)
                xs, ys = (f[c].iloc[part].to_list() for c in "xy")
                nx, ny = (np.fromiter(map(len, v), np.int64, len(v)) for v in (xs, ys))
                x, y = np.concatenate(xs).astype(np.int64), np.concatenate(ys).astype(np.int64)
                # each x of a row with each y of the row, some rows at a time
                ends = np.cumsum(nx * ny)
                lo = 0
                while lo < len(part):
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20))))
                    fx, fy = int(nx[:lo].sum()), int(ny[:lo].sum())
                    mx, my = nx[lo:hi], ny[lo:hi]
                    per = np.repeat(my, mx)  # for each x, how many y
                    left = np.repeat(x[fx : fx + int(mx.sum())], per)
                    start = np.repeat(np.repeat(fy + np.cumsum(my) - my, mx), per)
                    right = y[start + np.arange(len(left)) - np.repeat(np.cumsum(per) - per, per)]
                    if key[0] == key[1]:
                        up = left // classes < right // classes
                        left, right = left[up], right[up]
                    np.add.at(table, left * wide + right, 1)
                    lo = hi
        if held:
            yield rows()

    out = met.mapInPandas(counted, "b1 long, b2 long, i1 int, i2 int, " + ", ".join(f"{c} long" for c in cells))
    name = lambda i: names.select(F.col("block").alias(f"b{i}"), F.col("names").alias(f"names{i}"))
    out = out.join(F.broadcast(name(1)), "b1").join(F.broadcast(name(2)), "b2")  # a name for each candidate
    return out.select(*(F.get(f"names{i}", F.col(f"i{i}")).cast(kind).alias(f"c{i}") for i in (1, 2)), *cells)


def candidate_scores(calls: DataFrame, classes: int = 3) -> DataFrame:
    """n, chi-square, df and Cramer's V of each pair of candidates that share a sample.

    Scores are sums over the cells of the one row of each pair.
    """
    every = [(i, j) for i in range(classes) for j in range(classes)]
    cells = pair_cells(calls, classes)
    add = lambda xs: sum(xs[1:], xs[0])
    row = [add([F.col(f"n{i}{j}") for j in range(classes)]) for i in range(classes)]
    col = [add([F.col(f"n{i}{j}") for i in range(classes)]) for j in range(classes)]
    t = cells.withColumns({**{f"r{i}": x for i, x in enumerate(row)}, **{f"s{j}": x for j, x in enumerate(col)}, "n": add(row)})
    q = add([F.when(F.col(f"n{i}{j}") > 0, F.col(f"n{i}{j}") * F.col(f"n{i}{j}") / (F.col(f"r{i}") * F.col(f"s{j}"))).otherwise(0.0) for i, j in every])
    there = lambda s: add([(F.col(f"{s}{i}") > 0).cast("int") for i in range(classes)])
    t = t.withColumns({"q": q, "rows": there("r"), "cols": there("s")})
    chi2, least = F.col("n") * (F.col("q") - 1), F.least("rows", "cols") - 1
    v = F.when(F.col("n") < 2, None).when(least < 1, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), chi2 / (F.col("n") * least)))))
    return t.select("c1", "c2", "n", chi2.alias("chi2"), ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("df"), v.alias("v"))


def co_occurrence_strength(scores: DataFrame, least: int = 20) -> DataFrame:
    """Verdicts from contingency_scores; p below 0.05 by the 95th percentile of chi-square for df 1 to 4."""
    cut = F.element_at(F.array(*map(F.lit, CHI2_95)), F.greatest(F.lit(1), F.least(F.col("df"), F.lit(4))).cast("int"))
    sure = (F.col("chi2") > cut) & (F.col("df") >= 1)
    label = F.when(F.col("n") < least, "insufficient_data").when(sure & (F.col("v") >= 0.5), "strong").when(sure & (F.col("v") >= 0.2), "weak").otherwise("independent")
    return scores.withColumn("strength", label)


# 95th percentiles of chi-square, df 1 to 4.
CHI2_95 = (3.841458821, 5.991464547, 7.814727903, 9.487729037)


def label_concordance(table: DataFrame, by: list) -> DataFrame:
    rows = table.groupBy(*by, "a").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return rows.groupBy(*by).agg((F.sum("most") / F.sum("n")).alias("agreement"), F.sum("n").alias("n"))


def shannon_entropy(labels: DataFrame, by: list) -> DataFrame:
    """H / ln K over the labels of each group; 0 for one label."""
    n = labels.groupBy(*by, "k").agg(F.count("*").alias("n"))
    n = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*by)))
    h = n.groupBy(*by).agg((-F.sum(F.col("p") * F.log("p"))).alias("h"), F.count("*").alias("kinds"))
    return h.select(*by, F.when(F.col("kinds") > 1, F.col("h") / F.log(F.col("kinds").cast("double"))).otherwise(0.0).alias("entropy"))


# -- order statistics and ranks -----------------------------------------------


def _lower_median(v: str) -> Column:
    return F.expr(f"percentile_disc(0.5) within group (order by {v})")


def robust_stats(rows: DataFrame, by: list, value: str) -> DataFrame:
    """Lower median, MAD (lower median of distances) and interpolated quartiles."""
    m = rows.groupBy(*by).agg(_lower_median(value).alias("median"), F.expr(f"percentile({value}, array(0.25, 0.75))").alias("q"))
    d = rows.join(m, by).withColumn("d", F.abs(F.col(value) - F.col("median"))).groupBy(*by).agg(_lower_median("d").alias("mad"))
    return m.join(d, by).select(*by, "median", "mad", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))


def average_ranks(measures: DataFrame, by: list) -> DataFrame:
    """One row per distinct value of a test and group, with the value's average rank: no test is sorted row by row."""
    n = measures.where("value is not null").groupBy(*by, "grp", "value").agg(F.count("*").alias("n"))
    t = n.groupBy(*by, "value").agg(F.sum("n").alias("t"))
    before = F.sum("t").over(W.partitionBy(*by).orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    t = t.withColumn("rank", before - (F.col("t") - 1) / 2)
    return n.join(t, [*by, "value"])


def kruskal_wallis(measures: DataFrame, by: list) -> DataFrame:
    r = average_ranks(measures, by)
    ties = r.select(*by, "value", "t").distinct().groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    g = r.groupBy(*by, "grp").agg(F.sum(F.col("rank") * F.col("n")).alias("s"), F.sum("n").alias("m"))
    h = g.groupBy(*by).agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.count("*").alias("groups")).join(ties, by)
    raw = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    fix = 1 - F.col("ties") / (F.pow("n", F.lit(3)) - F.col("n"))
    ok = (F.col("groups") >= 2) & (F.col("n") >= 3) & (fix > 0)
    return h.select(*by, "n", (F.col("groups") - 1).alias("df"), F.when(ok, raw / fix).alias("h"))


def wilcoxon_rank_sum(measures: DataFrame, by: list, one: str, two: str) -> DataFrame:
    """U, z with ties and continuity, two-sided p and direction of two groups."""
    r = average_ranks(measures.where(F.col("grp").isin(one, two)), by)
    ties = r.select(*by, "value", "t").distinct().groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    is_one = F.col("grp") == one
    s = r.groupBy(*by).agg(F.sum(F.when(is_one, F.col("rank") * F.col("n"))).alias("w"), F.sum(F.when(is_one, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(~is_one, F.col("n")).otherwise(0)).alias("n2")).join(ties, by)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("w") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    off = u - n1 * n2 / 2
    z = F.when(sd > 0, F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / sd)
    return s.select(*by, u.alias("u"), z.alias("z"), normal_two_sided(z).alias("p"), F.when(off > 0, "greater").when(off < 0, "less").otherwise("equal").alias("direction"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", bins: int = 4096) -> DataFrame:
    """Adds ``fdr``; tests without a p value are left out.

    Equal p values are one row with their number.  Ranks and minima run inside
    bins of p and then over the bins, so no task orders all tests.
    """
    known = tests.where(F.col(p).isNotNull())
    one = known.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("n")).withColumn("bin", F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1)))
    per = one.groupBy("bin").agg(F.sum("n").alias("n"))
    per = per.select("bin", (F.sum("n").over(W.orderBy("bin")) - F.col("n")).alias("base"), F.sum("n").over(W.partitionBy()).alias("m"))  # a row a bin
    rank = F.col("base") + F.sum("n").over(W.partitionBy("bin").orderBy("_p"))
    one = one.join(F.broadcast(per), "bin").withColumn("adj", F.col("_p") * F.col("m") / rank)
    later = one.groupBy("bin").agg(F.min("adj").alias("low"))
    later = later.select("bin", F.min("low").over(W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)).alias("low"))
    one = one.withColumn("adj", F.min("adj").over(W.partitionBy("bin").orderBy(F.desc("_p")))).join(F.broadcast(later), "bin")
    return known.join(one.select(F.col("_p").alias(p), F.least(F.lit(1.0), "adj", "low").alias("fdr")), p)


# -- genotypes and compositions ------------------------------------------------


def genotype_counts(calls: DataFrame, zones: DataFrame, groups: tuple = ("H1/H1", "H1/H2", "H2/H2"), least: int = 5) -> DataFrame:
    """Calls (sv_id, sample_id, grp, k) by variant: AA, AB, BB and missing in each group, the test of the outer groups, FDR and a label.

    Variants with ``least`` carriers in no group are left out.  The test compares
    AA + AB against BB in the first and the last group (Fisher's exact p, the
    odds with 0.5 added); ``zones`` is (sv_id, zone).  Missing is -1 or null;
    calls of samples in no group count for nothing.
    """
    names = [f"{c}{g}" for g in range(len(groups)) for c in ("aa", "ab", "bb", "miss")]
    k = F.coalesce("k", F.lit(-1))
    of = lambda g, want: F.count_if((F.col("grp") == groups[g]) & (k == want))
    t = calls.where(F.col("grp").isin(*groups)).groupBy("sv_id").agg(*(of(g, want).alias(f"{c}{g}") for g in range(len(groups)) for c, want in (("aa", 0), ("ab", 1), ("bb", 2), ("miss", -1))))
    carriers = F.greatest(*(F.col(f"ab{g}") + F.col(f"bb{g}") for g in range(len(groups))))
    last = len(groups) - 1
    t = t.where(carriers >= least).withColumns({"a": F.col("aa0") + F.col("ab0"), "b": F.col("bb0"), "c": F.col(f"aa{last}") + F.col(f"ab{last}"), "d": F.col(f"bb{last}")})
    odds = (F.col("a") + 0.5) * (F.col("d") + 0.5) / ((F.col("b") + 0.5) * (F.col("c") + 0.5))
    p = fisher_exact(t.select("sv_id", "a", "b", "c", "d"), "sv_id").select("sv_id", "p")
    tests = benjamini_hochberg(p.withColumn("p", F.round("p", 12)))
    t = t.withColumn("odds", odds).join(tests, "sv_id").join(zones, "sv_id", "left")
    share = lambda g: F.col(f"ab{g}") / F.greatest(F.lit(1), sum((F.col(f"{c}{g}") for c in ("aa", "ab", "bb", "miss")), F.lit(0)))
    fdr, edge, body = F.round("fdr", 9), F.col("zone").isin("left_boundary", "right_boundary"), F.col("zone") == "inversion_body"
    label = (
        F.when(fdr >= 0.10, "uninformative")
        .when(edge & (fdr < 0.05) & (F.col("odds") > 20), "canonical_breakpoint_marker")
        .when((fdr < 0.05) & (F.col("odds") > 5), "dominant_presence_marker")
        .when((fdr < 0.05) & (share(1) > 0.6) & (share(0) < 0.2) & (share(last) < 0.2), "het_specific_marker")
        .when(body & (fdr < 0.05), "sub_haplotype_marker")
        .when(body, "internal_linked_marker")
        .otherwise("uninformative")
    )
    return t.select("sv_id", "zone", *names, "odds", "p", "fdr", label.alias("pattern"))

def evidence_combinations(flags: DataFrame, names: list, top: int = 30) -> DataFrame:
    """The largest groups of samples with one vector of flags; the empty vector is left out."""
    some = flags.where(" or ".join(names))
    return some.groupBy(*names).agg(F.count("*").alias("n"), F.min("sample_id").alias("first")).orderBy(F.desc("n"), "first").limit(top)


def band_composition(labels: DataFrame, samples: DataFrame, attribute: str) -> DataFrame:
    rows = labels.join(samples.select("sample_id", attribute), "sample_id", "left").withColumn(attribute, F.coalesce(F.col(attribute).cast("string"), F.lit("unknown")))
    n = rows.groupBy("k", attribute).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("k")))


def homokaryotype_vs_all(rows: DataFrame) -> DataFrame:
    """Mean of the larger homozygote group (the first on ties) against the mean of all, per candidate."""
    s = rows.groupBy("candidate_id").agg(F.avg("value").alias("all"), *(f(F.when(F.col("k") == k, F.col("value"))).alias(f"{n}{k}") for k in (0, 2) for f, n in ((F.avg, "m"), (F.count, "n"))))
    mode = F.when(F.col("n0") >= F.col("n2"), F.col("m0")).otherwise(F.col("m2"))
    return s.select("candidate_id", mode.alias("mode_mean"), F.col("all").alias("all_mean"), (1 - mode / F.col("all")).alias("fraction_reduction"))


def carrier_by_cluster(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts by ancestry and karyotype with totals by rollup, and shares of the ancestry."""
    rows = calls.join(samples, "sample_id").groupBy("ancestry").pivot("k", [0, 1, 2]).agg(F.count("sample_id")).na.fill(0)
    t = rows.rollup("ancestry").agg(*(F.sum(str(k)).alias(f"n{k}") for k in range(3)))
    total = F.col("n0") + F.col("n1") + F.col("n2")
    return t.select(F.coalesce("ancestry", F.lit("TOTAL")).alias("ancestry"), "n0", "n1", "n2", total.alias("n"), (F.col("n1") / total).alias("het_share"))


def arrangement_maf(calls: DataFrame) -> DataFrame:
    c = calls.groupBy("candidate_id").agg(*(F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(3)))
    p = (2 * F.col("n0") + F.col("n1")) / (2 * (F.col("n0") + F.col("n1") + F.col("n2")))
    return c.select("candidate_id", p.alias("p"), F.least(p, 1 - p).alias("maf"), F.when(p < 0.5, "STD").when(p > 0.5, "INV").otherwise("tie").alias("minor"))


def arrangement_vote(calls: DataFrame, least: float = 0.5) -> DataFrame:
    """Majority of each sample's labels; null on a tie or below the share."""
    n = calls.groupBy("sample_id", "k").agg(F.count("*").alias("n"))
    v = n.groupBy("sample_id").agg(F.max("n").alias("m"), F.sum("n").alias("t"), F.max(F.struct("n", "k")).alias("x"), F.collect_list("n").alias("all"))
    tie = F.size(F.filter("all", lambda c: c == F.col("m"))) > 1
    return v.select("sample_id", F.when(~tie & (F.col("m") / F.col("t") >= least), F.col("x.k")).alias("vote"), (F.col("m") / F.col("t")).alias("share"))


def length_bins(intervals: DataFrame, edges: tuple) -> DataFrame:
    span = F.col("end_bp") - F.col("start_bp")
    b = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        b = F.when(span < edges[i], i).otherwise(b)
    return intervals.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(span).alias("mean_span"))


def proportions(labels: DataFrame) -> DataFrame:
    n = labels.groupBy("k").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # one row per regime


def sigma_profile(track: DataFrame) -> DataFrame:
    return track.groupBy("sample_id").agg(F.stddev_samp("value").alias("sigma"), F.count("value").alias("n")).where("n >= 2")


def family_purity(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """Per window, the mean share of the top family of each band, weighted by samples with a family."""
    rows = labels.join(samples.where("family_id >= 0"), "sample_id").groupBy("w", "k", "family_id").agg(F.count("*").alias("n"))
    band = rows.groupBy("w", "k").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return band.groupBy("w").agg((F.sum("top") / F.sum("n")).alias("purity"), F.sum("n").alias("n"))


def split_half_coherence(track: DataFrame, middle: int, least: int = 5) -> DataFrame:
    """Pearson r between the samples' means before and from the middle window on."""
    first = F.when(F.col("w") < middle, F.col("value"))
    second = F.when(F.col("w") >= middle, F.col("value"))
    s = track.groupBy("sample_id").agg(F.avg(first).alias("x"), F.avg(second).alias("y")).where("x is not null and y is not null")
    r = s.agg(F.corr("x", "y").alias("r"), F.count("*").alias("n")).where(F.col("n") >= least)
    return r.withColumn("coherent", F.col("r") >= 0.60)
