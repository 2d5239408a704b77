"""Operators along ordered windows: running sums, smoothing, runs, transitions, ordered selections.

Windows are partitioned by sample or chromosome and ordered by window number, so
a partition is as long as a chromosome has windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cusum(track: DataFrame) -> DataFrame:
    """Running sum of each sample's deviations from the cohort mean of the window; a missing value adds nothing."""
    mean = track.groupBy("w").agg(F.avg("value").alias("m"))
    d = track.join(mean, "w").withColumn("d", F.coalesce(F.col("value") - F.col("m"), F.lit(0.0)))
    return d.select("w", "sample_id", F.sum("d").over(W.partitionBy("sample_id").orderBy("w").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("cusum"))


def cusum_by_group(sums: DataFrame, groups: DataFrame) -> DataFrame:
    return sums.join(groups, "sample_id").groupBy("grp", "w").agg(F.avg("cusum").alias("mean"), F.median("cusum").alias("median"))


def rolling_median(track: DataFrame, width: int = 3) -> DataFrame:
    """Lower median of a centred run of rows, cut at the edges."""
    half = width // 2
    around = W.partitionBy("sample_id").orderBy("w").rowsBetween(-half, half)
    rows = track.withColumn("near", F.array_sort(F.collect_list("value").over(around)))
    return rows.select("w", "sample_id", F.element_at("near", (F.floor((F.size("near") - 1) / 2) + 1).cast("int")).alias("median"))


def moving_mean(track: DataFrame, width: int = 3) -> DataFrame:
    half = width // 2
    return track.select("w", "sample_id", F.avg("value").over(W.partitionBy("sample_id").orderBy("w").rowsBetween(-half, half)).alias("mean"))


def run_length_encode(labels: DataFrame) -> DataFrame:
    """(sample_id, k, start, length) of the runs of equal labels along each sample's windows."""
    by = W.partitionBy("sample_id").orderBy("w")
    rows = labels.withColumn("new", (~F.col("k").eqNullSafe(F.lag("k").over(by))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy("sample_id", "run").agg(F.max("k").alias("k"), F.min("w").alias("start"), F.count("*").alias("length")).drop("run")


def return_switches(runs: DataFrame, least: int = 2) -> DataFrame:
    """Per sample: runs A, B, A with B at least ``least`` long, and the other changes."""
    by = W.partitionBy("sample_id").orderBy("start")
    r = runs.withColumns({"before": F.lag("k").over(by), "after": F.lead("k").over(by)})
    back = (F.col("before") == F.col("after")) & (F.col("length") >= least)
    s = r.groupBy("sample_id").agg(F.count_if(back).alias("returns"), (F.count("*") - 1).alias("switches"))
    kind = F.when(F.col("switches") == 0, "stable").when(F.col("returns") >= 2, "nested").when(F.col("returns") == 1, "recombinant_tract").when(F.col("switches") == 1, "two_adjacent").otherwise("complex")
    return s.withColumn("architecture", kind)


def first_seen_ids(labels: DataFrame) -> DataFrame:
    """Signatures numbered from 1 in order of their first window; ties by the signature."""
    first = labels.groupBy("signature").agg(F.min("w").alias("first"), F.count("*").alias("n"))
    return first.withColumn("id", F.row_number().over(W.orderBy("first", "signature")))  # one row per signature


def signatures(track: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of each window in descending order of their mean, as one text; ties by group."""
    m = track.join(groups, "sample_id").groupBy("w", "grp").agg(F.avg("value").alias("m"))
    s = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "grp")))
    return m.groupBy("w").agg(F.concat_ws(">", F.transform(s, lambda x: x["grp"].cast("string"))).alias("signature"))


def adjacent_transition_rate(alignment: DataFrame, hot: float = 0.30, least: int = 5, keys: tuple = ()) -> DataFrame:
    """Share of samples whose label differs from a window to the next once the two are aligned."""
    t = alignment.where(F.col("n") >= least).select(*keys, "w", "n", (1 - F.col("concordance")).alias("rate"))
    return t.withColumn("hotspot", F.col("rate") >= hot)


def merge_runs(verdicts: DataFrame, keys: tuple = ()) -> DataFrame:
    """Neighbouring windows of a chromosome (``keys``) chained over MERGE verdicts: (start, end, length)."""
    by = W.partitionBy(*keys).orderBy("w")  # one row per pair of windows of one chromosome
    v = verdicts.withColumn("cut", (F.col("verdict") != "MERGE").cast("int")).withColumn("run", F.sum("cut").over(by))
    merged = v.where("verdict = 'MERGE'").groupBy(*keys, "run").agg(F.min("w").alias("start"), (F.max("w") + 1).alias("end"))
    return merged.select(*keys, "start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def outliers(windows: DataFrame, z: float = 2.0, share: float = 0.01, mean: str = "lam2") -> DataFrame:
    """Windows with |z| at the limit; where a chromosome has none, its top share (one at least) by the size of its mean."""
    per = windows.groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(F.abs("z") >= z).alias("hits"))
    rank = F.row_number().over(W.partitionBy("chrom").orderBy(F.desc(F.abs(mean)), "w"))
    rows = windows.join(per, "chrom").withColumn("r", rank)
    return rows.where(F.when(F.col("hits") > 0, F.abs("z") >= z).otherwise(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)))).select("chrom", "w", "z")


def entropy_regimes(labels: DataFrame, classes: int = 3) -> DataFrame:
    """Band shares' entropy per window: co_seg up to 0.40, fanned from 0.85, sparse under 3 samples."""
    n = labels.groupBy("w", "k").agg(F.count("*").alias("n"))
    n = n.withColumn("t", F.sum("n").over(W.partitionBy("w")))
    h = n.groupBy("w").agg(F.max("t").alias("n"), (-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))) / F.log(F.lit(float(classes)))).alias("entropy"))
    return h.withColumn("regime", F.when(F.col("n") < 3, "sparse").when(F.col("entropy") <= 0.40, "co_seg").when(F.col("entropy") >= 0.85, "fanned").otherwise("partial"))


def spread_runs(track: DataFrame, factor: float = 1.1, least: int = 1, keys: tuple = ()) -> DataFrame:
    """Runs of windows of a chromosome (``keys``) whose spread over samples is above ``factor`` times the lower quartile of all spreads."""
    sd = track.groupBy(*keys, "w").agg(F.stddev_samp("value").alias("sd"))
    cut = sd.agg(F.expr("percentile(sd, 0.25)")).first()[0]
    wide = sd.where(F.col("sd") > factor * (cut or 0.0)).withColumn("run", F.col("w") - F.row_number().over(W.partitionBy(*keys).orderBy("w")))
    return wide.groupBy(*keys, "run").agg(F.min("w").alias("start"), F.max("w").alias("end"), F.count("*").alias("length")).where(F.col("length") >= least).drop("run")


def top_markers(variances: DataFrame, n: int) -> DataFrame:
    return variances.orderBy(F.desc("variance"), "marker").limit(n)


def thin_positions(points: DataFrame, target: int) -> DataFrame:
    """The position nearest to each of ``target`` even places along each chromosome; the smaller on ties.

    Each place looks for its neighbours by an as-of step both ways over the
    distinct positions, and both ways are aggregates.
    """
    p = points.select("chrom", "pos_bp").distinct()
    ends = p.groupBy("chrom").agg(F.min("pos_bp").alias("lo"), F.max("pos_bp").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / target
    cell = lambda x: F.floor((x - F.col("lo")) / F.greatest(step, F.lit(1e-9)))
    known = p.join(ends, "chrom").withColumn("cell", F.least(cell(F.col("pos_bp")), F.lit(target - 1)))
    per = known.groupBy("chrom", "cell").agg(F.min("pos_bp").alias("first"), F.max("pos_bp").alias("last"), F.min(F.struct(F.abs(F.col("pos_bp") - (F.col("lo") + step * (F.col("cell") + 0.5))).alias("d"), "pos_bp")).alias("best"))
    ideal = ends.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(target - 1).cast("long")))).withColumn("x", F.col("lo") + step * (F.col("cell") + 0.5))
    by = W.partitionBy("chrom").orderBy("cell")
    near = ideal.join(per, ["chrom", "cell"], "left").withColumns({"left": F.last("last", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)), "right": F.first("first", ignorenulls=True).over(by.rowsBetween(1, W.unboundedFollowing))})
    d = lambda c: F.when(c.isNotNull(), F.struct(F.abs(c - F.col("x")).alias("d"), c.alias("pos_bp")))
    return near.select("chrom", F.least("best", d(F.col("left")), d(F.col("right")))["pos_bp"].alias("pos_bp")).distinct()
