"""Envelopes, positions, supports, votes and tests of candidates and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_to_envelope(windows: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Envelope of each window (the last of several, -1: none), and its neighbours in the same parent.

    Envelopes (chrom, idx, parent, start_w, end_w) are opened to their windows, so the join is on equal keys.
    """
    by = W.partitionBy("chrom", "parent").orderBy("start_w", "idx")
    e = envelopes.withColumns({"left": F.lag("idx").over(by), "right": F.lead("idx").over(by)})
    e = e.withColumn("w", F.explode(F.sequence("start_w", "end_w"))).groupBy("chrom", "w").agg(F.max(F.struct("idx", "left", "right")).alias("e"))
    out = windows.select("chrom", "w").join(e, ["chrom", "w"], "left")
    return out.select("chrom", "w", F.coalesce("e.idx", F.lit(-1)).alias("envelope"), F.col("e.left").alias("left"), F.col("e.right").alias("right"))


def sorted_rows(rows: DataFrame, column: str, descending: bool, tie: str) -> DataFrame:
    """Empties last both ways, ties by ``tie`` ascending."""
    c = F.col(column)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def catalogue_rows(candidates: DataFrame, text: str, columns: list, equal: dict, sort: str) -> DataFrame:
    """Candidates with equal columns as given and the text in one of the columns, sorted."""
    for name, value in equal.items():
        candidates = candidates.where(F.col(name) == value)
    hit = F.lit(False)
    for name in columns:
        hit |= F.coalesce(F.lower(F.col(name).cast("string")).contains(text.lower()), F.lit(False))
    return sorted_rows(candidates.where(hit), sort, False, "id")


def gini(sizes: Column) -> Column:
    """Gini coefficient of an array of sizes."""
    up = F.array_sort(sizes)
    n, total = F.size(up), F.aggregate(up, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(up, lambda x, i: (2.0 * (i + 1) - n - 1) * x), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, weighted / (n * total)).otherwise(0.0)


def support_score(agreement: Column, windows: Column, sizes: Column, notes: Column) -> Column:
    return 0.4 * agreement + 0.3 * F.least(F.lit(1.0), windows / 20) + 0.2 * (1 - gini(sizes)) + 0.1 * F.when(notes, 0.5).otherwise(1.0)


def regime_position(regimes: DataFrame, chroms: DataFrame, near: float = 5e6, end: float = 2e6, arm_share: float = 0.30) -> DataFrame:
    """Place of each regime on its chromosome; chroms(chrom, length, cen_start, cen_end)."""
    r = regimes.join(chroms, "chrom")
    to_cen = F.greatest(F.lit(0), F.col("cen_start") - F.col("end_bp"), F.col("start_bp") - F.col("cen_end"))
    to_end = F.least(F.col("start_bp"), F.col("length") - F.col("end_bp"))
    arm = F.when((F.col("start_bp") + F.col("end_bp")) / 2 < F.col("cen_start"), F.col("cen_start")).otherwise(F.col("length") - F.col("cen_end"))
    share = (F.col("end_bp") - F.col("start_bp")) / arm
    place = F.when(to_cen == 0, "centromeric").when(to_cen <= near, "pericentromeric").when(to_end <= end, "subtelomeric").when(share >= arm_share, "arm-scale").otherwise("interstitial")
    return r.select("id", place.alias("place"), to_cen.alias("to_centromere"), to_end.alias("to_end"))


def karyotype_rows(labels: DataFrame, samples: DataFrame, tracks: dict) -> DataFrame:
    """Each sample's band in each window, with its family, ancestry and the track of the band."""
    track = F.create_map(*(F.lit(x) for pair in tracks.items() for x in pair))
    return labels.join(samples, "sample_id", "left").select("w", "sample_id", F.col("k").alias("band"), "family_id", "ancestry", track[F.col("k")].alias("track"))


def support_matrix(calls: DataFrame, width: int = 50) -> DataFrame:
    """A string for each sample and block of ``width`` row ids: its dosage at each row id of the block in order, ``.`` where there is none."""
    calls = calls.withColumn("block", F.floor(F.col("candidate_id") / width))
    rows = calls.groupBy("block").agg(F.array_sort(F.collect_set("candidate_id")).alias("ids"))
    held = calls.groupBy("sample_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("candidate_id", F.col("k").cast("string")))).alias("m"))
    return held.join(rows, "block").select("sample_id", "block", F.array_join(F.transform("ids", lambda r: F.coalesce(F.col("m")[r], F.lit("."))), "").alias("support"))


def fisher_exact(tables: DataFrame, by: str) -> DataFrame:
    """Two-sided p of 2x2 tables (a, b, c, d).

    Each possible count's log probability follows from the one before it, so no factorials are
    needed; the smallest margin bounds the rows of a table.  Ties are told apart by 1e-9.
    """
    t = tables.withColumns({"r": F.col("a") + F.col("b"), "s": F.col("a") + F.col("c"), "n": F.col("a") + F.col("b") + F.col("c") + F.col("d")})
    t = t.withColumn("lo", F.greatest(F.lit(0), F.col("r") + F.col("s") - F.col("n")))
    t = t.withColumn("x", F.explode(F.sequence("lo", F.least("r", "s"))))
    step = F.when(F.col("x") == F.col("lo"), 0.0).otherwise(F.log((F.col("r") - F.col("x") + 1) * (F.col("s") - F.col("x") + 1) / (F.col("x") * (F.col("n") - F.col("r") - F.col("s") + F.col("x")))))
    t = t.withColumn("step", step).withColumn("lp", F.sum("step").over(W.partitionBy(by).orderBy("x").rowsBetween(W.unboundedPreceding, 0)))
    one = W.partitionBy(by)
    t = t.withColumns({"top": F.max("lp").over(one), "seen": F.max(F.when(F.col("x") == F.col("a"), F.col("lp"))).over(one)})
    share = F.exp(F.col("lp") - F.col("top"))
    return t.groupBy(by).agg(F.first("a").alias("a"), F.first("n").alias("n"), (F.sum(F.when(F.col("lp") <= F.col("seen") + 1e-9, share)) / F.sum(share)).alias("p"))


def popstats(dosage: DataFrame, one: int, two: int, win: int = 50_000, step: int = 10_000) -> DataFrame:
    """FST (Hudson, ratio of sums), dXY and theta pi of two groups in sliding windows."""
    f = dosage.where(F.col("grp").isin(one, two)).groupBy("pos_bp").agg(
        *(F.avg(F.when(F.col("grp") == g, F.col("dosage"))).alias(f"p{i}") for i, g in enumerate((one, two))),
        *(F.count(F.when(F.col("grp") == g, F.col("dosage"))).alias(f"n{i}") for i, g in enumerate((one, two))),
    )
    f = f.where("n0 > 1 and n1 > 1").withColumns({"p0": F.col("p0") / 2, "p1": F.col("p1") / 2})
    own = lambda i: F.col(f"p{i}") * (1 - F.col(f"p{i}"))
    less = lambda i: own(i) / (2 * F.col(f"n{i}") - 1)
    between = F.col("p0") * (1 - F.col("p1")) + F.col("p1") * (1 - F.col("p0"))
    f = f.select("pos_bp", ((F.col("p0") - F.col("p1")) ** 2 - less(0) - less(1)).alias("num"), between.alias("den"), *((2 * own(i) * 2 * F.col(f"n{i}") / (2 * F.col(f"n{i}") - 1)).alias(f"pi{i}") for i in (0, 1)))
    last = F.floor(F.col("pos_bp") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("pos_bp") - win) / step) + 1)
    f = f.withColumn("start", F.explode(F.transform(F.sequence(first, last), lambda k: k * step)))
    return f.groupBy("start").agg(F.count("*").alias("sites"), (F.sum("num") / F.sum("den")).alias("fst"), (F.sum("den") / win).alias("dxy"), (F.sum("pi0") / win).alias("pi_one"), (F.sum("pi1") / win).alias("pi_two"))


def inner_intervals(rows: DataFrame, by: str, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` consecutive windows, with their mean score."""
    run = F.col("w") - F.row_number().over(W.partitionBy(by).orderBy("w"))
    out = rows.withColumn("run", run).groupBy(by, "run").agg(F.min("w").alias("first_w"), F.max("w").alias("last_w"), F.count("*").alias("n"), F.avg("value").alias("score"))
    return out.where(F.col("n") >= least).drop("run")


def labels_to_votes(labels: DataFrame, visited: float = 0.5, excluded: float = 0.2) -> DataFrame:
    """Bands of each window against those of the other windows they share samples with."""
    size = labels.groupBy("w", "k").agg(F.count("*").alias("size"))
    other = labels.select("sample_id", F.col("w").alias("w2"), F.col("k").alias("k2"))
    both = labels.join(other, "sample_id").where("w <> w2").groupBy("w", "k", "w2", "k2").agg(F.count("*").alias("both"))
    both = both.join(size, ["w", "k"]).join(size.select(F.col("w").alias("w2"), F.col("k").alias("k2"), F.col("size").alias("size2")), ["w2", "k2"])
    j = F.col("both") / (F.col("size") + F.col("size2") - F.col("both"))
    return both.groupBy("w", "k").agg(F.count_if(j >= visited).alias("n_visited"), F.count_if(j <= excluded).alias("n_excluded"))


def dominant_lineage(labels: DataFrame, lineage: Column) -> DataFrame:
    """The largest band of each window (ties: smallest label) and the most frequent lineage inside it."""
    n = labels.withColumn("lineage", lineage).groupBy("w", "k", "lineage").agg(F.count("*").alias("n"))
    band = n.groupBy("w", "k").agg(F.sum("n").alias("size"), F.max(F.struct("n", (-F.col("lineage")).alias("l"))).alias("top"))
    best = band.groupBy("w").agg(F.max(F.struct("size", (-F.col("k")).alias("k"), "top")).alias("b"))
    return best.select("w", (-F.col("b.k")).alias("k"), F.col("b.size").alias("size"), (-F.col("b.top.l")).alias("lineage"))


def architecture_class(labels: DataFrame) -> DataFrame:
    """Switches and returns of each sample along the windows, and the class they make."""
    by = W.partitionBy("sample_id").orderBy("w")
    runs = labels.withColumn("was", F.lag("k").over(by)).where("was is null or was <> k").withColumn("two", F.lag("k", 2).over(by))
    n = runs.groupBy("sample_id").agg((F.count("*") - 1).alias("switches"), F.count_if(F.col("two") == F.col("k")).alias("returns"))
    kind = F.when(F.col("switches") == 0, "stable").when(F.col("returns") >= 2, "nested").when(F.col("returns") == 1, "recombinant_tract").when(F.col("switches") == 1, "two_adjacent").otherwise("complex")
    return n.withColumn("architecture", kind)


def weight_by_support(likelihoods: DataFrame, support: DataFrame, reference: float, power: float = 1.0) -> DataFrame:
    """Likelihoods g0, g1, g2 drawn to 1/3 where a marker's support is small (null: 0); other markers stay."""
    w = F.pow(F.least(F.lit(1.0), F.coalesce("support", F.lit(0)) / reference), F.lit(power))
    rows = likelihoods.join(support.select("marker", w.alias("weight")), "marker", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = rows.withColumns({g: (F.col(g) - 1 / 3) * F.sqrt("weight") + 1 / 3 for g in ("g0", "g1", "g2")})
    total = F.col("g0") + F.col("g1") + F.col("g2")
    return rows.select("marker", "sample_id", *((F.col(g) / total).alias(g) for g in ("g0", "g1", "g2")))
