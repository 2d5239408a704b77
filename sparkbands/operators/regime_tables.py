"""Tables of regimes: how windows agree with a locus's first one, what is called for each sample, and a summary of each locus.

Loci are rows (chrom, locus, s, e) of window numbers, bounds included; labels are
(chrom, w, sample_id, k), bitmaps those of ``votes.band_bits``.  The labels of the
first window are a locus's reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import votes
from .columns import regime_confidence


def _pairs(loci: DataFrame) -> DataFrame:
    return loci.select("chrom", "locus", F.col("s").alias("w1"), F.explode(F.sequence("s", "e")).alias("w2"))


def window_support(loci: DataFrame, bits: DataFrame, classes: int, agree: float = 0.6, v: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """(chrom, locus, w, n, agreement, v, supported) of each window against the locus's first, aligned; and (chrom, locus, w, a, b), which label b there is reference label a."""
    pairs = _pairs(loci)
    table = votes.stored(votes.pair_table(bits, pairs.select("chrom", "w1", "w2").distinct()))
    by = ["chrom", "w1", "w2"]
    best = votes.best_permutation(table, by, classes)
    signals = votes.anchor_signals(table, classes, least=4).select(*by, "v")
    rows = best.join(signals, by).withColumn("agreement", F.col("diagonal") / F.col("n"))
    ok = (F.round("agreement", 9) >= agree) & (F.round("v", 9) >= v)
    rows = pairs.join(rows, by).select("chrom", "locus", F.col("w2").alias("w"), "n", "agreement", "v", F.coalesce(ok, F.lit(False)).alias("supported"))
    turn = pairs.join(best, by).join(F.broadcast(votes._ways(table.sparkSession, classes)), "perm")
    return rows, turn.select("chrom", "locus", F.col("w2").alias("w"), "a", "b")


def reference(loci: DataFrame, labels: DataFrame, dosage: DataFrame) -> DataFrame:
    """(chrom, locus, sample_id, band, dosage): labels of the first window, with the sample's mean dosage over the locus; dosage is (chrom, w, sample_id, dosage)."""
    inside = _pairs(loci).select("chrom", "locus", F.col("w2").alias("w"))
    mean = dosage.join(inside, ["chrom", "w"]).groupBy("chrom", "locus", "sample_id").agg(F.avg("dosage").alias("dosage"))
    own = labels.where("k >= 0").join(loci.select("chrom", "locus", F.col("s").alias("w")), ["chrom", "w"])
    return own.select("chrom", "locus", "sample_id", F.col("k").alias("band")).join(mean, ["chrom", "locus", "sample_id"], "left")


def _tier(d: Column, names: tuple) -> Column:
    return F.when(d <= 0.4, names[0]).when(d.between(0.6, 1.4), names[1]).when(d >= 1.6, names[2])


def sample_calls(ref: DataFrame, labels: DataFrame, turns: DataFrame, least: float = 0.5) -> DataFrame:
    """Per locus and sample of reference(): the share of windows that agree with its reference band, and its call by the band's mean dosage.

    Up to 0.4 homA_like, 0.6 to 1.4 het_like, from 1.6 on homB_like; uncertain
    between these and where the share is under ``least``.  The confidence is the
    share, halved for an uncertain call.
    """
    keys = ["chrom", "locus", "sample_id"]
    rows = labels.where("k >= 0").join(turns.withColumnRenamed("b", "k"), ["chrom", "w", "k"]).join(ref.select(*keys, "band"), keys)
    seen = rows.groupBy(*keys).agg(F.avg((F.col("a") == F.col("band")).cast("double")).alias("share"))
    mean = ref.groupBy("chrom", "locus", "band").agg(F.round(F.avg("dosage"), 9).alias("band_dosage"))
    t = ref.join(mean, ["chrom", "locus", "band"]).join(seen, keys, "left")
    tier = _tier(F.col("band_dosage"), ("homA_like", "het_like", "homB_like"))
    weak = F.coalesce(F.round("share", 9) < least, F.lit(False))
    call = F.when(weak, "uncertain").otherwise(F.coalesce(tier, F.lit("uncertain")))
    notes = F.array_join(F.array(F.when(F.col("band_dosage").isNull(), "no_band_dosage").when(tier.isNull(), "band_dosage_between_tiers"), F.when(weak, "low_support_fraction")), ",")
    return t.select(*keys, "band", call.alias("call"), "share", (F.col("share") * F.when(call == "uncertain", 0.5).otherwise(1.0)).alias("confidence"), notes.alias("notes"))


def locus_summary(loci: DataFrame, support: DataFrame, ref: DataFrame, neighbours: DataFrame, classes: int) -> DataFrame:
    """One row for each locus: windows and their support, V of neighbours, bands, calls by dosage, class, confidence and support score.

    ``neighbours`` is (chrom, w1, w2, n, v, agreement) of windows that follow one another.
    """
    keys = ["chrom", "locus"]
    w = support.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.count_if("supported").alias("n_supported"), F.avg("agreement").alias("agreement"))
    steps = neighbours.where((F.col("n") >= 4) & F.col("v").isNotNull()).join(loci.select(*keys, "s", "e"), "chrom").where("w1 >= s and w2 <= e")
    v = steps.groupBy(*keys).agg(F.avg("v").alias("mean_v"), F.avg("agreement").alias("pair_agreement"), F.count("*").alias("n_pairs"))
    band = ref.groupBy(*keys, "band").agg(F.count("*").alias("n"), F.round(F.avg("dosage"), 9).alias("d"))
    by = W.partitionBy(*keys).orderBy("n")  # a few bands
    band = band.withColumns({"i": F.row_number().over(by), "m": F.count("*").over(W.partitionBy(*keys))})
    pattern = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "band"))), lambda x: F.concat_ws("=", x["band"].cast("string"), (-x["minus"]).cast("string"))), "|")
    gini = F.sum((2 * F.col("i") - F.col("m") - 1) * F.col("n")) / (F.max("m") * F.sum("n"))
    b = band.groupBy(*keys).agg(F.sum("n").alias("n_samples"), F.count("*").alias("n_bands"), F.count_if(F.col("n") >= 2).alias("active"), F.max(F.coalesce(F.col("d").between(0.6, 1.4), F.lit(False))).alias("het"), pattern.alias("pattern"), (1 - gini).alias("balance"))
    tier = _tier(F.round("dosage", 9), ("a", "h", "b"))
    c = ref.groupBy(*keys).agg(*(F.count_if(tier == x).alias(n) for x, n in (("a", "n_hom_a"), ("h", "n_het"), ("b", "n_hom_b"))))
    t = loci.join(w, keys).join(v, keys, "left").join(b, keys).join(c, keys).fillna(0, ["n_pairs"])
    share = F.col("n_supported") / F.col("n_windows")
    mean = F.round("mean_v", 9)
    poor = mean.isNull() | (F.col("n_windows") < 4) | (F.col("n_pairs") < 2) | (F.col("n_samples") < 8)
    kind = (
        F.when(poor, "low_confidence_regime")
        .when(mean < 0.25, "diffuse_regime")
        .when((mean >= 0.5) & (share < 0.5), "split_regime")
        .when((mean >= 0.5) & (F.col("active") >= 3) & (F.col("n_bands") >= 4), "nested_multiband_regime")
        .when((mean >= 0.5) & (F.col("n_bands") == 3) & F.col("het") & (F.col("active") == 3), "stable_three_band_regime")
        .when(mean >= 0.5, "stable_two_band_regime")
        .otherwise("low_confidence_regime")
    )
    rest = F.greatest(F.lit(0), F.col("n_samples") - F.col("n_hom_a") - F.col("n_het") - F.col("n_hom_b"))
    notes = F.array_join(F.array(F.when(F.col("n_windows") < 5, "few_windows"), F.when(F.col("n_pairs") < 4, "few_pairs"), F.when(F.col("n_samples") < 8, "few_samples"), F.when(rest > 0, F.concat(F.lit("uncertain="), rest.cast("string")))), ",")
    t = t.withColumns({"support": share, "class": kind, "n_uncertain": rest, "notes": notes})
    conf = regime_confidence(F.coalesce("mean_v", F.lit(0.0)), F.col("support"), F.col("n_windows"), F.col("n_samples"))
    score = 0.4 * F.coalesce("agreement", F.lit(0.0)) + 0.3 * F.least(F.lit(1.0), F.col("n_supported") / 20) + 0.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "balance")) + 0.1 * F.when(F.col("notes") == "", 1.0).otherwise(0.5)
    return t.select(*keys, "s", "e", "n_samples", "n_bands", "active", "pattern", "n_windows", "n_supported", "agreement", "mean_v", "pair_agreement", "n_pairs", "het", "n_hom_a", "n_het", "n_hom_b", "n_uncertain", "class", F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"), score.alias("support_score"), "notes")
