"""Operators on sets of samples, kept as membership rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_jaccard(members: DataFrame) -> DataFrame:
    """(s1, s2, both, jaccard) for sets that share a member; members is (set_id, sample_id)."""
    m = members.distinct()
    size = m.groupBy("set_id").agg(F.count("*").alias("n"))
    pairs = m.withColumnRenamed("set_id", "s1").join(m.withColumnRenamed("set_id", "s2"), "sample_id").where("s1 < s2")
    pairs = pairs.groupBy("s1", "s2").agg(F.count("*").alias("both"))
    for k in ("1", "2"):
        pairs = pairs.join(size.select(F.col("set_id").alias(f"s{k}"), F.col("n").alias(f"n{k}")), f"s{k}")
    return pairs.select("s1", "s2", "both", (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("jaccard"))


def in_every_window(labels: DataFrame, lo: int, hi: int) -> DataFrame:
    """Samples with one band in all windows lo .. hi."""
    rows = labels.where(F.col("w").between(lo, hi)).groupBy("sample_id").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.max("k").alias("top"))
    return rows.where((F.col("n") == hi - lo + 1) & (F.col("k") == F.col("top"))).select("sample_id", "k")


def majority_band(labels: DataFrame, share: float = 0.5) -> DataFrame:
    """Each sample's most frequent band (the lowest on ties), if it has at least the share, rounded up."""
    n = labels.where("k is not null").groupBy("sample_id", "k").agg(F.count("*").alias("n"))
    t = n.groupBy("sample_id").agg(F.sum("n").alias("t"), F.max(F.struct("n", (-F.col("k")).alias("minus_k"))).alias("m"))
    return t.where(F.col("m.n") >= F.ceil(F.col("t") * share)).select("sample_id", (-F.col("m.minus_k")).alias("k"), F.col("m.n").alias("n"))


def macro_band_union(labels: DataFrame, bands: tuple) -> DataFrame:
    return labels.where(F.col("k").isin(*bands)).select("w", "sample_id").distinct()


def peel_stratum(samples: DataFrame, stratum: str) -> DataFrame:
    """All samples but one stratum; those without a stratum are out too."""
    return samples.where(F.col("ancestry") != stratum).select("sample_id", "ancestry")


def hom_anchor_consensus(labels: DataFrame, low: int = 0, high: int = 2, share: float = 0.5) -> DataFrame:
    """Samples in an extreme band in at least the share of their windows; the larger share wins, A on ties."""
    s = labels.groupBy("sample_id").agg(F.avg((F.col("k") == low).cast("double")).alias("a"), F.avg((F.col("k") == high).cast("double")).alias("b"))
    side = F.when((F.col("a") >= share) & (F.col("a") >= F.col("b")), "A").when(F.col("b") >= share, "B")
    return s.select("sample_id", side.alias("anchor")).where("anchor is not null")
