"""Label alignment, seeded one-dimensional k-means, reach, components of windows."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored
from . import kmeans
from .matrix import label_matches


def align_labels(table: DataFrame, by: list, classes: int = 3) -> DataFrame:
    """Best relabelling of b onto a for each table (columns a, b, n): the largest diagonal, the first permutation on ties."""
    perms = [(i, a, b) for i, p in enumerate(permutations(range(classes))) for a, b in enumerate(p)]
    spark = table.sparkSession
    lookup = spark.createDataFrame(perms, "perm int, a int, b int")  # classes! * classes rows
    total = table.groupBy(*by).agg(F.sum("n").alias("t"))
    d = table.join(F.broadcast(lookup), ["a", "b"]).groupBy(*by, "perm").agg(F.sum("n").alias("diag"))
    best = d.groupBy(*by).agg(F.max(F.struct("diag", (-F.col("perm")).alias("minus"))).alias("m"))
    return best.join(total, by).select(*by, (-F.col("m.minus")).alias("perm"), F.col("m.diag").alias("diagonal"), F.col("t").alias("n"), (F.col("m.diag") / F.col("t")).alias("concordance"))


def chains(alignment: DataFrame, least: float = 0.50, keys: tuple = ()) -> DataFrame:
    """Chain number of each window: a new one where the concordance with the window before is below the limit; ``keys`` name the chromosome."""
    by = W.partitionBy(*keys).orderBy("w")  # one row per window of a chromosome
    cut = alignment.withColumn("cut", (F.col("concordance") < least).cast("int"))
    return cut.select(*keys, "w", F.sum("cut").over(by).alias("chain"), "concordance")


def band_reach(labels: DataFrame, narrow: int = 2) -> DataFrame:
    reach = labels.where("k >= 0").groupBy("sample_id").agg(F.countDistinct("k").alias("reach"))
    return reach.groupBy("reach").agg(F.count("*").alias("n_samples")).withColumn("narrow", F.col("reach") <= narrow)


def kmeans_1d(track: DataFrame, k: int = 3, rounds: int = 12, by: str = "w") -> DataFrame:
    """Labels 0 .. k-1 by centre within each window (or other key); seeds at floor((i + 0.5) / k * n), values halfway go to the lower centre."""
    rows = stored(track.where("value is not null").select(by, "sample_id", "value"))
    fit = kmeans.fitted(kmeans.packed(rows, [by]), [by], (k,), rounds)
    return kmeans.labelled(rows, fit, [by], k).select(by, "sample_id", "k", "value")


def silhouette_1d(rows: DataFrame) -> DataFrame:
    """Mean silhouette of (w, k, value) per window, by sums over sorted values instead of pairs.

    The sum of |x - y| over a band is rank-weighted: with the number and the sum
    of values below x in each band, it needs no pair table.
    """
    band = rows.groupBy("w", "k").agg(F.count("*").alias("m"), F.sum("value").alias("s"))
    x = rows.select("w", "sample_id", "k", "value").join(band.withColumnsRenamed({"k": "kb"}), "w")
    below = W.partitionBy("w", "kb").orderBy("value", "sample_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = (F.col("k") == F.col("kb")).cast("long")
    x = x.withColumns({"nb": F.sum(own).over(below), "sb": F.sum(own * F.col("value")).over(below)})
    total = F.col("value") * F.col("nb") - F.col("sb") + (F.col("s") - F.col("sb")) - F.col("value") * (F.col("m") - F.col("nb"))
    x = x.withColumn("d", F.when(own == 1, F.when(F.col("m") > 1, total / (F.col("m") - 1))).otherwise(total / F.col("m")))
    p = x.groupBy("w", "sample_id", "k").agg(F.max(F.when(own == 1, F.col("d"))).alias("a"), F.min(F.when(own == 0, F.col("d"))).alias("b"))
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return p.where("a is not null and b is not null").groupBy("w").agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))


def coassociation(labels: DataFrame, least: int = 2) -> DataFrame:
    """Per pair of samples of a family: windows with one band over windows with both; labels is (w, sample_id, k, family_id)."""
    p = label_matches(labels, "family_id")
    return p.where(F.col("total") >= least).withColumn("affinity", F.col("together") / F.col("total"))
