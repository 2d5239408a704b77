"""The regime pipeline: values along windows to bands, quality, transitions and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, clusters, columns, kmeans
from ..storage import stored


def regime_table(track: DataFrame) -> DataFrame:
    """One row per window: bands, silhouette, association with the next window, chain and class.

    Values are packed and bands are worked out and written once; all that follows reads them.
    """
    rows = stored(track.where("value is not null").select("w", "sample_id", "value"))
    p = kmeans.packed(rows, ["w"])
    fit = kmeans.fitted(p, ["w"], (3,))
    bands = stored(kmeans.labelled(rows, fit, ["w"], 3))
    sil = kmeans.scores(p, fit, ["w"], 3).join(fit.select("w", F.col("total").alias("n")), "w").select("w", "silhouette", "n")
    table = stored(aggregates.contingency_table(aggregates.label_pairs(bands.select("w", "sample_id", "k")), ["w"]))
    scores = aggregates.contingency_scores(table, ["w"]).select("w", "v", "ari")
    aligned = clusters.align_labels(table, ["w"])
    chain = clusters.chains(aligned).withColumn("rate", 1 - F.col("concordance"))
    out = sil.join(scores, "w", "left").join(chain, "w", "left")
    return out.withColumn("class", columns.classify_window(F.col("silhouette"), F.col("v"), F.lit(None).cast("double")))
