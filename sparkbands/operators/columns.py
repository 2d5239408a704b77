"""Projections and classes: pure column expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_summary_rows(windows: DataFrame) -> DataFrame:
    span = (F.col("end_bp") - F.col("start_bp")) / 1000
    return windows.select(
        "chrom",
        "w",
        span.alias("span_kb"),
        F.when(span > 0, F.col("n_snps") / span).alias("density"),
        ((F.col("start_bp") + F.col("end_bp")) / 2 / 1e6).alias("mb"),
        F.abs("z").alias("abs_z"),
        F.when(F.col("lam2") > 0, F.col("lam1") / F.col("lam2")).alias("ratio"),
    )


def window_summary_filter(rows: DataFrame, z_min: float = 0.0) -> DataFrame:
    """Rows with |z| of at least z_min; an unknown z fails only if z_min is above 0."""
    return rows.where(F.coalesce(F.col("abs_z") >= z_min, F.lit(z_min <= 0)))


def snp_density_value(windows: DataFrame, names: tuple = ("n_snps", "lam1")) -> DataFrame:
    """The first finite of the named columns, and which one it is."""
    finite = [F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf")), F.col(c).cast("double")) for c in names]
    source = F.coalesce(*(F.when(x.isNotNull(), F.lit(c)) for x, c in zip(finite, names)))
    return windows.select("chrom", "w", F.coalesce(*finite).alias("density"), source.alias("source"))


def regime_call_from_mean(mean: Column) -> Column:
    call = F.when(mean <= 0.4, "homA_like").when(mean.between(0.6, 1.4), "het_like").when(mean >= 1.6, "homB_like")
    return call.otherwise("uncertain")


def margin_confidence(mean: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(F.abs(mean - 0.5), F.abs(mean - 1.5)) / 0.5))


def classify_dosage_mean(mean: Column, n: Column, least: int = 5) -> Column:
    call = F.when(n == 0, "NO_SAMPLES").when(n < least, "AMBIGUOUS_DOSAGE").when(mean <= 0.3, "HOM_REF")
    return call.when(mean.between(0.7, 1.3), "HET").when(mean >= 1.7, "HOM_INV").otherwise("AMBIGUOUS_DOSAGE")


def classify_window(quality: Column, v: Column, h_off: Column) -> Column:
    call = F.when(F.coalesce(quality < 0.40, F.lit(True)) | v.isNull(), "UNRELIABLE").when(v >= 0.70, "INTERIOR").when(v < 0.40, "REGIME_END")
    return call.when(h_off.isNull() | (h_off <= 0.40), "CROSSOVER").otherwise("REGIME_END")


def persistence_bucket(span_bp: Column) -> Column:
    return F.when(span_bp < 2e6, "local").when(span_bp < 1e7, "regional").when(span_bp < 5e7, "long_range").otherwise("chromosome_scale")


def regime_confidence(v: Column, support: Column, n_windows: Column, n_samples: Column) -> Column:
    by_w = F.least(F.lit(1.0), F.log(1 + n_windows) / F.log(F.lit(51.0)))
    by_s = F.least(F.lit(1.0), F.sqrt(n_samples) / 10)
    return (0.45 * v + 0.45 * support + 0.10) * (0.5 + 0.5 * by_w) * (0.5 + 0.5 * by_s)


def steady_mean(c: Column | str) -> Column:
    """The mean, whatever the order of rows: values are added up as decimals of 15 places, so equal means are equal and limits are met.

    Sums of doubles differ in their last digits from one order to the next.
    Values that are no finite number, or too large, are averaged as doubles.
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    d = c.try_cast("decimal(38,15)")
    return F.coalesce(F.when(F.count(d) == F.count(c), F.try_divide(F.try_sum(d), F.count(d)).cast("double")), F.avg(c))


def _letters(n: Column) -> Column:
    """A .. Z, AA .. ZZ for 0, 1, ..., and on with the characters after Z as the first one (char() would begin again at 256)."""
    ch = lambda k: F.decode(F.unhex(F.lpad(F.hex((k + 65).cast("long")), 8, "0")), "UTF-32")
    return F.when(n < 26, ch(n)).otherwise(F.concat(ch(F.floor(n / 26) - 1), ch(n % 26)))


def candidate_display_names(candidates: DataFrame, unit: float = 1e6) -> DataFrame:
    """chrom.<start>-<end>Mb.<letter>, lettered by start, end and id among those with the same bounds in whole Mb."""
    a, b = (F.floor(F.col(c) / unit).cast("long") for c in ("start_bp", "end_bp"))
    n = F.row_number().over(W.partitionBy("chrom", a, b).orderBy("start_bp", "end_bp", "id")) - 1
    name = F.concat_ws("", "chrom", F.lit("."), a.cast("string"), F.lit("-"), b.cast("string"), F.lit("Mb."), _letters(n))
    return candidates.select("id", name.alias("name"))


KARYOTYPES = ("H1/H1", "H1/H2", "H2/H2")


def regime_groups_from_calls(calls: DataFrame) -> DataFrame:
    """Named groups of samples for each candidate, with their sizes; unknown calls are counted."""
    name = F.when(F.col("k").between(0, 2), F.element_at(F.array(*map(F.lit, KARYOTYPES)), F.col("k") + 1)).otherwise("dropped_unknown")
    return calls.groupBy("candidate_id", name.alias("grp")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("sample_id")).alias("members"))


def karyotype_export(calls: DataFrame) -> DataFrame:
    code = F.when(F.col("k") == 0, "0/0").when(F.col("k") == 1, "0/1").when(F.col("k") == 2, "1/1").otherwise("NA")
    rows = calls.where(F.col("sample_id").isNotNull())
    return rows.select(F.upper(F.concat(F.lit("s"), F.col("sample_id").cast("string"))).alias("sample_id"), F.col("candidate_id").alias("inversion_id"), code.alias("karyotype"), F.when(code == "NA", "low").otherwise("high").alias("quality"))


def pangenome_class(shares: DataFrame) -> DataFrame:
    """(candidate_id, class) from (candidate_id, n, freq) for each population."""
    known = shares.groupBy("candidate_id").agg(F.count_if(F.col("n") >= 5).alias("pops"), F.count_if((F.col("n") >= 5) & (F.col("freq") >= 0.05)).alias("carriers"), F.count_if((F.col("n") >= 5) & (F.col("freq") >= 0.5)).alias("most"))
    share, high = F.col("carriers") / F.col("pops"), F.col("most") / F.col("pops")
    label = F.when(F.col("pops") == 0, "unknown").when((share >= 0.85) & (high >= 0.85), "general").when(share <= 0.2, "private").otherwise("co_shared")
    return known.select("candidate_id", label.alias("pangenome_class"))
