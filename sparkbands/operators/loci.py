"""Genotypes at loci: compatibility of relatives, alleles and their pairs, rules over evidence, links of sample sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Smallest kinship of relatives of the first and of the second degree (fixed values).
FIRST, SECOND = 0.177, 0.0884


def genotype_compat_dyads(kin: DataFrame, calls: DataFrame, first: float = FIRST) -> DataFrame:
    """Per pair of first-degree relatives: loci where both are called, those where they are opposite homozygotes, and the rate.

    Calls are 0, 1 and 2; null calls are not informative.
    """
    x = kin.where(F.col("kinship") >= first).select("a", "b")
    x = x.join(calls.select(F.col("sample_id").alias("a"), "candidate_id", F.col("k").alias("ka")), "a")
    x = x.join(calls.select(F.col("sample_id").alias("b"), "candidate_id", F.col("k").alias("kb")), ["b", "candidate_id"]).where("ka is not null and kb is not null")
    out = x.groupBy("a", "b").agg(F.count("*").alias("n_informative"), F.count_if(F.abs(F.col("ka") - F.col("kb")) == 2).alias("n_contradictions"))
    return out.withColumn("rate", F.col("n_contradictions") / F.col("n_informative")).withColumn("compatible", F.col("n_contradictions") == 0)


def allowed(p: Column, q: Column, child: Column) -> Column:
    """1 if parents with p and q copies can have the child, -1 if not, 0 if both are heterozygous and any child is possible."""
    low = (p == 2).cast("int") + (q == 2).cast("int")
    high = (p > 0).cast("int") + (q > 0).cast("int")
    return F.when((p == 1) & (q == 1), 0).when(child.between(low, high), 1).otherwise(-1)


def genotype_compat_trios(kin: DataFrame, calls: DataFrame, first: float = FIRST) -> DataFrame:
    """Per child and two of its first-degree relatives a < b as parents: informative loci, and those that contradict."""
    near = kin.where(F.col("kinship") >= first)
    edge = near.select(F.col("a").alias("child"), F.col("b").alias("p")).unionByName(near.select(F.col("b").alias("child"), F.col("a").alias("p")))
    called = calls.where("k is not null")
    # a parent meets the child at the loci where both are called before parents meet each other
    both = edge.join(called.select(F.col("sample_id").alias("child"), "candidate_id", F.col("k").alias("kc")), "child")
    both = both.join(called.select(F.col("sample_id").alias("p"), "candidate_id", F.col("k").alias("kp")), ["p", "candidate_id"])
    other = both.select("child", "candidate_id", F.col("p").alias("q"), F.col("kp").alias("kq"))
    t = both.join(other, ["child", "candidate_id"]).where("p < q").withColumn("s", allowed(F.col("kp"), F.col("kq"), F.col("kc")))
    return t.groupBy("child", "p", "q").agg(F.count("*").alias("n_tested"), F.count_if(F.col("s") != 0).alias("n_informative"), F.count_if(F.col("s") < 0).alias("n_contradictions"))


def dyad_direction(kin: DataFrame, calls: DataFrame, first: float = FIRST, second: float = SECOND, least: int = 5, confidence: float = 0.6) -> DataFrame:
    """Which of two first-degree relatives can be the other's parent, by the third samples related to both, locus by locus."""
    edge = kin.select("a", "b", "kinship").unionByName(kin.select(F.col("b").alias("a"), F.col("a").alias("b"), "kinship"))
    pair = kin.where(F.col("kinship") >= first).select("a", "b")
    c = pair.join(edge.where(F.col("kinship") >= first).select("a", F.col("b").alias("c")), "a").where("c <> b")
    c = c.join(edge.where(F.col("kinship") >= second).select("b", F.col("a").alias("c")), ["b", "c"])
    called = calls.where("k is not null")
    for s in ("a", "b", "c"):
        on = [s] if s == "a" else [s, "candidate_id"]
        c = c.join(called.select(F.col("sample_id").alias(s), "candidate_id", F.col("k").alias("k" + s)), on)
    c = c.withColumns({"sa": allowed(F.col("ka"), F.col("kc"), F.col("kb")), "sb": allowed(F.col("kb"), F.col("kc"), F.col("ka"))})
    t = c.groupBy("a", "b").agg(F.sum("sa").alias("total_a"), F.sum("sb").alias("total_b"), F.count_if((F.col("sa") != 0) | (F.col("sb") != 0)).alias("n_informative"))
    total = F.abs("total_a") + F.abs("total_b")
    t = t.withColumn("confidence", F.when(total > 0, F.abs(F.col("total_a") - F.col("total_b")) / total).otherwise(0.0))
    says = F.when(F.col("n_informative") < least, "UNDIRECTED").when((F.col("total_a") < 0) & (F.col("total_b") < 0), "INCOMPATIBLE")
    return t.withColumn("direction", says.when(F.col("confidence") < confidence, "UNDIRECTED").when(F.col("total_a") > F.col("total_b"), "A_TO_B").otherwise("B_TO_A"))


def allele_roles(counts: DataFrame, least: int = 1) -> DataFrame:
    """(chrom, pos_bp, allele, total, n_samples, rank): alleles of a site by reads over all samples, ties in the order A, C, G, T."""
    per = counts.where("reads > 0").groupBy("chrom", "pos_bp", "allele").agg(F.sum("reads").alias("total"), F.countDistinct("sample_id").alias("n_samples")).where(F.col("total") >= least)
    site = W.partitionBy("chrom", "pos_bp")  # four alleles at most
    rows = per.withColumns({"rank": F.row_number().over(site.orderBy(F.desc("total"), "allele")), "n_alleles": F.count("*").over(site)})
    return rows.where("n_alleles >= 2")


def allele_pairs(counts: DataFrame, least: int = 1) -> DataFrame:
    """A row for each pair of a site's alleles, by rank: roles, reads, shares, and the samples with either or both."""
    roles = allele_roles(counts, least)
    role = lambda r: F.when(r == 1, "MAJOR").otherwise(F.concat(F.lit("MINOR"), (r - 1).cast("string")))
    side = lambda s: roles.select("chrom", "pos_bp", *(F.col(c).alias(f"{c}_{s}") for c in ("allele", "total", "n_samples", "rank")), *(["n_alleles"] if s == "a" else []))
    pairs = side("a").join(side("b"), ["chrom", "pos_bp"]).where("rank_a < rank_b")
    site = roles.groupBy("chrom", "pos_bp").agg(F.sum("total").alias("site_total"))
    has = counts.where("reads > 0").groupBy("chrom", "pos_bp", "sample_id").agg(F.collect_set("allele").alias("has"))
    either = pairs.select("chrom", "pos_bp", "allele_a", "allele_b").join(has, ["chrom", "pos_bp"]).where("array_contains(has, allele_a) or array_contains(has, allele_b)")
    either = either.groupBy("chrom", "pos_bp", "allele_a", "allele_b").agg(F.count("*").alias("n_samples_either"))
    out = pairs.join(site, ["chrom", "pos_bp"]).join(either, ["chrom", "pos_bp", "allele_a", "allele_b"])
    count, small = F.col("total_a") + F.col("total_b"), F.least("total_a", "total_b")
    out = out.withColumns({"role_a": role(F.col("rank_a")), "role_b": role(F.col("rank_b")), "pair_count": count, "min_pair_allele_count": small, "pair_fraction": count / F.col("site_total"), "maf_pair": small / count})
    marker = F.concat_ws("_", "chrom", "pos_bp", "role_a", "role_b", "allele_a", "allele_b")
    kept = ("chrom", "pos_bp", "role_a", "role_b", "pair_count", "min_pair_allele_count", "pair_fraction", "maf_pair", "n_samples_a", "n_samples_b", "n_samples_either", "n_alleles")
    return out.select(marker.alias("marker"), *kept)


def filter_allele_pairs(pairs: DataFrame, roles: list, least_fraction: float, least_count: int, least_maf: float, least_samples: int, most_alleles: int = 4) -> DataFrame:
    """The pairs that meet every bound."""
    ok = F.concat_ws("_", "role_a", "role_b").isin(roles) & (F.col("pair_fraction") >= least_fraction) & (F.col("min_pair_allele_count") >= least_count)
    return pairs.where(ok & (F.col("maf_pair") >= least_maf) & (F.least("n_samples_a", "n_samples_b") >= least_samples) & F.col("n_alleles").between(2, most_alleles))


def rare_pair_windows(pairs: DataFrame, width: int, step: int, carriers: tuple = (4, 30), least_reads: int = 6, least_pairs: int = 5) -> DataFrame:
    """Half-open windows from 0 by ``step`` with at least ``least_pairs`` rare pairs, and the merged stretch of each."""
    rare = pairs.where(F.col("role_b").isin("MINOR2", "MINOR3") & (F.col("role_a") == "MAJOR") & F.col("n_samples_b").between(*carriers) & (F.col("min_pair_allele_count") >= least_reads))
    last = F.floor(F.col("pos_bp") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("pos_bp") - width) / step) + 1)
    per = rare.withColumn("i", F.explode(F.sequence(first, last))).groupBy("chrom", (F.col("i") * step).alias("start_bp"))
    per = per.agg(F.count("*").alias("n_pairs"), F.countDistinct("pos_bp").alias("n_sites"), F.median("n_samples_b").alias("median_carriers"), F.median("min_pair_allele_count").alias("median_reads"))
    per = per.where(F.col("n_pairs") >= least_pairs).withColumn("end_bp", F.col("start_bp") + width)
    by = W.partitionBy("chrom").orderBy("start_bp")  # windows that are left, not positions
    cut = per.withColumn("new", (F.coalesce(F.max("end_bp").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)) < F.col("start_bp")).cast("int"))
    return cut.withColumn("stretch", F.sum("new").over(by)).drop("new")


def pair_likelihoods(lik: DataFrame) -> DataFrame:
    """Posteriors of three genotypes from their log likelihoods l0, l1, l2; a third each where none is finite."""
    top = F.greatest("l0", "l1", "l2")
    known = top.isNotNull() & ~F.isnan(top) & (F.abs(top) != float("inf"))
    e = [F.exp(F.coalesce(F.col(c), F.lit(float("-inf"))) - top) for c in ("l0", "l1", "l2")]
    p = [F.when(known, x / (e[0] + e[1] + e[2])).otherwise(F.lit(1 / 3)) for x in e]
    return lik.select("id", p[0].alias("p0"), p[1].alias("p1"), p[2].alias("p2"))


def homokaryotype_diversity_pattern(rows: DataFrame, low: float = 0.005, high: float = 0.015, ratio: float = 2.0, excess: float = 1.2, least: int = 5) -> DataFrame:
    """Bands of diversity of the two homozygotes, heterozygote excess over Hardy-Weinberg; rows is (id, pi_a, pi_b, n_aa, n_ab, n_bb)."""
    n = F.col("n_aa") + F.col("n_ab") + F.col("n_bb")
    p = (2 * F.col("n_aa") + F.col("n_ab")) / (2 * n)
    expected = 2 * p * (1 - p) * n
    band = lambda c: F.when(F.col(c).isNull() | (F.col(c) < low), "low").when(F.col(c) > high, "high").otherwise("mid")
    sure = (F.col("n_aa") >= least) & (F.col("n_bb") >= least) & F.col("pi_a").isNotNull() & F.col("pi_b").isNotNull()
    apart = (F.col("pi_a") > 0) & (F.col("pi_b") > 0) & (F.greatest("pi_a", "pi_b") >= ratio * F.least("pi_a", "pi_b"))
    more = F.when(expected > 0, F.col("n_ab") / expected)
    out = rows.select("id", band("pi_a").alias("band_a"), band("pi_b").alias("band_b"), F.when(sure, apart).otherwise(False).alias("asymmetric"), F.when(sure, more).alias("ab_ratio"), n.alias("n_total"), sure.alias("sufficient"))
    return out.withColumn("ab_excess", F.coalesce(F.col("ab_ratio") >= excess, F.lit(False)))


def regime_structure(rows: DataFrame, arm: float = 0.30, diffuse: float = 0.30) -> DataFrame:
    """First rule that holds names a regime's structure; rows is (id, consensus_class, nested, start_bp, end_bp, arm_bp, m, sharpness)."""
    span = F.greatest(F.lit(0), F.col("end_bp") - F.col("start_bp"))
    label = (
        F.when(F.col("consensus_class") == "RANDOM_FAN", "noise_or_recombinant")
        .when(F.col("nested"), "compound_inversion_like")
        .when((F.col("arm_bp") > 0) & (span >= arm * F.col("arm_bp")), "arm_scale_block")
        .when(F.col("m").between(4, 6), "nested_or_compound")
        .when(F.col("m") == 3, "inversion_dosage_like")
        .when(F.col("m") == 2, "simple_haplotype_split")
        .when(F.col("sharpness") <= diffuse, "recombination_gradient_like")
        .otherwise("structural_block_like")
    )
    return rows.select("id", label.alias("structure"))


def sv_pattern_label(rows: DataFrame) -> DataFrame:
    """Ordered rules on (id, fdr, odds, zone, het_share, ref_share, inv_share): the AB shares of the three groups."""
    body, sure = F.col("zone") == "inversion_body", F.col("fdr") < 0.05
    label = (
        F.when(F.col("fdr").isNull() | (F.col("fdr") >= 0.10), "uninformative")
        .when(F.col("zone").isin("left_boundary", "right_boundary") & sure & (F.col("odds") > 20), "canonical_breakpoint_marker")
        .when(sure & (F.col("odds") > 5), "dominant_presence_marker")
        .when((F.col("het_share") > 0.6) & (F.col("ref_share") < 0.2) & (F.col("inv_share") < 0.2) & sure, "het_specific_marker")
        .when(body & sure, "sub_haplotype_marker")
        .when(body, "internal_linked_marker")
        .otherwise("uninformative")
    )
    return rows.select("id", label.alias("label"))


def sv_evidence_flags(one: DataFrame, two: DataFrame, least: int = 3) -> DataFrame:
    """Evidence of two sources (id, sample_id, split, discordant, mapq0, genotype) united, the later first, as flags."""
    key = ["id", "sample_id"]
    both = one.alias("o").join(two.alias("t"), key, "full")
    later = lambda c: F.coalesce(f"t.{c}", f"o.{c}")
    has = lambda c: F.coalesce(later(c) >= least, F.lit(False)).alias(c)
    called = F.coalesce(later("genotype").isin("AB", "BB"), F.lit(False)).alias("called")
    return both.select(*key, has("split"), has("discordant"), F.coalesce(later("mapq0") > 0, F.lit(False)).alias("mapq0"), called)


def boundary_summary(svs: DataFrame, sides: list, kinds: list) -> DataFrame:
    """Counts by side and kind of all variants and of those with fdr below 0.05, zeros included; svs is (side, kind, fdr)."""
    every = svs.sparkSession.createDataFrame([(s, k) for s in sides for k in kinds], "side string, kind string")
    n = svs.groupBy("side", "kind").agg(F.count("*").alias("n_all"), F.count_if(F.col("fdr") < 0.05).alias("n_significant"))
    return every.join(n, ["side", "kind"], "left").fillna(0)


def linkage_of_set(calls: DataFrame, chosen: DataFrame, purity: float = 0.7, least: int = 5) -> DataFrame:
    """Per candidate: the band that most of the chosen samples are in, its share of those called and of all chosen, and whether the link is strong."""
    total = chosen.select(F.count_distinct("sample_id").alias("n_total"))
    per = calls.where("k >= 0").join(chosen.select("sample_id").distinct(), "sample_id", "left_semi").groupBy("candidate_id", "k").agg(F.count("*").alias("n"))
    top = per.groupBy("candidate_id").agg(F.max(F.struct("n", (-F.col("k")).alias("minus"))).alias("top"), F.sum("n").alias("n_seen"))
    rows = top.join(F.broadcast(total)).select("candidate_id", (-F.col("top.minus")).alias("band"), F.col("top.n").alias("n_band"), "n_seen", (F.col("top.n") / F.col("n_seen")).alias("purity"), (F.col("top.n") / F.col("n_total")).alias("tracked_purity"))  # one row
    return rows.withColumn("strong", (F.col("purity") >= purity) & (F.col("n_band") >= least))


def subband_parents(fine: DataFrame, coarse: DataFrame, by: list, purity: float = 0.8) -> DataFrame:
    """Per fine band: its most frequent coarse band and share, its letter among the parent's children, and the verdict over all bands."""
    t = fine.select(*by, F.col("k").alias("r")).join(coarse.select(*by, F.col("k").alias("c")), by).where("r >= 0 and c >= 0").groupBy("r", "c").agg(F.count("*").alias("n"))
    p = t.groupBy("r").agg(F.max(F.struct("n", (-F.col("c")).alias("minus"))).alias("top"), F.sum("n").alias("t"))
    p = p.select("r", (-F.col("top.minus")).alias("parent"), (F.col("top.n") / F.col("t")).alias("purity"))  # one row a band from here
    letter = F.char((F.lit(96) + F.row_number().over(W.partitionBy("parent").orderBy("r"))).cast("long"))
    every = W.partitionBy()
    pure = F.count_if(F.col("purity") >= purity).over(every)
    verdict = F.when(pure == F.count("*").over(every), "NESTED").when(pure == 0, "CROSS_CUTTING").otherwise("MIXED")
    return p.select("r", "parent", "purity", letter.alias("letter"), verdict.alias("verdict"))


def froh_by_arrangement(froh: DataFrame, calls: DataFrame) -> DataFrame:
    """Per candidate and karyotype: number, mean, median, deviation, quartiles and range of the samples' F_ROH."""
    f = F.col("froh")
    out = calls.join(froh, "sample_id").groupBy("candidate_id", "k")
    return out.agg(F.count(f).alias("n"), F.avg(f).alias("mean"), F.median(f).alias("median"), F.stddev_samp(f).alias("sd"), F.percentile(f, 0.25).alias("q1"), F.percentile(f, 0.75).alias("q3"), F.min(f).alias("low"), F.max(f).alias("high"))


def band_diagnostics(labels: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per window and band: mean and median of each per-sample metric; metrics is (sample_id, metric, value)."""
    rows = labels.where("k >= 0").join(metrics, "sample_id")
    return rows.groupBy("w", "k", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"))


def burden_by_karyotype(values: DataFrame, least: int = 5, neutral: float = 0.10) -> DataFrame:
    """Per candidate and metric: sizes, medians and interquartile ranges of the three karyotypes, and which side bears more."""
    v = F.col("value")
    of = lambda k, f: f(F.when(F.col("k") == k, v))
    aggs = [x for k, s in ((0, "ref"), (1, "het"), (2, "inv")) for x in (of(k, F.count).alias(f"n_{s}"), of(k, F.median).alias(f"median_{s}"), (of(k, lambda c: F.percentile(c, 0.75)) - of(k, lambda c: F.percentile(c, 0.25))).alias(f"iqr_{s}"))]
    out = values.groupBy("candidate_id", "metric").agg(*aggs)
    base = F.greatest(F.abs("median_ref"), F.abs("median_inv"))
    gap = F.when(base > 0, (F.col("median_inv") - F.col("median_ref")) / base).otherwise(0.0)
    verdict = F.when((F.col("n_ref") < least) | (F.col("n_inv") < least), "insufficient_data").when(F.abs(gap) <= neutral, "neutral").when(gap > 0, "inv_higher").otherwise("ref_higher")
    return out.withColumn("verdict", verdict)


def relationship_matrix(pairs: DataFrame, overlap: DataFrame, strong: DataFrame) -> DataFrame:
    """Each pair (c1, c2) as both, intersecting, co_occurring or none, by tables of overlapping and of associated pairs."""
    x = pairs.join(overlap.select("c1", "c2").distinct().withColumn("o", F.lit(True)), ["c1", "c2"], "left").join(strong.select("c1", "c2").distinct().withColumn("s", F.lit(True)), ["c1", "c2"], "left")
    return x.select("c1", "c2", F.when(F.col("o") & F.col("s"), "both").when(F.col("o"), "intersecting").when(F.col("s"), "co_occurring").otherwise("none").alias("relation"))


def registry_overlay(markers: DataFrame, regimes: DataFrame, width: int) -> DataFrame:
    """Regimes that hold a marker: the first and last of them by position, the widest regime of a chromosome marked primary (then the most confident)."""
    bin_ = lambda c: F.floor(F.col(c) / width)
    r = regimes.withColumn("bin", F.explode(F.sequence(bin_("start_bp"), bin_("end_bp"))))
    m = markers.select("chrom", "pos_bp").withColumn("bin", bin_("pos_bp"))
    hit = r.join(m, ["chrom", "bin"]).where("pos_bp between start_bp and end_bp")
    out = hit.groupBy("id", "chrom", "start_bp", "end_bp", "confidence").agg(F.min("pos_bp").alias("first_pos"), F.max("pos_bp").alias("last_pos"))
    by = W.partitionBy("chrom").orderBy(F.desc(F.col("end_bp") - F.col("start_bp")), F.desc("confidence"), "id")  # regimes, not markers
    return out.withColumn("primary", F.row_number().over(by) == 1).drop("confidence")


def breakpoint_match(points: DataFrame, annotations: DataFrame, reach: int, prefix: str = "C_gar_") -> DataFrame:
    """The annotation of each breakpoint: by id, else the first in file order of its chromosome within ``reach``; prefixes do not count."""
    plain = lambda c: F.regexp_replace(c, f"^{prefix}", "")
    by_id = points.join(annotations.select("id", F.col("ord").alias("ord_id")), "id").groupBy("id").agg(F.min("ord_id").alias("ord_id"))
    # places, not points: those at one place have one answer, and the first annotation of a place hides the others there
    x = points.select(plain("chrom").alias("c"), F.col("pos_bp").alias("x"))
    p = x.distinct().withColumn("bin", F.explode(F.sequence(F.floor((F.col("x") - reach) / reach), F.floor((F.col("x") + reach) / reach))))
    a = annotations.groupBy(plain("chrom").alias("c"), F.col("pos_bp").alias("y")).agg(F.min("ord").alias("ord")).withColumn("bin", F.floor(F.col("y") / reach))
    near = p.join(a, ["c", "bin"]).where(F.abs(F.col("x") - F.col("y")) < reach).groupBy("c", "x").agg(F.min("ord").alias("ord_near"))
    at = points.select("id", plain("chrom").alias("c"), F.col("pos_bp").alias("x")).join(near, ["c", "x"]).groupBy("id").agg(F.min("ord_near").alias("ord_near"))
    out = points.select("id").join(by_id, "id", "left").join(at, "id", "left")
    return out.select("id", F.coalesce("ord_id", "ord_near").alias("ord"))


def evolutionary_role(rows: DataFrame, old: float, young: float) -> DataFrame:
    """Ordered rules over (id, age, divergence, selection, xpehh, segregation, pangenome, structure)."""
    c = F.col
    role = (
        F.when((c("age") >= old) & (c("divergence") == "strong_divergence") & (c("segregation") == "DISTORTED"), "speciation_barrier")
        .when((c("selection") == "load_rich") & (c("pangenome") == "co_shared") & (c("segregation") == "MENDELIAN"), "supergene")
        .when((c("selection") == "load_rich") & c("xpehh").isin("mild_outlier", "strong_outlier"), "local_adaptation_container")
        .when((c("pangenome") == "co_shared") & c("structure").isin("simple_haplotype_split", "inversion_dosage_like"), "ecotype_stabilizer")
        .when((c("divergence") == "strong_divergence") & ~F.coalesce(c("selection") == "load_rich", F.lit(False)), "recombination_modifier")
        .when((c("age") <= young) & (c("selection") == "clean") & c("divergence").isin("no_divergence", "no_data") & c("xpehh").isin("no_signal", "no_data"), "neutral_passenger")
        .otherwise("unclassified")
    )
    return rows.select("id", role.alias("role"))


#: The older words for classes of selection, pangenome and structure (fixed values).
OLDER = {
    "selection": {"load_rich": "enriched", "clean": "neutral", "mixed": "unknown"},
    "pangenome": {"general": "cohort_wide", "co_shared": "lineage_restricted", "private": "family_restricted", "unknown": "unclassified"},
    "structure": {
        "simple_haplotype_split": "clean",
        "inversion_dosage_like": "clean",
        "arm_scale_block": "clean",
        "structural_block_like": "clean",
        "nested_or_compound": "composite_undecomposed",
        "compound_inversion_like": "composite_undecomposed",
        "recombination_gradient_like": "gradient",
        "noise_or_recombinant": "unknown",
    },
}


def tier_axis_values(rows: DataFrame, young: float = 1.0, ancient: float = 5.0) -> DataFrame:
    """Axes (id, age, selection, pangenome, structure) in the older words; a missing axis stays missing."""
    look = lambda axis, rest: F.when(F.col(axis).isNotNull(), F.coalesce(F.create_map(*(F.lit(x) for kv in OLDER[axis].items() for x in kv))[F.col(axis)], F.lit(rest)))
    age = F.when(F.col("age") < young, "young").when(F.col("age") > ancient, "ancient").when(F.col("age").isNotNull(), "intermediate")
    return rows.select("id", age.alias("age_class"), look("selection", "unknown").alias("burden_class"), look("pangenome", "unclassified").alias("polymorphism_class"), look("structure", "unknown").alias("internal_structure"))


def divergence_label(edges: DataFrame, strong: float, weak: float) -> DataFrame:
    """Per candidate, by the largest FST of edges that are not of low power."""
    t = edges.groupBy("id").agg(F.max(F.when(~F.col("low_power"), F.col("fst"))).alias("top"), F.count_if(~F.col("low_power")).alias("usable"))
    label = F.when(F.col("usable") == 0, "low_power").when(F.col("top").isNull(), "no_data").when(F.col("top") >= strong, "strong_divergence").when(F.col("top") >= weak, "weak_divergence").otherwise("no_divergence")
    return t.select("id", label.alias("divergence"))


def xpehh_label(values: DataFrame, mild: float = 2.0, strong: float = 4.0, windows: int = 3) -> DataFrame:
    """Per candidate, by its windows' |z|: one at ``strong`` or ``windows`` at ``mild`` are strong, one at ``mild`` mild."""
    a = F.abs("z")
    t = values.groupBy("id").agg(F.max(a).alias("top"), F.count_if(a >= mild).alias("n_mild"))
    label = F.when(F.col("top").isNull(), "no_data").when((F.col("top") >= strong) | (F.col("n_mild") >= windows), "strong_outlier").when(F.col("n_mild") > 0, "mild_outlier").otherwise("no_signal")
    return t.select("id", label.alias("xpehh"))


def classification_rows(axes: list[DataFrame], names: list[str], ids: DataFrame) -> DataFrame:
    """One row per candidate with its axes side by side (missing: ``__missing__``) and the share that is there."""
    out = ids
    for a in axes:
        out = out.join(a, "id", "left")
    there = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return out.select("id", *(F.coalesce(c, F.lit("__missing__")).alias(c) for c in names), (there / len(names)).alias("coverage"))


def l2_gates(rows: DataFrame, silhouette: float = 0.30, band: int = 5, groups: int = 2, apart: int = 100_000) -> DataFrame:
    """The first gate that an envelope fails, in order, or pass; rows is (id, dismissed, covered, silhouette, smallest, groups, distance)."""
    c = F.col
    gate = (
        F.when(c("dismissed"), "dismissed")
        .when(c("covered"), "already_covered")
        .when(c("silhouette").isNull() | (c("silhouette") < silhouette), "low_silhouette")
        .when(c("smallest") < band, "small_band")
        .when(c("groups") < groups, "few_groups")
        .when(c("distance") < apart, "near_candidate")
        .otherwise("pass")
    )
    return rows.select("id", gate.alias("gate"))


def promote_envelopes(envelopes: DataFrame) -> DataFrame:
    """One candidate from the envelopes of each group: its bounds, and the middle one, by start, as its reference."""
    by = W.partitionBy("grp").orderBy("start_bp", "env_id")
    rows = envelopes.withColumn("i", F.row_number().over(by))
    t = rows.groupBy("grp").agg(F.min("start_bp").alias("start_bp"), F.max("end_bp").alias("end_bp"), F.count("*").alias("n"))
    ref = rows.join(t.select("grp", "n"), "grp").where("i = floor(n / 2) + 1").select("grp", F.col("env_id").alias("reference"))
    return t.join(ref, "grp")
