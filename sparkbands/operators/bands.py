"""Bands along windows: signs, envelopes, quality, seeds and their votes, partitions, chains, regimes.

Labels are rows (w, sample_id, k); null and negative labels are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored
from .matrix import met_blocks


# -- one window or envelope ------------------------------------------------


def aggregate_l2(track: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Mean and median of each sample over the windows of each envelope (env_id, s0, e0, bounds included), and the mean of the second component ``value2`` if there is one."""
    inside = envelopes.select("env_id", F.explode(F.sequence("s0", "e0")).alias("w"))
    rows = track.where("value is not null").join(inside, "w").groupBy("env_id", "sample_id")
    second = [F.avg("value2").alias("mean2")] if "value2" in track.columns else []
    return rows.agg(F.avg("value").alias("mean"), F.median("value").alias("median"), *second, F.count("*").alias("n_windows"))


def cluster_l2(best: DataFrame, windows: DataFrame, least: int = 3, least_windows: int = 2) -> DataFrame:
    """Per envelope, what was chosen (env_id, used_k, silhouette, smallest) and whether its clusters can be used: every one of at least ``least`` samples, and enough windows (env_id, n_windows)."""
    flag = F.when(F.col("n_windows") < least_windows, "LOW_NWIN").when(F.col("smallest") < least, "LOW_GROUP_N").otherwise("ok")
    return best.join(windows, "env_id").withColumn("flag", flag)


def sign_align(track: DataFrame, hold: float = 0.10, keys: tuple = ()) -> DataFrame:
    """A sign for each window: along the chain of correlations with the window before, then against the mean of all, keeping the last sign where |r| is below ``hold``."""
    before = track.select(*keys, "sample_id", (F.col("w") + 1).alias("w"), F.col("value").alias("prev"))
    r = track.join(before, [*keys, "w", "sample_id"], "left").groupBy(*keys, "w").agg(F.corr("value", "prev").alias("r"))
    by = W.partitionBy(*keys).orderBy("w")  # one row per window of a chromosome
    chain = r.withColumn("chain", F.when(F.sum((F.coalesce(F.col("r"), F.lit(0.0)) < 0).cast("int")).over(by) % 2 == 1, -1).otherwise(1))
    signed = track.join(chain.select(*keys, "w", "chain"), [*keys, "w"]).withColumn("value", F.col("value") * F.col("chain"))
    mean = signed.groupBy(*keys, "sample_id").agg(F.avg("value").alias("mean"))
    c = signed.join(mean, [*keys, "sample_id"]).groupBy(*keys, "w", "chain").agg(F.corr("value", "mean").alias("r"))
    now = F.when(F.abs("r") >= hold, F.when(F.col("r") < 0, -F.col("chain")).otherwise(F.col("chain")))
    held = F.coalesce(F.last(now, ignorenulls=True).over(by), F.col("chain"))
    return c.select(*keys, "w", held.alias("sign"), F.col("r").alias("consensus_r"))


def band_quality(labels: DataFrame, silhouettes: DataFrame, spectrum: DataFrame, scale: float = 1.5) -> DataFrame:
    """Smallest of silhouette, size balance and 1 - exp(-(lam1 / lam2 - 1) / scale) per window; spectrum is (w, lam1, lam2)."""
    n = labels.where("k >= 0").groupBy("w", "k").agg(F.count("*").alias("n"))
    t = n.groupBy("w").agg(F.sum("n").alias("t"), F.count("*").alias("bands"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    balance = F.when(F.col("bands") > 1, (F.log("t") - F.col("nlogn") / F.col("t")) / F.log("bands")).otherwise(0.0)
    ratio = F.greatest(F.lit(0.0), 1 - F.exp(-(F.col("lam1") / F.greatest("lam2", F.lit(1e-9)) - 1) / scale))
    rows = t.join(silhouettes, "w").join(spectrum, "w")
    sil = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "silhouette"))
    return rows.select("w", F.least(sil, balance, ratio).alias("quality"), balance.alias("size_balance"), ratio.alias("eigen"), F.col("bands").cast("long").alias("k_eff"))


def band_quality_stats(quality: DataFrame, keys: tuple = ()) -> DataFrame:
    """How many windows pass 0.3, 0.4 and 0.5, and the first of 0.5, 0.4 and 0.3 that five pass (else half the maximum, held to 0.2 .. 0.3)."""
    q = F.col("quality")
    t = quality.groupBy(*keys).agg(F.count("*").alias("n_windows"), *(F.count_if(q >= x / 10).alias(f"pass_{x}") for x in (3, 4, 5)), F.avg(q).alias("mean"), F.max(q).alias("max"))
    low = F.greatest(F.lit(0.2), F.least(F.lit(0.3), F.col("max") / 2))
    return t.withColumn("threshold", F.when(F.col("pass_5") >= 5, 0.5).when(F.col("pass_4") >= 5, 0.4).when(F.col("pass_3") >= 5, 0.3).otherwise(low))


def reference_samples(track: DataFrame, labels: DataFrame, n: int = 10) -> DataFrame:
    """Per window the sign of the mean of the ``n`` samples of the band with the largest |mean|, by the samples' own |mean|."""
    whole = labels.groupBy("sample_id").agg(F.mode("k", True).alias("k"))
    m = track.groupBy("sample_id").agg(F.avg("value").alias("m")).join(whole, "sample_id")
    top = m.groupBy("k").agg(F.abs(F.avg("m")).alias("size")).agg(F.max_by("k", F.struct("size", (-F.col("k")).alias("minus"))).alias("k"))
    chosen = m.join(F.broadcast(top), "k").orderBy(F.desc(F.abs("m")), "sample_id").limit(n)  # one band; n samples
    return track.join(chosen.select("sample_id"), "sample_id", "left_semi").groupBy("w").agg(F.sign(F.avg("value")).cast("int").alias("sign"), F.count("*").alias("n"))


def order_samples(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Place of each sample by its group's rank (unknown: 999), then pc1 (missing: 0), then id, numbered within groups and shifted by the groups before."""
    rows = rows.join(ranks, "grp", "left").withColumns({"rank": F.coalesce("rank", F.lit(999)), "pc1": F.coalesce("pc1", F.lit(0.0))})
    size = rows.groupBy("rank").agg(F.count("*").alias("n"))
    base = size.select("rank", (F.sum("n").over(W.orderBy("rank")) - F.col("n")).alias("base"))  # one row a rank
    inner = F.row_number().over(W.partitionBy("rank").orderBy("pc1", "sample_id"))
    return rows.join(base, "rank").select("sample_id", "rank", (F.col("base") + inner - 1).alias("place"))


def order_markers(dosage: DataFrame, pc1: DataFrame) -> DataFrame:
    """|r| of each marker with a reference component, the strongest first."""
    r = dosage.join(pc1, "sample_id").groupBy("marker").agg(F.abs(F.corr("dosage", "pc1")).alias("r"))
    return r.select("marker", "r", F.row_number().over(W.orderBy(F.desc("r"), "marker")).alias("place"))  # one row a marker


def center_and_polarize(dosage: DataFrame, pc1: DataFrame) -> DataFrame:
    """Markers centred, and turned where their product with the centred component is negative."""
    d = dosage.where("dosage is not null").join(pc1, "sample_id")
    m = d.groupBy("marker").agg(F.avg("dosage").alias("m"), F.covar_pop("dosage", "pc1").alias("c"))
    sign = F.when(F.col("c") < 0, -1).otherwise(1)
    return d.join(m, "marker").select("marker", "sample_id", sign.alias("sign"), ((F.col("dosage") - F.col("m")) * sign).alias("centred"))


def profile_matrix(dosage: DataFrame, spans: DataFrame) -> DataFrame:
    """Mean dosage of each sample over each span of markers (span, first, last)."""
    inside = spans.select("span", F.explode(F.sequence("first", "last")).alias("marker"))
    return dosage.join(inside, "marker").groupBy("span", "sample_id").agg(F.avg("dosage").alias("mean"), F.count("dosage").alias("n"))


def trajectory_distance(bins: DataFrame, near: float = 0.5, block: int = 200) -> DataFrame:
    """Distance of two samples of a group along their bins (grp, sample_id, bin, mean): difference, switches, and the longest alike stretch.

    Samples are dealt into blocks of about ``block``, packed as one row; two
    blocks meet once and go along their bins (forty at most) for all their pairs
    at once, so no row stands for a pair and a bin, and pairs are never shuffled.
    """
    types = dict(bins.dtypes)
    grp, one = types["grp"], types["sample_id"]
    many = bins.groupBy("grp").agg(F.ceil(F.count_distinct("sample_id") / block).alias("blocks"))
    rows = bins.where("sample_id is not null and bin is not null").join(many, "grp").withColumn("block", F.pmod(F.xxhash64("sample_id"), F.col("blocks")))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(f["sample_id"].to_numpy(), return_inverse=True)
        names, place = np.unique(f["bin"].to_numpy(), return_inverse=True)
        x, there = np.zeros((len(ids), len(names))), np.zeros((len(ids), len(names)), np.int8)
        x[at, place], there[at, place] = f["mean"].to_numpy(float), 1 + f["known"].to_numpy(np.int8)  # 1: a bin without a mean
        return pd.DataFrame([{"grp": f["grp"].iloc[0], "block": f["block"].iloc[0], "ids": ids, "bins": names, "x": x.tobytes(), "there": there.tobytes()}])

    kind = f"grp {grp}, block long, ids array<{one}>, bins array<{types['bin']}>, x binary, there binary"
    rows = rows.select("grp", "block", "sample_id", "bin", F.col("mean").cast("double").alias("mean"), F.col("mean").isNotNull().cast("int").alias("known"))
    packed = stored(rows.groupBy("grp", "block").applyInPandas(pack, kind))

    def walk(frames):
        for f in frames:
            for r in f.to_dict("records"):
                (ids1, ids2), (bins1, bins2) = ([np.asarray(r[f"{c}{i}"]) for i in "12"] for c in ("ids", "bins"))
                _, at1, at2 = np.intersect1d(bins1, bins2, return_indices=True)
                x, y = (np.frombuffer(r[f"x{i}"]).reshape(len(ids), -1)[:, at] for i, ids, at in (("1", ids1, at1), ("2", ids2, at2)))
                tx, ty = (np.frombuffer(r[f"there{i}"], np.int8).reshape(len(ids), -1)[:, at] for i, ids, at in (("1", ids1, at1), ("2", ids2, at2)))
                shape = (len(ids1), len(ids2))
                total, (n, met, run, best, switches) = np.zeros(shape), (np.zeros(shape, np.int32) for _ in range(5))
                last = np.full(shape, -1, np.int8)  # -1: none, or without a mean
                for j in range(len(at1)):
                    both = np.minimum.outer(tx[:, j], ty[:, j])
                    known = both == 2
                    d = np.abs(x[:, j, None] - y[None, :, j])
                    alike = known & (d < near)
                    total += np.where(known, d, 0.0)
                    n += known
                    met += both > 0
                    switches += known & (last >= 0) & (last != alike)
                    run = np.where(both > 0, np.where(alike, run + 1, 0), run)
                    best = np.maximum(best, run)
                    last = np.where(known, alike, np.where(both > 0, -1, last)).astype(np.int8)
                a, b = np.nonzero((met > 0) & ((ids1[:, None] < ids2[None, :]) if r["block1"] == r["block2"] else True))
                total, n, switches, best = total[a, b], n[a, b], switches[a, b], best[a, b]
                m = np.maximum(n, 1)
                away = np.maximum(0.0, total / m + np.where(n > 1, 0.5 * switches / np.maximum(n - 1, 1), 0.0) - 0.15 * best / m)
                yield pd.DataFrame({"grp": r["grp"], "s1": np.minimum(ids1[a], ids2[b]), "s2": np.maximum(ids1[a], ids2[b]), "distance": np.where(n == 0, 2.0, away)})

    return met_blocks(packed, ["grp"]).mapInPandas(walk, f"grp {grp}, s1 {one}, s2 {one}, distance double")


def rank_signature(metrics: DataFrame) -> DataFrame:
    """A window's bands ranked by a metric, ties on the smaller rank, as a text key; metrics is (w, k, value)."""
    r = metrics.select("w", "k", F.rank().over(W.partitionBy("w").orderBy("value")).alias("r"))  # a few bands a window
    return r.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: F.concat_ws(":", x["k"], x["r"])), "|").alias("signature"))


def track_runs(steps: DataFrame, least: int = 2, keys: tuple = ()) -> DataFrame:
    """Stretches of windows whose verdict is co_seg or partial, within a chain: mean share and entropy, and the most frequent band."""
    by = W.partitionBy(*keys, "chain").orderBy("w")  # windows of one chain
    good = steps.where(F.col("verdict").isin("co_seg", "partial")).withColumn("run", F.col("w") - F.row_number().over(by))
    t = good.groupBy(*keys, "chain", "run").agg(F.min("w").alias("start"), F.max("w").alias("end"), F.count("*").alias("length"), F.avg("share").alias("mean_share"), F.avg("entropy").alias("mean_entropy"), F.mode("band", True).alias("band"))
    return t.where(F.col("length") >= least).drop("run")


def scale_stability(panes: DataFrame, stable: float = 0.75) -> DataFrame:
    """Verdict over three panes; panes is (id, k1, k2, k3, ari12, ari23, fuse12, fuse23, split12, split23)."""
    c = F.col
    unexplained = ((c("ari12") < 0.5) & (c("fuse12") + c("split12") == 0)) | ((c("ari23") < 0.5) & (c("fuse23") + c("split23") == 0))
    calm = (c("fuse12") + c("fuse23") + c("split12") + c("split23") == 0) & (c("ari12") >= stable) & (c("ari23") >= stable)
    ks = lambda a, b, d: (c("k1") == a) & (c("k2") == b) & (c("k3") == d)
    nested = (ks(6, 6, 3) & (c("fuse23") == 3) & (c("split23") == 0)) | (ks(6, 3, 3) & (c("fuse12") == 3) & (c("split12") == 0))
    broken = ks(3, 6, 3) & (c("fuse12") + c("split12") > 0) & (c("fuse23") + c("split23") > 0)
    verdict = F.when(unexplained, "UNSTABLE").when(ks(3, 3, 3) & calm, "STABLE_3BAND").when(ks(6, 6, 6) & calm, "STABLE_6BAND").when(nested, "NESTED_3IN6").when(broken, "OVERLAP_BREAKS_3").otherwise("UNSTABLE")
    return panes.select("id", verdict.alias("verdict"))


# -- karyotypes of bands ---------------------------------------------------


def karyotype_roles(bands: DataFrame) -> DataFrame:
    """Roles of bands (id, k, kind, centre): homozygous bands by centre, missing last: the first HOM_REF, the last HOM_INV, HOM alone."""
    hom = F.col("kind") == "hom"
    group = W.partitionBy("id", hom)  # a few bands an id
    place, n = F.row_number().over(group.orderBy(F.asc_nulls_last("centre"), "k")), F.count("*").over(group)
    role = F.when(F.col("kind") == "het", "HET").when(~hom, None).when(n == 1, "HOM").when(place == 1, "HOM_REF").when(place == n, "HOM_INV").otherwise("HOM_MID")
    return bands.select("id", "k", role.alias("role"))


def arrangement_order(rows: DataFrame) -> DataFrame:
    """Blocks (id, block, centre) numbered by mean centre, empty ones last, ties by block."""
    m = rows.groupBy("id", "block").agg(F.avg("centre").alias("centre"))
    return m.select("id", "block", "centre", F.row_number().over(W.partitionBy("id").orderBy(F.asc_nulls_last("centre"), "block")).alias("number"))


def band_divergence_class(het: DataFrame, modes: DataFrame, low: float = 0.40, high: float = 0.50, most: float = 0.7) -> DataFrame:
    """Per band (id, k) of samples with het: shares of low, middle and high ones and the reading; modes is (id, k, two_modes)."""
    kind = F.when(F.col("het") < low, "low").when(F.col("het") >= high, "high").otherwise("mid")
    share = lambda x: F.avg((F.col("kind") == x).cast("double")).alias(x)
    t = het.withColumn("kind", kind).groupBy("id", "k").agg(F.count("*").alias("n"), share("low"), share("mid"), share("high")).join(modes, ["id", "k"], "left")
    reading = F.when(F.col("two_modes"), "mixed").when(F.col("low") >= most, "hom-like").when(F.col("high") >= most, "het-like").otherwise("ambiguous")
    return t.select("id", "k", "n", "low", "mid", "high", reading.alias("reading"), F.coalesce("two_modes", F.lit(False)).alias("sub_band"))


def band_haplotypes(bands: DataFrame) -> DataFrame:
    """Names of bands (id, k, kind, centre): homozygous ones H1, H2, H3 by centre; a heterozygous one by its two nearest homozygous bands."""
    hom = bands.where("kind = 'hom'").withColumn("h", F.row_number().over(W.partitionBy("id").orderBy("centre", "k")))
    two = W.partitionBy("id", "k").orderBy(F.abs(F.col("centre") - F.col("c")), "h")  # a few bands an id
    near = bands.where("kind = 'het'").join(hom.select("id", "h", F.col("centre").alias("c")), "id").withColumn("i", F.row_number().over(two)).where("i <= 2")
    names = near.groupBy("id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: F.concat(F.lit("H"), h.cast("string"))), "/").alias("name"))
    return hom.where("h <= 3").select("id", "k", F.concat(F.lit("H"), F.col("h").cast("string")).alias("name")).unionByName(names)


#: Names of bands by how many there are.
VOCABULARY = {"standard": ("HOM_REF", "HET", "HOM_INV"), "multi2": ("H1/H1", "H1/H2", "H2/H2"), "multi3": ("H1/H1", "H1/H2", "H1/H3", "H2/H2", "H2/H3", "H3/H3")}


def band_labels_auto(labels: DataFrame, track: DataFrame, clear: float = 1.4, least: int = 5) -> DataFrame:
    """A name for each band of a candidate: labels (id, sample_id, k), track (id, w, sample_id, value) over its windows.

    A band's centre is the mean over windows of its mean, its spread the mean
    over samples of their mean distance from the centre.  Up to three bands are
    named HOM_REF, HET, HOM_INV by centre, four or five by two haplotypes, six by
    three, more have no names.  The band of the largest spread is heterozygous
    where that is ``clear`` times the middle one (the upper of two); bands under
    ``least`` samples are taken for recombinants.
    """
    rows = labels.where("k >= 0").join(track.where("value is not null"), ["id", "sample_id"])
    size = labels.where("k >= 0").groupBy("id", "k").agg(F.count("*").alias("n"))
    centre = rows.groupBy("id", "k", "w").agg(F.avg("value").alias("m")).groupBy("id", "k").agg(F.avg("m").alias("centre"))
    off = rows.join(centre, ["id", "k"]).groupBy("id", "k", "sample_id").agg(F.avg(F.abs(F.col("value") - F.col("centre"))).alias("off"))
    b = size.join(centre, ["id", "k"], "left").join(off.groupBy("id", "k").agg(F.avg("off").alias("sigma")), ["id", "k"], "left").fillna(0.0, ["centre", "sigma"])
    one = W.partitionBy("id")  # a few bands a candidate
    sure = F.col("n") >= least
    b = b.withColumns({"size": F.count("*").over(one), "place": F.row_number().over(one.orderBy("centre", "k")) - 1, "rank": F.row_number().over(one.orderBy("sigma", "k")) - 1})
    het = F.max(F.when(sure, F.struct(F.round("sigma", 9).alias("sigma"), (-F.col("k")).alias("minus")))).over(one)
    b = b.withColumns({"het": het, "middle": F.max(F.when(F.col("rank") == F.floor(F.col("size") / 2), F.col("sigma"))).over(one)})
    ratio = F.when((F.col("middle") > 0) & (F.col("het.sigma") > 0), F.col("het.sigma") / F.col("middle")).otherwise(1.0)
    b = b.withColumns({"ratio": ratio, "is_het": (F.col("k") == -F.col("het.minus")) & (F.round(ratio, 9) > clear)})
    k, place = F.col("size"), F.col("place")
    vocab = F.when(k <= 3, "standard").when(k == 6, "multi3").when(k < 6, "multi2").otherwise("free")
    share = place / F.greatest(F.lit(1), k - 1)
    name = lambda v, i: F.lit(VOCABULARY[v][i])
    sided = F.when(F.col("is_het"), name("multi2", 1)).when(share < 0.34, name("multi2", 0)).when(share > 0.66, name("multi2", 2)).otherwise(name("multi2", 1))
    plain = F.when(F.col("is_het"), name("standard", 1)).when(place == 0, name("standard", 0)).when(place == k - 1, name("standard", 2)).otherwise(name("standard", 1))
    six = F.get(F.array(*map(F.lit, VOCABULARY["multi3"])), F.least(F.lit(5), F.floor(share * 6)).cast("int"))
    label = F.when(vocab == "free", "").when(~sure, "RECOMBINANT").when(vocab == "standard", plain).when(vocab == "multi2", sided).otherwise(six)
    outer = (place == 0) | (place == k - 1)
    level = F.when(~sure, "medium").when(vocab == "free", "none").when(vocab == "multi3", "low")
    level = level.when(vocab == "multi2", F.when(F.col("is_het"), "medium").otherwise("low"))
    level = level.otherwise(F.when(F.col("is_het"), "high").when(outer, F.when(F.round("ratio", 9) > clear, "high").otherwise("medium")).otherwise("low"))
    return b.select("id", "k", "n", "centre", "sigma", vocab.alias("vocab"), label.alias("label"), level.alias("confidence"))


def het_band_candidate(bands: DataFrame) -> DataFrame:
    """Per id with three or more bands (id, k, mean, dosage): the one nearest the middle of the extreme means, with a share of the span of 0.2 to 0.8, else nearest to dosage 1 within 0.35."""
    every = W.partitionBy("id")
    b = bands.withColumns({"lo": F.min("mean").over(every), "hi": F.max("mean").over(every), "n": F.count("*").over(every)}).where("n >= 3")
    share = F.when(F.col("hi") > F.col("lo"), (F.col("mean") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    b = b.withColumns({"share": share, "off": F.round(F.abs(F.col("mean") - (F.col("lo") + F.col("hi")) / 2), 9), "dev": F.abs(F.col("dosage") - 1)})
    key = lambda ok, x: F.min(F.when(ok, F.struct(F.col(x), "k")))
    t = b.groupBy("id").agg(key(F.col("share").between(0.2, 0.8), "off").alias("m"), key(F.col("dev") <= 0.35, "dev").alias("d"))
    return t.select("id", F.coalesce("m.k", "d.k").alias("k"), F.when(F.col("m").isNotNull(), "midpoint").when(F.col("d").isNotNull(), "dosage").alias("by"))


def calls_from_skeleton(labels: DataFrame, skeleton: DataFrame, least: int = 3, share: float = 0.66) -> DataFrame:
    """Per sample: windows in the het, first and second homozygous band of a skeleton (w, het, hom_a, hom_b), and the call."""
    at = lambda c: F.count_if(F.col("k") == F.col(c)).alias("n_" + c)
    t = labels.join(skeleton, "w").groupBy("sample_id").agg(at("het"), at("hom_a"), at("hom_b"))
    total, top = F.col("n_het") + F.col("n_hom_a") + F.col("n_hom_b"), F.greatest("n_het", "n_hom_a", "n_hom_b")
    name = F.when(F.col("n_het") == top, "HET").when(F.col("n_hom_a") == top, "HOM_A").otherwise("HOM_B")
    return t.withColumn("call", F.when(total < least, "UNCALLED").when(top / total >= share, name).otherwise("AMBIGUOUS"))


def karyotype_call_per_axis(states: DataFrame) -> DataFrame:
    """States by component and by dosage (sample_id, axis, by_pc1, by_dosage): agreeing HIGH, opposed FLAGGED, one alone LOW, none NA."""
    a, b = F.col("by_pc1"), F.col("by_dosage")
    level = F.when(a.isNull() & b.isNull(), "NA").when(a == b, "HIGH").when(a.isNotNull() & b.isNotNull(), "FLAGGED").otherwise("LOW")
    return states.select("sample_id", "axis", F.when(level != "FLAGGED", F.coalesce(a, b)).alias("state"), level.alias("confidence"))


def karyotype_model(rows: DataFrame, split: float = 0.20) -> DataFrame:
    """Agreement of a band's evidence (id, trajectory, sign, projection, vote), and its macro group: a trajectory, in two by sign where the smaller part holds ``split``."""
    traj, proj = F.col("trajectory").isNotNull(), F.coalesce(~F.col("projection").isin("EMPTY", "NOISE"), F.lit(False))
    vote = F.coalesce(~F.col("vote").isin("CONFLICT", "NO_DATA"), F.lit(False))
    tp, tv, pv = traj & proj & ~F.col("projection").isin("SPLIT", "MERGE"), traj & vote, proj & vote
    tp = F.coalesce(tp, F.lit(False))
    agreement = F.when(tp & tv & pv, "ALL_AGREE").when(tp, "TRAJ_PROJ_AGREE").when(tv, "TRAJ_VOTE_AGREE").when(pv, "PROJ_VOTE_AGREE").when(traj | proj | vote, "DISAGREE").otherwise("INSUFFICIENT")
    t = rows.where("trajectory is not null").groupBy("trajectory").agg(F.avg((F.col("sign") == -1).cast("double")).alias("neg"))
    t = t.select("trajectory", (F.least("neg", 1 - F.col("neg")) >= split).alias("two"))
    out = rows.join(t, "trajectory", "left").withColumn("agreement", agreement)
    part = F.when(F.col("trajectory").isNotNull(), F.concat(F.col("trajectory").cast("string"), F.when(F.col("two"), F.when(F.col("sign") == -1, "-").otherwise("+")).otherwise("")))
    return out.select("id", "agreement", part.alias("macro_group"))


# -- seeds, votes, partitions ----------------------------------------------


def projections(table: DataFrame, least: int = 5, purity: float = 0.80, second: float = 0.20, count: int = 3) -> DataFrame:
    """Where each voter set (w1, a) goes among the bands of w2: SINGLE, SPLIT, or none of them, and the bands it visits.

    One band with ``purity`` is a single; else bands are taken by share, each of
    at least ``second`` and ``count`` samples, until they hold ``purity``.
    """
    by = W.partitionBy("w1", "w2", "a")  # a few bands
    t = table.withColumn("t", F.sum("n").over(by)).withColumn("share", F.col("n") / F.col("t"))
    order = by.orderBy(F.desc("share"), "b").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("ok", (F.col("share") >= second) & (F.col("n") >= count))
    t = t.withColumn("cum", F.sum(F.when(F.col("ok"), F.col("share"))).over(order))
    taken = F.col("ok") & (F.col("cum") - F.col("share") < purity)
    g = t.groupBy("w1", "w2", "a").agg(F.max("t").alias("n_focal"), F.max("share").alias("max_purity"), F.max(F.when(F.col("ok"), F.col("cum"))).alias("held"), F.array_sort(F.collect_list(F.when(taken, F.col("b")))).alias("visited"))
    kind = F.when(F.col("n_focal") < least, "EMPTY").when(F.col("max_purity") >= purity, "SINGLE").when(F.col("held") >= purity, "SPLIT").otherwise("SCATTER")
    bands = F.when(kind.isin("SINGLE", "SPLIT"), F.array_join(F.when(kind == "SINGLE", F.slice("visited", 1, 1)).otherwise(F.col("visited")), ",")).otherwise("")
    return g.select("w1", "w2", "a", "n_focal", "max_purity", kind.alias("pattern"), bands.alias("visited"))


def seed_reliability(votes: DataFrame, least: int = 3, valid: float = 0.30) -> DataFrame:
    """Per target window: incoming votes that say something, their share, and the verdict."""
    t = votes.groupBy(F.col("w2").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("pattern").isin("SINGLE", "SPLIT")).alias("n_informative"))
    share = F.col("n_informative") / F.col("n")
    return t.select("w", "n", "n_informative", share.alias("share"), F.when(F.col("n_informative") < least, "UNDETERMINED").when(share >= valid, "VALID").otherwise("NOISE").alias("verdict"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) with the smallest node reachable over edges (a, b); nodes alone are their own.

    Minima are handed over neighbours and then over the labels' own labels, so
    the number of rounds is about the logarithm of the longest way.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(nodes.select("node", F.col("node").alias("c")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        step = label.join(near, "node", "left").select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        step = stored(step.join(up, "c").select("node", "old", F.least("c", "cc").alias("c")))
        label = step.select("node", "c")
        if step.where("old <> c").isEmpty():
            return label.withColumnRenamed("c", "component")


def linkage_groups(votes: DataFrame, windows: DataFrame) -> DataFrame:
    """Components of windows that inform each other both ways, numbered by their first member."""
    good = votes.where(F.col("pattern").isin("SINGLE", "SPLIT")).select(F.col("w1").alias("a"), F.col("w2").alias("b")).distinct()
    mutual = good.join(good.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
    c = components(mutual, windows.select(F.col("w").alias("node")))
    number = F.dense_rank().over(W.orderBy("component")) - 1  # windows of a chromosome
    return c.select(F.col("node").alias("w"), number.alias("group"))


def adjacent_seed_merge(signals: DataFrame, merge: float = 0.85, least: int = 4) -> DataFrame:
    """Neighbouring seeds (w1, w2, n, v, r, c): INSUFFICIENT, MERGE or SEPARATE."""
    return signals.select("w1", "w2", "n", "v", F.when(F.col("n") < least, "INSUFFICIENT").when(F.col("v") >= merge, "MERGE").otherwise("SEPARATE").alias("verdict"))


def band_jaccards(table: DataFrame, size: DataFrame, keys: tuple = ()) -> DataFrame:
    """Jaccard of each band of w1 with its best partner in w2, ties to the smaller band; ``size`` is (*keys, w, k, m)."""
    t = table.join(size.withColumnsRenamed({"w": "w1", "k": "a", "m": "ma"}), [*keys, "w1", "a"]).join(size.withColumnsRenamed({"w": "w2", "k": "b", "m": "mb"}), [*keys, "w2", "b"])
    j = F.col("n") / (F.col("ma") + F.col("mb") - F.col("n"))
    best = t.groupBy(*keys, "w1", "w2", "a").agg(F.max(F.struct(j.alias("j"), (-F.col("b")).alias("minus"))).alias("m"))
    return best.select(*keys, "w1", "w2", "a", (-F.col("m.minus")).alias("b"), F.col("m.j").alias("jaccard"))


def locus_chains(quality: DataFrame, jaccards: DataFrame, least_quality: float = 0.4, least_jaccard: float = 0.7, least: int = 5, keys: tuple = ()) -> DataFrame:
    """Stretches of windows of at least ``least_quality`` whose worst band keeps ``least_jaccard`` from each to the next; jaccards are of neighbours."""
    worst = jaccards.groupBy(*keys, F.col("w2").alias("w")).agg(F.min("jaccard").alias("worst"))
    good = quality.where(F.col("quality") >= least_quality).join(worst, [*keys, "w"], "left")
    by = W.partitionBy(*keys).orderBy("w")  # one row per window of a chromosome
    cut = (F.coalesce(F.lag("w").over(by) + 1 != F.col("w"), F.lit(True)) | F.coalesce(F.col("worst") < least_jaccard, F.lit(True))).cast("int")
    c = good.withColumn("cut", cut).withColumn("chain", F.sum("cut").over(by)).groupBy(*keys, "chain").agg(F.min("w").alias("start"), F.max("w").alias("end"), F.count("*").alias("length"), F.avg("quality").alias("quality"))
    return c.where(F.col("length") >= least).drop("chain")


def partitions_of(spark, k: int) -> DataFrame:
    """(partition, i, j, same) for every way to part ``k`` bands, each numbered by its growth string; 15 ways for 4, 52 for 5."""
    ways: list[tuple] = [(0,)]
    for _ in range(k - 1):
        ways = [(*w, b) for w in ways for b in range(max(w) + 2)]
    rows = [("".join(map(str, w)), i, j, w[i] == w[j]) for w in ways for i in range(k) for j in range(i + 1, k)]
    return spark.createDataFrame(rows, "partition string, i int, j int, same boolean")


def partition_scores(pairs: DataFrame, parts: DataFrame, within: float = 0.10, most: int = 10) -> DataFrame:
    """Weighted agreement of each partition with the pairs' affinities, the best ones of each locus."""
    fit = F.when(F.col("same"), F.col("affinity")).otherwise(1 - F.col("affinity")) * F.col("weight")
    s = pairs.join(F.broadcast(parts), ["i", "j"]).groupBy("locus", "partition").agg(F.sum(fit).alias("fit"), F.sum("weight").alias("total_weight"))
    s = s.withColumn("score", F.when(F.col("total_weight") > 0, F.col("fit") / F.col("total_weight")))
    by = W.partitionBy("locus")  # a bounded number of partitions
    s = s.withColumns({"best": F.max("score").over(by), "place": F.row_number().over(by.orderBy(F.desc(F.round("score", 9)), "partition"))})
    return s.where((F.round("score", 9) >= F.round(F.col("best") - within, 9)) & (F.col("place") <= most)).select("locus", "partition", "score", "total_weight", "place")


def signed_groups(edges: DataFrame, nodes: DataFrame, least: float = 0.70) -> DataFrame:
    """Groups of nodes joined where |r| reaches ``least``, each with its sign against the group's first node.

    A node is doubled into a plus and a minus side; an edge of positive r joins
    equal sides, one of negative r opposite ones, and sides are components.
    """
    e = edges.where(F.abs("r") >= least)
    same = F.when(F.col("r") >= 0, 0).otherwise(1)
    side = lambda c, s: F.col(c) * 2 + s
    doubled = e.select(side("a", F.lit(0)).alias("a"), side("b", same).alias("b")).unionByName(e.select(side("a", F.lit(1)).alias("a"), side("b", 1 - same).alias("b")))
    c = components(doubled, nodes.select(F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node")))
    plus = c.where("node % 2 = 0").select(F.floor(F.col("node") / 2).alias("node"), F.floor(F.col("component") / 2).alias("grp"), F.when(F.col("component") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return plus


def set_pairs(members: DataFrame, keys: list) -> DataFrame:
    """(id1, id2, n_both, n1, n2) of sets (id, sample_id) within ``keys`` that share a sample."""
    size = members.groupBy("id").agg(F.count("*").alias("n"))
    right = members.select(*keys, "sample_id", F.col("id").alias("id2"))
    p = members.withColumnRenamed("id", "id1").join(right, [*keys, "sample_id"]).where("id1 < id2").groupBy("id1", "id2").agg(F.count("*").alias("n_both"))
    return p.join(size.withColumnsRenamed({"id": "id1", "n": "n1"}), "id1").join(size.withColumnsRenamed({"id": "id2", "n": "n2"}), "id2").withColumn("jaccard", F.col("n_both") / (F.col("n1") + F.col("n2") - F.col("n_both")))


def refine_regimes(members: DataFrame) -> DataFrame:
    """Per regime of members (regime, member, sign, band, sample_id): samples in hom_a, in hom_b of every member (exchanged where the sign is -1), and in het of any."""
    n = members.groupBy("regime").agg(F.count_distinct("member").alias("m"))
    band = F.when(F.col("sign") == -1, F.when(F.col("band") == "hom_a", "hom_b").when(F.col("band") == "hom_b", "hom_a").otherwise(F.col("band"))).otherwise(F.col("band"))
    t = members.withColumn("band", band).groupBy("regime", "band", "sample_id").agg(F.count_distinct("member").alias("hits")).join(n, "regime")
    return t.where((F.col("band") == "het") | (F.col("hits") == F.col("m"))).groupBy("regime", "band").agg(F.count("*").alias("n"), F.min("sample_id").alias("first"), F.max("sample_id").alias("last"))


def merge_per_chrom(tables: list[DataFrame]) -> DataFrame:
    """Regime tables of chromosomes under one key, chrom:id."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.withColumn("uid", F.concat_ws(":", "chrom", F.col("id").cast("string")))


def regime_topology(pairs: DataFrame, gap: int, related: float, chained: int = 3, chained_jaccard: float = 0.50, nested: float = 0.9) -> DataFrame:
    """Relation of two regimes (id1, id2, s1, e1, s2, e2, shared, jaccard): nested, overlapping_conflict, chained, adjacent or independent."""
    overlap = F.greatest(F.lit(0), F.least("e1", "e2") - F.greatest("s1", "s2"))
    between = F.when(overlap > 0, 0).otherwise(F.greatest(F.lit(0), F.greatest("s1", "s2") - F.least("e1", "e2")))
    small = F.least(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2"))
    held = F.when(small > 0, overlap / small).otherwise(0.0)
    kin = F.col("jaccard") >= related
    kind = F.when((held >= nested) & kin, "nested").when((overlap > 0) & ~kin, "overlapping_conflict").when((between <= gap) & (F.col("shared") >= chained) & (F.col("jaccard") >= chained_jaccard), "chained").when((between <= gap) & ~kin, "adjacent").otherwise("independent")
    return pairs.select("id1", "id2", overlap.alias("overlap_bp"), between.alias("gap_bp"), kind.alias("relation"))


def cross_chrom_links(members: DataFrame, chroms: DataFrame, least: int = 5, jaccard: float = 0.50) -> DataFrame:
    """Sets of different chromosomes that share ``least`` samples and reach the Jaccard."""
    p = set_pairs(members, [])
    p = p.join(chroms.withColumnsRenamed({"id": "id1", "chrom": "chrom1"}), "id1").join(chroms.withColumnsRenamed({"id": "id2", "chrom": "chrom2"}), "id2")
    return p.where((F.col("chrom1") != F.col("chrom2")) & (F.col("n_both") >= least) & (F.col("jaccard") >= jaccard)).select("id1", "id2", "n_both", "jaccard")


def interval_relations(pairs: DataFrame, gap: int = 500_000, least: float = 0.5) -> DataFrame:
    """Relation of two intervals by the Jaccards of their bands (id1, id2, gap_bp, inside, aa, bb, ab, ba, hh): swapped, extension, nested, shared_het or unrelated."""
    c = F.col
    straight, swapped = F.least("aa", "bb"), F.least("ab", "ba")
    near = c("gap_bp") <= gap
    kind = F.when(near & (swapped >= least) & (swapped > straight), "swapped").when(near & (straight >= least) & ~c("inside"), "extension").when(c("inside") & (straight >= least), "nested").when(c("hh") >= least, "shared_het").otherwise("unrelated")
    return pairs.select("id1", "id2", kind.alias("relation"))


def k_labels_table(bands: DataFrame, samples: DataFrame, envelopes: DataFrame, quality: DataFrame) -> DataFrame:
    """One row for each envelope and sample: bounds, family, used k, adaptive and fixed label, silhouette, flag."""
    out = bands.join(samples.select("sample_id", "family_id"), "sample_id", "left").join(envelopes, "env_id").join(quality, "env_id", "left")
    return out.select("env_id", "s0", "e0", "sample_id", "family_id", "used_k", "k", "fixed_k", "silhouette", "flag")


def merge_layers(base: DataFrame, layers: DataFrame, allowed: list) -> DataFrame:
    """Layer values (chrom, w, name, value, ord) for windows of ``base``: unknown names and other chromosomes are dropped, the first to be loaded stays."""
    first = W.partitionBy("chrom", "w", "name").orderBy("ord")
    return layers.where(F.col("name").isin(allowed)).join(base.select("chrom", "w"), ["chrom", "w"], "left_semi").withColumn("i", F.row_number().over(first)).where("i = 1").drop("i", "ord")
