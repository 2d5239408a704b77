"""One query for each operator, over the tables of a data folder, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import aggregates as A
from .operators import annotate as N
from .operators import clusters as C
from .operators import columns as B
from .operators import joins as J
from .operators import matrix as M
from .operators import ordered as O
from .operators import sets as S
from .functions.tails import chi_square_tail
from .plans import regimes
from .registry import QUERIES, SQL, query
from .views import Views

_HOUR, _DAY = 3600, 64


def _mod_groups(df: DataFrame) -> DataFrame:
    return df.select("sample_id", (F.col("sample_id") % 3).cast("int").alias("grp")).distinct()


_MEANS = ", f as (select sample_id, avg(dosage) as mean, count(dosage) as n from dosage group by 1)"
_PAIRS = ", pr as (select a.w, a.sample_id, a.k as a, b.k as b from per_window a join per_window b on b.w = a.w + 1 and b.sample_id = a.sample_id), ct as (select w, a, b, count(*) as n from pr group by all)"


@query("select chrom, w, (end_bp - start_bp) / 1000.0 as span_kb, round(n_snps / ((end_bp - start_bp) / 1000.0), 9) as density, round((start_bp + end_bp) / 2.0 / 1e6, 9) as mb, round(abs(z), 9) as abs_z, round(case when lam2 > 0 then lam1 / lam2 end, 9) as ratio from windows")
def window_summary_rows(v: Views) -> DataFrame:
    return B.window_summary_rows(v.windows)


@query("select chrom, w, (end_bp - start_bp) / 1000.0 as span_kb, round(n_snps / ((end_bp - start_bp) / 1000.0), 9) as density, round((start_bp + end_bp) / 2.0 / 1e6, 9) as mb, round(abs(z), 9) as abs_z, round(case when lam2 > 0 then lam1 / lam2 end, 9) as ratio from windows where abs(z) >= 1")
def window_summary_filter(v: Views) -> DataFrame:
    return B.window_summary_filter(B.window_summary_rows(v.windows), 1.0)


@query("select chrom, w, n_snps::double as density, 'n_snps' as source from windows")
def snp_density_value(v: Views) -> DataFrame:
    return B.snp_density_value(v.windows)


@query(_MEANS + " select sample_id, case when mean <= 0.4 then 'homA_like' when mean between 0.6 and 1.4 then 'het_like' when mean >= 1.6 then 'homB_like' else 'uncertain' end as call, round(least(1.0, greatest(0.0, least(abs(mean - 0.5), abs(mean - 1.5)) / 0.5)), 9) as confidence, case when n < 5 then 'AMBIGUOUS_DOSAGE' when mean <= 0.3 then 'HOM_REF' when mean between 0.7 and 1.3 then 'HET' when mean >= 1.7 then 'HOM_INV' else 'AMBIGUOUS_DOSAGE' end as tier from f")
def dosage_calls(v: Views) -> DataFrame:
    """regime_call_from_mean, margin_confidence and classify_dosage_mean of each sample."""
    f, m = A.sample_dosage_features(v.dosage), F.col("mean")
    return f.select("sample_id", B.regime_call_from_mean(m).alias("call"), B.margin_confidence(m).alias("confidence"), B.classify_dosage_mean(m, F.col("n")).alias("tier"))


@query("select id, case when (end_bp - start_bp) * 1e5 < 2e6 then 'local' when (end_bp - start_bp) * 1e5 < 1e7 then 'regional' when (end_bp - start_bp) * 1e5 < 5e7 then 'long_range' else 'chromosome_scale' end as bucket from intervals")
def persistence_bucket(v: Views) -> DataFrame:
    return v.intervals.select("id", B.persistence_bucket((F.col("end_bp") - F.col("start_bp")) * 1e5).alias("bucket"))


@query(", x as (select *, row_number() over (partition by chrom, start_bp // 100, end_bp // 100 order by start_bp, end_bp, id) - 1 as n from intervals) select id, chrom || '.' || (start_bp // 100)::varchar || '-' || (end_bp // 100)::varchar || 'Mb.' || case when n < 26 then chr((65 + n)::int) else chr((65 + n // 26 - 1)::int) || chr((65 + n % 26)::int) end as name from x")
def candidate_display_names(v: Views) -> DataFrame:
    return B.candidate_display_names(v.intervals, 100.0)


@query("select candidate_id, ['H1/H1', 'H1/H2', 'H2/H2'][k + 1] as grp, count(*) as n, list_sort(list(sample_id))[1] as first, max(sample_id) as last from calls group by candidate_id, k")
def regime_groups_from_calls(v: Views) -> DataFrame:
    return B.regime_groups_from_calls(v.calls).select("candidate_id", "grp", "n", F.col("members")[0].alias("first"), F.element_at("members", -1).alias("last"))


@query("select 'S' || sample_id::varchar as sample_id, candidate_id as inversion_id, ['0/0', '0/1', '1/1'][k + 1] as karyotype, 'high' as quality from calls")
def karyotype_tsv_export(v: Views) -> DataFrame:
    return B.karyotype_export(v.calls)


@query(", p as (select candidate_id, sample_id % 4 as pop, count(*) as n, avg(k) / 2 as freq from calls group by all), g as (select candidate_id, count(*) filter (n >= 5) as pops, count(*) filter (n >= 5 and freq >= 0.05) as c, count(*) filter (n >= 5 and freq >= 0.5) as m from p group by 1) select candidate_id, case when pops = 0 then 'unknown' when c / pops >= 0.85 and m / pops >= 0.85 then 'general' when c / pops <= 0.2 then 'private' else 'co_shared' end as pangenome_class from g")
def pangenome_class(v: Views) -> DataFrame:
    p = v.calls.groupBy("candidate_id", (F.col("sample_id") % 4).alias("pop")).agg(F.count("*").alias("n"), (F.avg("k") / 2).alias("freq"))
    return B.pangenome_class(p)


@query("select w.chrom, w.w, count(p.pos_bp) as n, count(distinct p.pos_bp) as n_positions from windows w left join points p on p.chrom = w.chrom and p.pos_bp between w.start_bp and w.end_bp group by all")
def window_snp_membership(v: Views) -> DataFrame:
    return J.window_snp_membership(v.windows, v.points, _HOUR)


@query("select distinct p.chrom, p.pos_bp from windows w join points p on p.chrom = w.chrom and p.pos_bp between w.start_bp and w.end_bp where w.w between 10 and 200")
def unique_snps_in_window_range(v: Views) -> DataFrame:
    return J.unique_snps_in_window_range(v.windows, v.points, 10, 200, _HOUR)


@query(", p as (select distinct chrom, pos_bp from points) select p.chrom, p.pos_bp, w.w from p asof join windows w on p.chrom = w.chrom and p.pos_bp >= w.start_bp where p.pos_bp <= w.end_bp")
def point_in_window_lookup(v: Views) -> DataFrame:
    return J.point_in_window_lookup(v.points, v.windows)


def _zones(v: Views) -> DataFrame:
    return v.windows.where("n_snps >= 5").select(F.col("w").alias("id"), "chrom", (F.col("start_bp") - 5000).alias("start_bp"), (F.col("end_bp") + 5000).alias("end_bp"))


@query(", z as (select w as id, chrom, start_bp - 5000 as start_bp, end_bp + 5000 as end_bp from windows where n_snps >= 5) select z.id, z.chrom, w.w from z join windows w on w.chrom = z.chrom and (w.start_bp + w.end_bp) / 2.0 between z.start_bp and z.end_bp")
def windows_in_range(v: Views) -> DataFrame:
    return J.windows_in_range(_zones(v), v.windows, _HOUR)


@query(", z as (select w as id, chrom, start_bp - 5000 as start_bp, end_bp + 5000 as end_bp from windows where n_snps >= 5) select z.id, z.chrom, count(*) as n from z join points p on p.chrom = z.chrom and p.pos_bp between z.start_bp and z.end_bp group by all")
def sv_anchors_in_zone(v: Views) -> DataFrame:
    return J.points_in(_zones(v), v.points, _HOUR).groupBy("id", "chrom").agg(F.count("*").alias("n"))


@query(", i as (select i.*, o_custkey as owner from intervals i join orders on id = o_orderkey) select a.id, b.id as id2, least(a.end_bp, b.end_bp) - greatest(a.start_bp, b.start_bp) as overlap_bp, a.start_bp <= b.start_bp and a.end_bp >= b.end_bp as contains, b.start_bp <= a.start_bp and b.end_bp >= a.end_bp as inside from i a join i b on a.id < b.id and a.owner = b.owner and a.start_bp < b.end_bp and b.start_bp < a.end_bp")
def interval_overlap_pairs(v: Views) -> DataFrame:
    """Pairs of one owner's intervals, which is what the pairs are asked for."""
    owner = v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("chrom"))
    return J.interval_overlap_pairs(v.intervals.drop("chrom").join(owner, "id"), 64)


@query(", i as (select * from intervals), m as (select a.id, count(distinct b.source) as k from i a join (select distinct chrom, source, start_bp, end_bp from i) b on a.source <> b.source and a.chrom = b.chrom and a.start_bp <= b.end_bp and b.start_bp <= a.end_bp group by 1) select source, count(*) as n, count(*) filter (k is null) as n_none, count(*) filter (k = (select count(distinct source) - 1 from i)) as n_all from i left join m using (id) group by 1")
def source_overlap_counts(v: Views) -> DataFrame:
    return J.source_overlap_counts(v.intervals)


@query("select id, greatest(0.0, least(2500.0, start_bp - case when end_bp - start_bp > 100 then greatest(50.0, (end_bp - start_bp) / 2.0) else 50.0 end)) as scan_start, greatest(0.0, least(2500.0, end_bp + case when end_bp - start_bp > 100 then greatest(50.0, (end_bp - start_bp) / 2.0) else 50.0 end)) as scan_end from intervals")
def boundary_scan_range(v: Views) -> DataFrame:
    return J.boundary_scan_range(v.intervals, 50, 2500)


@query("select chrom, round(least(1.0, sum(greatest(0, least(end_bp, 1500) - greatest(start_bp, 1400))) / 100), 9) as fraction from intervals group by 1")
def roh_fraction_in_interval(v: Views) -> DataFrame:
    return J.fraction_in_interval(v.intervals, 1400, 1500, "chrom")


@query("select sample_id, round(avg(dosage), 9) as mean, round(avg((dosage > 0.5 and dosage <= 1.5)::int), 9) as het_share, count(dosage) as n from dosage group by 1")
def sample_dosage_features(v: Views) -> DataFrame:
    return A.sample_dosage_features(v.dosage)


@query("select sample_id, round(count(*) filter (round(dosage) = 1) / count(*), 9) as het_rate, count(*) as n from dosage where pos_bp between 5000 and 40000 group by 1")
def het_rate_for_range(v: Views) -> DataFrame:
    return A.het_rate_for_range(v.dosage.withColumn("dosage", F.round("dosage")), 5000, 40000)


@query("select sample_id, round(avg(dosage), 9) as mean, count(*) as n from dosage where pos_bp between 5000 and 40000 group by 1")
def dosage_mean_for_range(v: Views) -> DataFrame:
    return A.dosage_mean_for_range(v.dosage, 5000, 40000)


@query(", m as (select marker, var_pop(dosage) as variance from dosage group by 1), r as (select *, row_number() over (order by variance) - 1 as i, count(*) over () as n from m) select marker, round(variance, 9) as variance from m where variance >= (select variance from r where i = n // 2)")
def high_variance_markers(v: Views) -> DataFrame:
    return A.high_variance_markers(v.dosage)


@query("select sample_id, round(avg(value), 9) as mean, round(median(value), 9) as median, count(value) as n from per_window where w between 2 and 6 group by 1")
def panel_range_mean_median(v: Views) -> DataFrame:
    """Also sample_mean_over_windows."""
    return A.mean_median_in_range(v.track, 2, 6)


@query("select chrom, round(sum(lam2 * n_snps) / sum(n_snps), 9) as mean from windows group by 1")
def weighted_window_mean(v: Views) -> DataFrame:
    return A.weighted_window_mean(v.windows, "lam2", "n_snps")


@query("select chrom, count(*) as n_windows, round(avg(lam1), 9) as mean, round(max(lam1), 9) as max from windows group by 1")
def fst_window_summary(v: Views) -> DataFrame:
    return A.fst_window_summary(v.windows, "lam1")


@query(_PAIRS + " select * from ct")
def contingency_table(v: Views) -> DataFrame:
    return A.contingency_table(A.label_pairs(v.labels), ["w"])


_SCORES = """
, t as (select *, sum(n) over (partition by w, a) as ra, sum(n) over (partition by w, b) as cb, sum(n) over (partition by w) as t from ct),
s as (select w, max(t)::bigint as n, count(distinct a) as r, count(distinct b) as c, sum(n * n / (ra * cb)) as q, sum(n * (n - 1) / 2) as same, sum((ra - 1) / 2 * n) as sa, sum((cb - 1) / 2 * n) as sb,
 sum(n / t * ln(n * t / (ra * cb))) as i, -sum(n / t * ln(ra / t)) as ha, -sum(n / t * ln(cb / t)) as hb from t group by w),
sc as (select w, n, n * (q - 1) as chi2, (r - 1) * (c - 1) as df, case when n < 2 then null when least(r, c) < 2 then 0.0 else least(1.0, sqrt(greatest(0.0, n * (q - 1) / (n * (least(r, c) - 1))))) end as v,
 case when abs((sa + sb) / 2 - coalesce(sa * sb / nullif(n * (n - 1) / 2, 0), 0)) < 1e-12 then 1.0 else (same - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) end as ari,
 case when ha + hb > 0 then 2 * i / (ha + hb) else 1.0 end as nmi, case when ha * hb > 0 then i / sqrt(ha * hb) else 0.0 end as nmi_geometric from s)
"""


@query(_PAIRS + _SCORES + " select w, n, round(chi2, 9) as chi2, df, round(v, 9) as v, round(ari, 9) as ari, round(nmi, 9) as nmi, round(nmi_geometric, 9) as nmi_geometric from sc")
def contingency_scores(v: Views) -> DataFrame:
    """cramers_v, chi_square_test, adjusted_rand_index (block_transition_ari) and mutual_information_scores."""
    return A.contingency_scores(A.contingency_table(A.label_pairs(v.labels), ["w"]), ["w"])


@query(_PAIRS + ", s as (select *, n / sum(n) over (partition by w, a) as share from ct), f as (select w, count(*) as n_fused from (select w, b from s where share >= 0.8 group by all having count(*) >= 2) group by 1), p as (select w, count(*) as n_split from (select w, a from s where share >= 0.2 group by all having count(*) >= 2) group by 1) select w, coalesce(n_fused, 0) as n_fused, coalesce(n_split, 0) as n_split from (select distinct w from ct) left join f using (w) left join p using (w)")
def fuse_and_split_events(v: Views) -> DataFrame:
    return A.fuse_and_split_events(A.contingency_table(A.label_pairs(v.labels), ["w"]), ["w"])


@query(_PAIRS + " select w, round(avg((a = b)::int), 9) as concordance, case when avg((a = b)::int) >= 0.85 then 'MERGE' else 'SEPARATE' end as verdict from pr group by 1")
def restricted_concordance(v: Views) -> DataFrame:
    return A.restricted_concordance(A.label_pairs(v.labels), ["w"])


@query(_PAIRS + ", p as (select *, n / sum(n) over (partition by w, a) as p, row_number() over (partition by w, a order by n desc, b) as r from ct) select w, a, max(b) filter (r = 1) as mode, round(-sum(p * ln(p)), 9) as entropy, round(1 + sum(p * ln(p)) / ln(3), 9) as concentration from p group by w, a")
def band_fingerprint(v: Views) -> DataFrame:
    return A.band_fingerprint(A.contingency_table(A.label_pairs(v.labels), ["w"]), ["w"], 3)


_CAND = ", pr as (select (a.candidate_id * 100000 + b.candidate_id) as w, a.sample_id, a.k as a, b.k as b from calls a join calls b on a.sample_id = b.sample_id and a.candidate_id < b.candidate_id), ct as (select w, a, b, count(*) as n from pr group by all)"


@query(_CAND + _SCORES + " select w // 100000 as c1, w % 100000 as c2, n, round(chi2, 9) as chi2, df, round(v, 9) as v, case when n < 20 then 'insufficient_data' when df >= 1 and chi2 > [3.841458821, 5.991464547, 7.814727903, 9.487729037][greatest(1, least(df, 4))] and v >= 0.5 then 'strong' when df >= 1 and chi2 > [3.841458821, 5.991464547, 7.814727903, 9.487729037][greatest(1, least(df, 4))] and v >= 0.2 then 'weak' else 'independent' end as strength from sc")
def co_occurrence_strength(v: Views) -> DataFrame:
    """Also the V of cross_candidate_matrix with non-empty denominators."""
    s = A.co_occurrence_strength(A.candidate_scores(v.calls))
    return s.select("c1", "c2", "n", "chi2", "df", "v", "strength")


@query(_PAIRS + ", m as (select w, a, max(n) as m, sum(n) as n from ct group by all) select w, round(sum(m) / sum(n), 9) as agreement, sum(n)::bigint as n from m group by 1")
def label_concordance_two_sources(v: Views) -> DataFrame:
    return A.label_concordance(A.contingency_table(A.label_pairs(v.labels), ["w"]), ["w"])


@query(", n as (select w, k, count(*) as n from per_window group by all), p as (select *, n / sum(n) over (partition by w) as p from n) select w, round(case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) else 0 end, 9) as entropy from p group by 1")
def shannon_entropy(v: Views) -> DataFrame:
    return A.shannon_entropy(v.labels, ["w"])


@query(", m as (select test_id, quantile_disc(value, 0.5) as median, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from measures group by 1), d as (select test_id, quantile_disc(abs(value - median), 0.5) as mad from measures join m using (test_id) group by 1) select test_id, round(median, 9) as median, round(mad, 9) as mad, round(q1, 9) as q1, round(q3, 9) as q3 from m join d using (test_id)")
def robust_stats(v: Views) -> DataFrame:
    return A.robust_stats(v.measures, ["test_id"], "value")


_RANKS = """
, r as (select test_id, grp, value, rank() over (partition by test_id order by value) + (count(*) over (partition by test_id, value) - 1) / 2 as rank from {0}),
ti as (select test_id, sum(t * t * t - t) as ties, sum(t) as n from (select test_id, value, count(*)::double as t from {0} group by all) group by 1)
"""


@query(_RANKS.format("measures") + ", g as (select test_id, grp, sum(rank) as s, count(*) as m from r group by all), h as (select test_id, sum(s * s / m) as q, count(*) as groups from g group by 1) select test_id, n::bigint as n, groups - 1 as df, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 9) as h, round(exp(-(12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) / 2), 9) as p from h join ti using (test_id) where groups = 3")
def kruskal_wallis(v: Views) -> DataFrame:
    k = A.kruskal_wallis(v.measures, ["test_id"])
    return k.withColumn("p", chi_square_tail(F.col("h"), F.col("df")))


_NORMAL = "least(1.0, 2 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) * exp(-x * x / 2) / sqrt(2 * pi()))"
_WILCOXON = (
    ", two as (select * from measures where grp in ('F', 'O'))"
    + _RANKS.format("two")
    + f""", s as (select test_id, sum(rank) filter (grp = 'F') as w, count(*) filter (grp = 'F')::double as n1, count(*) filter (grp = 'O')::double as n2 from r group by 1),
u as (select test_id, w - n1 * (n1 + 1) / 2 as u, n1 * n2 / 2 as mid, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) as sd from s join ti using (test_id)),
z as (select *, sign(u - mid) * greatest(0, abs(u - mid) - 0.5) / sd as z, abs(sign(u - mid) * greatest(0, abs(u - mid) - 0.5) / sd) as x from u), y as (select *, 1 / (1 + 0.2316419 * x) as t from z),
wx as (select test_id, u, z, {_NORMAL} as p, case when u > mid then 'greater' when u < mid then 'less' else 'equal' end as direction from y)"""
)


@query(_WILCOXON + " select test_id, round(u, 9) as u, round(z, 9) as z, round(p, 9) as p, direction from wx")
def wilcoxon_rank_sum(v: Views) -> DataFrame:
    return A.wilcoxon_rank_sum(v.measures, ["test_id"], "F", "O")


@query(_WILCOXON + ", b as (select *, p * count(*) over () / row_number() over (order by p, test_id) as raw, row_number() over (order by p, test_id) as i from wx) select test_id, round(p, 9) as p, round(least(1.0, min(raw) over (order by i desc rows unbounded preceding)), 9) as fdr from b")
def benjamini_hochberg(v: Views) -> DataFrame:
    return A.benjamini_hochberg(A.wilcoxon_rank_sum(v.measures, ["test_id"], "F", "O").select("test_id", "p"))


@query(
    """, gl as (select l_suppkey as sv_id, l_partkey as sample_id, case when arg_min(l_tax, l_orderkey * 100 + l_linenumber) = 0 then -1 else case arg_min(l_returnflag, l_orderkey * 100 + l_linenumber) when 'A' then 0 when 'N' then 1 else 2 end end as k from lineitem group by all),
gg as (select gl.*, case ancestry when 'BUILDING' then 0 when 'HOUSEHOLD' then 1 when 'MACHINERY' then 2 end as g from gl join samples using (sample_id)),
gc as (select sv_id, """
    + ", ".join(f"count(*) filter (g = {g} and k = {w}) as {c}{g}" for g in range(3) for c, w in (("aa", 0), ("ab", 1), ("bb", 2), ("miss", -1)))
    + """ from gg where g is not null group by 1),
ga as (select *, aa0 + ab0 as a, bb0 as b, aa2 + ab2 as c, bb2 as d from gc where greatest(ab0 + bb0, ab1 + bb1, ab2 + bb2) >= 5),
gx as (select sv_id, a, a + b as r, a + c as s, a + b + c + d as n, unnest(range(greatest(0, a + b + a + c - (a + b + c + d))::bigint, least(a + b, a + c)::bigint + 1)) as x from ga),
gp as (select sv_id, x, x = a as seen, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(s - x + 1) - lgamma(n - r - s + x + 1) - lgamma(n + 1) + lgamma(s + 1) + lgamma(n - s + 1) as lp from gx),
gf as (select sv_id, round(sum(case when lp <= top + 1e-9 then exp(lp) else 0 end) / sum(exp(lp)), 12) as p from (select *, max(case when seen then lp end) over (partition by sv_id) as top from gp) group by 1),
gr as (select *, row_number() over (order by p, sv_id) as i, count(*) over () as m from gf), gq as (select sv_id, p, least(1.0, min(p * m / i) over (order by i desc)) as fdr from gr),
gz as (select s_suppkey as sv_id, ['left_boundary', 'inversion_body', 'right_boundary', 'flank', 'inversion_body'][n_regionkey + 1] as zone from supplier join nation on s_nationkey = n_nationkey),
gt as (select ga.*, p, fdr, round(fdr, 9) as f, zone, (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)) as odds, """
    + ", ".join(f"ab{g} / greatest(1, aa{g} + ab{g} + bb{g} + miss{g}) as h{g}" for g in range(3))
    + """ from ga join gq using (sv_id) left join gz using (sv_id))
select sv_id, zone, """
    + ", ".join(f"{c}{g}" for g in range(3) for c in ("aa", "ab", "bb", "miss"))
    + """, round(odds, 9) as odds, round(p, 9) as p, f as fdr, case when f >= 0.10 then 'uninformative' when zone in ('left_boundary', 'right_boundary') and f < 0.05 and odds > 20 then 'canonical_breakpoint_marker' when f < 0.05 and odds > 5 then 'dominant_presence_marker' when f < 0.05 and h1 > 0.6 and h0 < 0.2 and h2 < 0.2 then 'het_specific_marker' when zone = 'inversion_body' and f < 0.05 then 'sub_haplotype_marker' when zone = 'inversion_body' then 'internal_linked_marker' else 'uninformative' end as pattern from gt"""
)
def sv_genotype_counts(v: Views) -> DataFrame:
    """Suppliers as variants, their region the zone; segments as groups; a call is missing where the line's tax is nothing."""
    line = F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_tax")
    g = v.table("lineitem").groupBy(F.col("l_suppkey").alias("sv_id"), F.col("l_partkey").alias("sample_id")).agg(F.min(line).alias("m"))
    flag = F.create_map(*(F.lit(x) for x in ("A", 0, "N", 1, "R", 2)))
    grp = F.create_map(*(F.lit(x) for x in ("BUILDING", "H1/H1", "HOUSEHOLD", "H1/H2", "MACHINERY", "H2/H2")))
    calls = g.select("sv_id", "sample_id", F.when(F.col("m.l_tax") == 0, -1).otherwise(flag[F.col("m.l_returnflag")]).alias("k")).join(v.samples.select("sample_id", grp[F.col("ancestry")].alias("grp")), "sample_id")
    zone = F.get(F.array(*map(F.lit, ("left_boundary", "inversion_body", "right_boundary", "flank", "inversion_body"))), F.col("n_regionkey").cast("int"))
    zones = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sv_id"), zone.alias("zone"))
    return A.genotype_counts(calls, zones)


@query(", f as (select sample_id, bool_or(k = 0) as any_a, bool_or(k = 1) as any_n, bool_or(k = 2) as any_r from calls group by 1) select any_a, any_n, any_r, count(*) as n, min(sample_id) as first from f where any_a or any_n or any_r group by all")
def evidence_combinations(v: Views) -> DataFrame:
    f = v.calls.groupBy("sample_id").agg(*(F.bool_or(F.col("k") == k).alias(n) for k, n in enumerate(("any_a", "any_n", "any_r"))))
    return A.evidence_combinations(f, ["any_a", "any_n", "any_r"])


@query(", r as (select k, coalesce(ancestry, 'unknown') as ancestry, count(*) as n from per_window left join samples using (sample_id) group by all) select k, ancestry, n, round(n / sum(n) over (partition by k), 9) as share from r")
def band_composition(v: Views) -> DataFrame:
    return A.band_composition(v.labels, v.samples, "ancestry")


@query(", r as (select l_suppkey as candidate_id, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as k, l_quantity as value from lineitem), s as (select candidate_id, avg(value) as a, avg(value) filter (k = 0) as m0, avg(value) filter (k = 2) as m2, count(*) filter (k = 0) as n0, count(*) filter (k = 2) as n2 from r group by 1) select candidate_id, round(case when n0 >= n2 then m0 else m2 end, 9) as mode_mean, round(a, 9) as all_mean, round(1 - case when n0 >= n2 then m0 else m2 end / a, 9) as fraction_reduction from s")
def homokaryotype_vs_all(v: Views) -> DataFrame:
    k = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return A.homokaryotype_vs_all(v.table("lineitem").select(F.col("l_suppkey").alias("candidate_id"), k.alias("k"), F.col("l_quantity").alias("value")))


@query(", r as (select ancestry, count(*) filter (k = 0) as n0, count(*) filter (k = 1) as n1, count(*) filter (k = 2) as n2, count(*) as n from calls join samples using (sample_id) group by rollup (ancestry)) select coalesce(ancestry, 'TOTAL') as ancestry, n0, n1, n2, n, round(n1 / n, 9) as het_share from r")
def carrier_by_cluster_table(v: Views) -> DataFrame:
    return A.carrier_by_cluster(v.calls, v.samples)


@query(", c as (select candidate_id, 1 - avg(k) / 2 as p from calls group by 1) select candidate_id, round(p, 9) as p, round(least(p, 1 - p), 9) as maf, case when p < 0.5 then 'STD' when p > 0.5 then 'INV' else 'tie' end as minor from c")
def arrangement_maf(v: Views) -> DataFrame:
    return A.arrangement_maf(v.calls)


@query(", n as (select sample_id, k, count(*) as n from calls group by all), m as (select sample_id, max(n) as m, sum(n) as t from n group by 1) select m.sample_id, case when count(*) = 1 and any_value(m.m) / any_value(t) >= 0.5 then max(k) end as vote, round(any_value(m.m) / any_value(t), 9) as share from m join n on n.sample_id = m.sample_id and n.n = m.m group by 1")
def arrangement_vote(v: Views) -> DataFrame:
    return A.arrangement_vote(v.calls)


@query("select case when end_bp - start_bp < 30 then 0 when end_bp - start_bp < 60 then 1 when end_bp - start_bp < 90 then 2 else 3 end as bin, count(*) as n, round(avg(end_bp - start_bp), 9) as mean_span from intervals group by 1")
def length_bin_aggregate(v: Views) -> DataFrame:
    return A.length_bins(v.intervals, (30, 60, 90))


@query(", n as (select k, count(*) as n from per_window group by 1) select k, n, round(n / sum(n) over (), 9) as share from n")
def regime_proportions(v: Views) -> DataFrame:
    return A.proportions(v.labels)


@query("select sample_id, round(stddev_samp(value), 9) as sigma, count(value) as n from per_window group by 1 having count(value) >= 2")
def sigma_profile(v: Views) -> DataFrame:
    return A.sigma_profile(v.track)


@query(", r as (select w, k, family_id, count(*) as n from per_window join samples using (sample_id) group by all), b as (select w, k, max(n) as top, sum(n) as n from r group by all) select w, round(sum(top) / sum(n), 9) as purity, sum(n)::bigint as n from b group by 1")
def family_purity(v: Views) -> DataFrame:
    return A.family_purity(v.labels, v.samples)


@query(", s as (select sample_id, avg(value) filter (w < 5) as x, avg(value) filter (w >= 5) as y from per_window group by 1) select round(corr(x, y), 9) as r, count(*) as n, corr(x, y) >= 0.60 as coherent from s where x is not null and y is not null")
def split_half_coherence(v: Views) -> DataFrame:
    return A.split_half_coherence(v.track, 5)


_CUSUM = ", cs as (select w, sample_id, sum(d) over (partition by sample_id order by w rows unbounded preceding) as cusum from (select w, sample_id, value - avg(value) over (partition by w) as d from per_window))"


@query(_CUSUM + " select w, sample_id, round(cusum, 9) as cusum from cs")
def cusum(v: Views) -> DataFrame:
    return O.cusum(v.track)


@query(_CUSUM + " select (sample_id % 3)::int as grp, w, round(avg(cusum), 9) as mean, round(median(cusum), 9) as median from cs group by all")
def cusum_by_group(v: Views) -> DataFrame:
    return O.cusum_by_group(O.cusum(v.track), _mod_groups(v.track))


@query("select w, sample_id, round(quantile_disc(value, 0.5) over (partition by sample_id order by w rows between 1 preceding and 1 following), 9) as median from per_window")
def rolling_median(v: Views) -> DataFrame:
    return O.rolling_median(v.track)


@query("select w, sample_id, round(avg(value) over (partition by sample_id order by w rows between 1 preceding and 1 following), 9) as mean from per_window")
def smooth_trajectories(v: Views) -> DataFrame:
    return O.moving_mean(v.track)


_RUNS = ", n as (select *, (k is distinct from lag(k) over (partition by sample_id order by w))::int as new from per_window), q as (select *, sum(new) over (partition by sample_id order by w rows unbounded preceding) as run from n), rl as (select sample_id, max(k) as k, min(w) as start, count(*) as length from q group by sample_id, run)"


@query(_RUNS + " select * from rl")
def run_length_encode(v: Views) -> DataFrame:
    return O.run_length_encode(v.labels)


@query(_RUNS + ", x as (select *, lag(k) over (partition by sample_id order by start) as b, lead(k) over (partition by sample_id order by start) as a from rl), s as (select sample_id, count(*) filter (a = b and length >= 2) as returns, count(*) - 1 as switches from x group by 1) select *, case when switches = 0 then 'stable' when returns >= 2 then 'nested' when returns = 1 then 'recombinant_tract' when switches = 1 then 'two_adjacent' else 'complex' end as architecture from s")
def return_switches(v: Views) -> DataFrame:
    """Also architecture_class."""
    return O.return_switches(O.run_length_encode(v.labels))


_SIGN = ", g as (select w, (sample_id % 3)::int as grp, avg(value) as m from per_window group by all), sg as (select w, string_agg(grp::varchar, '>' order by m desc, grp) as signature from g group by 1)"


@query(_SIGN + " select * from sg")
def band_argsort_signature(v: Views) -> DataFrame:
    return O.signatures(v.track, _mod_groups(v.track))


@query(_SIGN + " select signature, min(w) as first, count(*) as n, (row_number() over (order by min(w), signature))::int as id from sg group by 1")
def regime_ids_first_seen(v: Views) -> DataFrame:
    return O.first_seen_ids(O.signatures(v.track, _mod_groups(v.track)))


@query(_PAIRS + ", c as (select w, avg((a = b)::int) >= 0.33 as ok from pr group by 1), s as (select *, sum((not ok)::int) over (order by w) as run from c) select min(w) as start, max(w) + 1 as end, max(w) - min(w) + 2 as length from s where ok group by run")
def merge_runs_from_verdicts(v: Views) -> DataFrame:
    return O.merge_runs(A.restricted_concordance(A.label_pairs(v.labels), ["w"], 0.33))


@query(", n as (select *, count(*) over (partition by chrom) as n, count(*) filter (abs(z) >= 2) over (partition by chrom) as hits, row_number() over (partition by chrom order by abs(lam2) desc, w) as r from windows) select chrom, w, round(z, 9) as z from n where case when hits > 0 then abs(z) >= 2 else r <= greatest(1, floor(n * 0.01)) end")
def xpehh_outliers(v: Views) -> DataFrame:
    return O.outliers(v.windows)


@query(", n as (select w, k, count(*) as n from per_window group by all), t as (select *, sum(n) over (partition by w) as t from n), h as (select w, max(t)::bigint as n, -sum(n / t * ln(n / t)) / ln(3) as e from t group by 1) select w, n, round(e, 9) as entropy, case when n < 3 then 'sparse' when e <= 0.40 then 'co_seg' when e >= 0.85 then 'fanned' else 'partial' end as regime from h")
def track_entropy_regimes(v: Views) -> DataFrame:
    return O.entropy_regimes(v.labels)


@query(", s as (select w, stddev_samp(value) as sd from per_window group by 1), x as (select w, w - row_number() over (order by w) as run from s where sd > 1.1 * (select quantile_cont(sd, 0.25) from s)) select min(w) as start, max(w) as end, count(*) as length from x group by run")
def split_ranges(v: Views) -> DataFrame:
    return O.spread_runs(v.track)


@query(", m as (select marker, var_pop(dosage) as variance from dosage group by 1) select marker, round(variance, 9) as variance from m order by m.variance desc, marker limit 12")
def top_markers(v: Views) -> DataFrame:
    """Also select_markers by highest variance."""
    return O.top_markers(A.marker_variance(v.dosage).select("marker", "variance"), 12)


@query(", p as (select distinct chrom, pos_bp from points), e as (select chrom, min(pos_bp) as lo, max(pos_bp) as hi from p group by 1), i as (select chrom, lo + (hi - lo) / 20 * (t + 0.5) as x from e, range(20) r(t)), d as (select i.chrom, i.x, p.pos_bp, row_number() over (partition by i.chrom, i.x order by abs(p.pos_bp - i.x), p.pos_bp) as r from i join p on p.chrom = i.chrom) select distinct chrom, pos_bp from d where r = 1")
def thin_positions(v: Views) -> DataFrame:
    return O.thin_positions(v.points, 20)


@query(", m as (select distinct w * 10 + k as set_id, sample_id from per_window), s as (select set_id, count(*) as n from m group by 1), p as (select a.set_id as s1, b.set_id as s2, count(*) as both_ from m a join m b on a.sample_id = b.sample_id and a.set_id < b.set_id group by all) select s1, s2, both_ as \"both\", round(both_ / (x.n + y.n - both_), 9) as jaccard from p join s x on x.set_id = s1 join s y on y.set_id = s2")
def set_jaccard(v: Views) -> DataFrame:
    return S.set_jaccard(v.labels.select((F.col("w") * 10 + F.col("k")).alias("set_id"), "sample_id"))


@query("select sample_id, min(k) as k from per_window where w between 3 and 4 group by 1 having count(*) = 2 and min(k) = max(k)")
def locus_band_sets_intersection(v: Views) -> DataFrame:
    return S.in_every_window(v.labels, 3, 4)


@query(", n as (select sample_id, k, count(*) as n from per_window group by all), r as (select *, sum(n) over (partition by sample_id) as t, row_number() over (partition by sample_id order by n desc, k) as r from n) select sample_id, k, n from r where r = 1 and n >= ceil(t * 0.5)")
def locus_band_sets_majority(v: Views) -> DataFrame:
    return S.majority_band(v.labels)


@query("select distinct w, sample_id from per_window where k in (0, 2)")
def macro_band_union(v: Views) -> DataFrame:
    return S.macro_band_union(v.labels, (0, 2))


@query("select sample_id, ancestry from samples where ancestry <> 'BUILDING'")
def peel_stratum(v: Views) -> DataFrame:
    return S.peel_stratum(v.samples, "BUILDING")


@query(", s as (select sample_id, avg((k = 0)::int) as a, avg((k = 2)::int) as b from per_window group by 1) select sample_id, case when a >= 0.5 and a >= b then 'A' else 'B' end as anchor from s where a >= 0.5 or b >= 0.5")
def hom_anchor_consensus(v: Views) -> DataFrame:
    return S.hom_anchor_consensus(v.labels)


_Z = ", st as (select grp, marker, avg(dosage) as m, var_pop(dosage) as v, count(*) as n from dosage group by all), zs as (select d.grp, d.marker, d.pos_bp, d.sample_id, case when v > 1e-12 then (dosage - m) / sqrt(v) else 0 end as z, m / 2 as maf, n from dosage d join st on st.grp = d.grp and st.marker = d.marker)"
_LD = _Z + ", lp as (select a.grp, a.marker as i, b.marker as j, max(b.pos_bp - a.pos_bp) as distance, pow(sum(a.z * b.z) / max(a.n), 2) as r2 from zs a join zs b on a.grp = b.grp and a.sample_id = b.sample_id and a.pos_bp < b.pos_bp and b.pos_bp - a.pos_bp <= 20000 group by all)"


@query(_Z + " select grp, marker, pos_bp, sample_id, round(z, 9) as z, round(maf, 9) as maf, n as n_complete, n from zs")
def dosage_standardize(v: Views) -> DataFrame:
    return M.dosage_standardize(v.dosage)


@query(_LD + " select grp, i, j, distance, round(r2, 9) as r2 from lp")
def pairwise_ld_r2(v: Views) -> DataFrame:
    return M.pairwise_ld(M.dosage_standardize(v.dosage), 20000).drop("q")


@query(_LD + " select grp, round(median(r2), 9) as median_r2, round(avg((floor(r2 * 255 + 0.5) > 204)::int), 9) as above, count(*) as n from lp group by 1")
def ld_summary(v: Views) -> DataFrame:
    return M.ld_summary(M.pairwise_ld(M.dosage_standardize(v.dosage), 20000))


@query(_LD + " select grp, least(distance * 10 // 20000, 9) as bin, round(avg(r2), 9) as mean_r2, count(*) as n from lp group by all")
def ld_decay(v: Views) -> DataFrame:
    return M.ld_decay(M.pairwise_ld(M.dosage_standardize(v.dosage), 20000), 10, 20000)


@query(
    """, d as (select dosage.*, label as fam, marker // 32 as win from dosage join embeddings on vec_id = sample_id where dosage < 1.8),
p as (select a.fam, a.win, a.sample_id as s1, b.sample_id as s2, corr(a.dosage, b.dosage) as r, avg(abs(a.dosage - b.dosage)) as mean_abs, sqrt(sum(pow(a.dosage - b.dosage, 2))) as euclid, count(*) as n from d a join d b on a.fam = b.fam and a.marker = b.marker and a.sample_id < b.sample_id group by all having count(*) >= 20)
select fam, win, s1, s2, n, round(r, 9) as r, round(mean_abs, 9) as mean_abs, round(euclid, 9) as euclid, round(1 - mean_abs / 2, 9) as l1, round(1 - euclid / max(euclid) over (partition by fam, win), 9) as l2 from p"""
)
def sample_similarity(v: Views) -> DataFrame:
    """Also pairwise_distance; pairs within a label and a window of 32 markers, values of 1.8 and more counting as missing."""
    fam = v.table("embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("fam"))
    rows = v.dosage.where("dosage < 1.8").withColumn("win", F.floor(F.col("marker") / 32)).join(fam, "sample_id")
    return M.sample_pairs(rows, ("fam", "win"))


@query(", c as (select label, arg_min(embedding, vec_id) as centre from embeddings group by 1) select e.vec_id, round(1 - list_cosine_similarity(e.embedding::double[], c.centre::double[]), 9) as distance from embeddings e join c using (label)")
def cosine_distance(v: Views) -> DataFrame:
    e = v.table("embeddings")
    return M.cosine_distance(e, e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centre")))


@query("select sample_id, marker * 4 // 64 as bin, round(avg(dosage), 9) as mean from dosage group by all")
def trajectory_bins(v: Views) -> DataFrame:
    return M.trajectory_bins(v.dosage, 64)


@query(", m as (select marker, avg(dosage) filter (grp = 0) < avg(dosage) filter (grp = 1) as flip from dosage group by 1) select marker, sample_id, flip, round(case when flip then 2 - dosage else dosage end, 9) as dosage from dosage join m using (marker)")
def polarity_flip_vector(v: Views) -> DataFrame:
    return M.polarity_flip(v.dosage, 0, 1)


@query(", l as (select w, sample_id, k, family_id from per_window join samples using (sample_id)) select a.sample_id as s1, b.sample_id as s2, round(avg((a.k = b.k)::int), 9) as concordance, count(*) as n from l a join l b on a.w = b.w and a.family_id = b.family_id and a.sample_id < b.sample_id group by all")
def sample_concordance(v: Views) -> DataFrame:
    return M.sample_concordance(v.labels, v.samples.select("sample_id", "family_id"))


@query(", l as (select w, sample_id, k, family_id from per_window join samples using (sample_id)) select a.family_id, a.sample_id as s1, b.sample_id as s2, count(*) filter (a.k = b.k) as together, count(*) as total, round(count(*) filter (a.k = b.k) / count(*), 9) as affinity from l a join l b on a.w = b.w and a.family_id = b.family_id and a.sample_id < b.sample_id group by all having count(*) >= 2")
def sample_coassociation(v: Views) -> DataFrame:
    return C.coassociation(v.labels.join(v.samples.select("sample_id", "family_id"), "sample_id"))


@query(", g as (select w, (sample_id % 3)::int as grp, avg(value) as m from per_window group by all) select a.grp as g1, b.grp as g2, round(corr(a.m, b.m), 9) as r, count(*) as n from g a join g b on a.w = b.w and a.grp < b.grp group by all")
def trajectory_correlation(v: Views) -> DataFrame:
    return M.trajectory_correlation(v.track, _mod_groups(v.track))


_PERM = ", pm(perm, p) as (values (0, [0, 1, 2]), (1, [0, 2, 1]), (2, [1, 0, 2]), (3, [1, 2, 0]), (4, [2, 0, 1]), (5, [2, 1, 0])), dg as (select w, perm, sum(n) as d from ct join pm on pm.p[ct.a + 1] = ct.b group by all), al as (select w, arg_max(perm, d * 10 - perm) as perm, max(d)::bigint as diagonal, max(d) / (select sum(n) from ct c where c.w = dg.w) as concordance from dg group by w)"


@query(_PAIRS + _PERM + " select w, perm, diagonal, round(concordance, 9) as concordance from al")
def align_labels(v: Views) -> DataFrame:
    return C.align_labels(A.contingency_table(A.label_pairs(v.labels), ["w"]), ["w"]).drop("n")


@query(", r as (select sample_id, count(distinct k) as reach from per_window group by 1) select reach, count(*) as n_samples, reach <= 2 as narrow from r group by 1")
def band_reach(v: Views) -> DataFrame:
    return C.band_reach(v.labels)


_SIL = ", pd as (select a.w, a.sample_id, a.k, b.k as kb, sum(abs(a.value - b.value)) as d, count(*) as m from per_window a join per_window b on a.w = b.w and a.sample_id <> b.sample_id group by all), ab as (select w, sample_id, k, max(d / m) filter (k = kb) as a, min(d / m) filter (k <> kb) as b from pd group by all)"


@query(_SIL + " select w, round(avg(case when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end), 9) as silhouette, count(*) as n from ab where a is not null and b is not null group by 1")
def silhouette(v: Views) -> DataFrame:
    return C.silhouette_1d(v.per_window)


@query(_PAIRS + _PERM + ", t as (select w, sum(n)::bigint as n from ct group by 1) select w, n, round(1 - concordance, 9) as rate, 1 - concordance >= 0.30 as hotspot from al join t using (w) where n >= 5")
def adjacent_transition_rate(v: Views) -> DataFrame:
    return O.adjacent_transition_rate(C.align_labels(A.contingency_table(A.label_pairs(v.labels), ["w"]), ["w"]))


def kmeans_sql(source: str, by: str = "w", rounds: int = 12, k: int = 3, out: str = "bands") -> str:
    """``bands``: k clusters of each key's values, by as many rounds as the operator takes."""
    seeds = ", ".join(f"list_sort(list(value))[least(count(*) - 1, {2 * i + 1} * count(*) // {2 * k}) + 1] as c{i}" for i in range(k))
    near = " + ".join(["0", *(f"(value > (c{i} + c{i + 1}) / 2)::int" for i in range(k - 1))])
    cols = ", ".join(f"c{i}" for i in range(k))
    text = f", {out}_k0 as (select {by}, {seeds} from {source} where value is not null group by {by})"
    for r in range(1, rounds):
        mean = ", ".join(f"coalesce(avg(value) filter (j = {i}), any_value(c{i})) as c{i}" for i in range(k))
        text += f", {out}_k{r} as (select {by}, {mean} from (select x.{by}, value, {cols}, {near} as j from {source} x join {out}_k{r - 1} y on x.{by} = y.{by} where value is not null) group by {by})"
    return text + f", {out} as (select x.{by}, sample_id, {near} as k, value from {source} x join {out}_k{rounds - 1} y on x.{by} = y.{by} where value is not null)"


@query(kmeans_sql("per_window") + " select w, sample_id, k, round(value, 9) as value from bands")
def kmeans_1d(v: Views) -> DataFrame:
    return C.kmeans_1d(v.track)


def adaptive_sql(source: str, by: str = "w", ks: tuple = (2, 3, 4), least: int = 3) -> str:
    """``bands`` with the number of clusters of the highest silhouette, and ``best`` (key, used_k, silhouette, smallest)."""
    text = "".join(kmeans_sql(source, by, k=k, out=f"b{k}") for k in ks)
    text += ", bk as (" + " union all ".join(f"(select {k} as kk, {by}, sample_id, k, value from b{k})" for k in ks) + ")"
    return text + f""", bp as (select x.kk, x.{by}, x.sample_id, x.k, y.k as kb, sum(abs(x.value - y.value)) as d, count(*) as m from bk x join bk y on x.kk = y.kk and x.{by} = y.{by} group by all),
bq as (select kk, {by}, sample_id, k, max(case when k = kb then d / nullif(m - 1, 0) end) as a, min(case when k <> kb then d / m end) as b from bp group by all),
bs as (select kk, {by}, case when count(*) >= 4 and count(distinct k) = kk and count(a) = count(*) then avg(case when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end) end as sil, count(*) as n from bq group by kk, {by}),
bz as (select kk, {by}, case when count(*) = kk then min(m) else 0 end as smallest from (select kk, {by}, k, count(*) as m from bk group by all) group by kk, {by}),
bb as (select kk, {by}, sil, smallest, smallest >= {least} and sil is not null as fair from bs join bz using (kk, {by}) where n >= {min(ks) * least}),
best as (select {by}, kk as used_k, sil as silhouette, smallest from bb qualify row_number() over (partition by {by} order by fair desc, case when fair then round(sil, 9) end desc, kk) = 1),
bands as (select bk.{by}, sample_id, k, value from bk join best on best.{by} = bk.{by} and used_k = kk)"""


_ON_BANDS = kmeans_sql("per_window") + (_PAIRS + _SCORES + _PERM + _SIL).replace("per_window", "bands")


@query(
    _ON_BANDS
    + """, si as (select w, case when count(*) >= 4 and count(distinct k) = 3 and count(a) = count(*) then avg(case when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end) end as silhouette, count(*) as n from ab group by 1),
ch as (select w, sum((concordance < 0.50)::int) over (order by w)::bigint as chain, concordance from al)
select w, round(silhouette, 9) as silhouette, si.n, round(v, 9) as v, round(ari, 9) as ari, chain, round(concordance, 9) as concordance, round(1 - concordance, 9) as rate,
 case when coalesce(silhouette < 0.40, true) or v is null then 'UNRELIABLE' when v >= 0.70 then 'INTERIOR' when v < 0.40 then 'REGIME_END' else 'CROSSOVER' end as class
from si left join sc using (w) left join ch using (w)"""
)
def regime_pipeline(v: Views) -> DataFrame:
    return regimes.regime_table(v.track)


@query("select chrom, w, round(abs(z), 9) as abs_z from windows")
def window_summary_sort(v: Views) -> DataFrame:
    return N.sorted_rows(B.window_summary_rows(v.windows).select("chrom", "w", "abs_z"), "abs_z", True, "w")


_ENVELOPES = ", e as (select chrom, w // 8 as idx, w // 32 as parent, min(w) as s, max(w) + 1 as t from windows group by all), n as (select *, lag(idx) over p as l, lead(idx) over p as r from e window p as (partition by chrom, parent order by s, idx))"


@query(_ENVELOPES + ", m as (select w.chrom, w.w, max(n.idx) as idx from windows w join n on n.chrom = w.chrom and w.w between n.s and n.t group by all) select m.chrom, m.w, m.idx as envelope, n.l as lower, n.r as upper from m join n on n.chrom = m.chrom and n.idx = m.idx")
def window_to_envelope(v: Views) -> DataFrame:
    by = v.windows.groupBy("chrom", F.floor(F.col("w") / 8).cast("int").alias("idx"), F.floor(F.col("w") / 32).cast("int").alias("parent"))
    return N.window_to_envelope(v.windows, by.agg(F.min("w").alias("start_w"), (F.max("w") + 1).alias("end_w"))).withColumnsRenamed({"left": "lower", "right": "upper"})


@query(", b as (select candidate_id, k, count(*) as n from calls group by all), r as (select *, row_number() over (partition by candidate_id order by n) as i, count(*) over (partition by candidate_id) as m from b) select candidate_id, round(0.4 * max(n) / sum(n) + 0.3 * least(1.0, sum(n) / 20.0) + 0.2 * (1 - sum((2.0 * i - m - 1) * n) / (max(m) * sum(n))) + 0.1 * case when candidate_id % 2 = 0 then 0.5 else 1 end, 9) as score from r group by candidate_id")
def support_score(v: Views) -> DataFrame:
    c = v.calls.groupBy("candidate_id", "k").agg(F.count("*").cast("double").alias("n")).groupBy("candidate_id").agg(F.max("n").alias("top"), F.sum("n").alias("all"), F.collect_list("n").alias("sizes"))
    return c.select("candidate_id", N.support_score(F.col("top") / F.col("all"), F.col("all"), F.col("sizes"), F.col("candidate_id") % 2 == 0).alias("score"))


@query(", c as (select chrom, max(end_bp) as len from intervals group by 1), d as (select chrom, len, len * 4 // 10 as cs, len // 2 as ce from c), x as (select id, greatest(0, cs - end_bp, start_bp - ce) as tc, least(start_bp, len - end_bp) as te, (end_bp - start_bp) / case when (start_bp + end_bp) / 2 < cs then cs else len - ce end as share from intervals join d using (chrom)) select id, case when tc = 0 then 'centromeric' when tc <= 100 then 'pericentromeric' when te <= 40 then 'subtelomeric' when share >= 0.1 then 'arm-scale' else 'interstitial' end as place, tc as to_centromere, te as to_end from x")
def annotate_regime_position(v: Views) -> DataFrame:
    chroms = v.intervals.groupBy("chrom").agg(F.max("end_bp").alias("length")).selectExpr("chrom", "length", "length * 4 div 10 as cen_start", "length div 2 as cen_end")
    return N.regime_position(v.intervals, chroms, 100, 40, 0.1)


@query("select l.w, l.sample_id, l.k as band, s.family_id, s.ancestry, case l.k when 0 then 'low' when 2 then 'high' end as track from per_window l left join samples s using (sample_id)")
def karyotype_rows(v: Views) -> DataFrame:
    return N.karyotype_rows(v.labels, v.samples, {0: "low", 2: "high"})


@query(", r as (select distinct candidate_id as c, candidate_id // 50 as block from calls), s as (select distinct sample_id, candidate_id // 50 as block from calls) select s.sample_id, s.block, string_agg(coalesce(c.k::varchar, '.'), '' order by r.c) as support from s join r using (block) left join calls c on c.sample_id = s.sample_id and c.candidate_id = r.c group by all")
def support_matrix_rows(v: Views) -> DataFrame:
    return N.support_matrix(v.calls)


@query("select id, chrom, source, start_bp, end_bp from intervals where source = 'F' and (contains(lower(chrom), 'urgent') or contains(lower(source), 'urgent'))")
def catalogue_rows_filter_sort(v: Views) -> DataFrame:
    return N.catalogue_rows(v.intervals, "URGENT", ["chrom", "source"], {"source": "F"}, "start_bp").select("id", "chrom", "source", "start_bp", "end_bp")


@query("select sample_id, round(avg(value), 9) as mean, count(*) as n from per_window where w between 2 and 5 group by 1")
def sample_mean_over_windows(v: Views) -> DataFrame:
    return v.track.where("w between 2 and 5").groupBy("sample_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query(", t as (select candidate_id, count(*) filter (k = 0 and sample_id % 2 = 0) as a, count(*) filter (k = 0) as r, count(*) filter (sample_id % 2 = 0) as s, count(*) as n from calls group by 1), x as (select *, greatest(0, r + s - n) as lo, unnest(range(greatest(0, r + s - n), least(r, s) + 1)) as x from t), y as (select *, lgamma(r + 1.0) - lgamma(x + 1.0) - lgamma(r - x + 1.0) + lgamma(n - r + 1.0) - lgamma(s - x + 1.0) - lgamma(n - r - s + x + 1.0) as lp from x), z as (select *, max(lp) over p as top, max(case when x = a then lp end) over p as seen from y window p as (partition by candidate_id)) select candidate_id, any_value(a) as a, any_value(n) as n, round(sum(case when lp <= seen + 1e-9 then exp(lp - top) end) / sum(exp(lp - top)), 9) as p from z group by 1")
def fisher_exact(v: Views) -> DataFrame:
    even = F.col("sample_id") % 2 == 0
    cells = {"a": (F.col("k") == 0) & even, "b": (F.col("k") == 0) & ~even, "c": (F.col("k") != 0) & even, "d": (F.col("k") != 0) & ~even}
    return N.fisher_exact(v.calls.groupBy("candidate_id").agg(*(F.count_if(c).alias(n) for n, c in cells.items())), "candidate_id")


@query(", f as (select pos_bp, avg(dosage) filter (grp = 0) / 2 as p, avg(dosage) filter (grp = 1) / 2 as q, count(dosage) filter (grp = 0) as n, count(dosage) filter (grp = 1) as m from dosage group by 1), w as (select *, unnest(range(greatest(0, floor((pos_bp - 50000) / 10000)::bigint + 1), pos_bp // 10000 + 1)) * 10000 as start from f) select start, count(*) as sites, round(sum((p - q) ** 2 - p * (1 - p) / (2 * n - 1) - q * (1 - q) / (2 * m - 1)) / sum(p * (1 - q) + q * (1 - p)), 9) as fst, round(sum(p * (1 - q) + q * (1 - p)) / 50000, 9) as dxy, round(sum(4 * n * p * (1 - p) / (2 * n - 1)) / 50000, 9) as pi_one, round(sum(4 * m * q * (1 - q) / (2 * m - 1)) / 50000, 9) as pi_two from w group by 1")
def popstats_windows(v: Views) -> DataFrame:
    return N.popstats(v.dosage, 0, 1)


@query(", r as (select *, w - row_number() over (partition by sample_id order by w) as run from per_window where k >= 1) select sample_id, min(w) as first_w, max(w) as last_w, count(*) as n, round(avg(value), 9) as score from r group by sample_id, run having count(*) >= 3")
def contiguous_inner_intervals(v: Views) -> DataFrame:
    return N.inner_intervals(v.per_window.where("k >= 1"), "sample_id")


@query(", s as (select w, k, count(*) as n from per_window group by all), b as (select a.w, a.k, c.w as w2, c.k as k2, count(*) as shared from per_window a join per_window c on a.sample_id = c.sample_id and a.w <> c.w group by all), j as (select b.w, b.k, shared / (s.n + t.n - shared) as j from b join s on s.w = b.w and s.k = b.k join s t on t.w = b.w2 and t.k = b.k2) select w, k, count(*) filter (j >= 0.5) as n_visited, count(*) filter (j <= 0.2) as n_excluded from j group by all")
def labels_to_votes(v: Views) -> DataFrame:
    return N.labels_to_votes(v.labels)


@query(", n as (select w, k, sample_id % 4 as lineage, count(*) as n from per_window group by all), b as (select w, k, sum(n)::bigint as size from n group by all), t as (select * from b qualify row_number() over (partition by w order by size desc, k) = 1) select t.w, t.k, t.size, n.lineage from t join n on n.w = t.w and n.k = t.k qualify row_number() over (partition by t.w order by n.n desc, n.lineage) = 1")
def dominant_lineage_per_l2(v: Views) -> DataFrame:
    return N.dominant_lineage(v.labels, F.col("sample_id") % 4)


@query(", x as (select *, lag(k) over (partition by sample_id order by w) as was from per_window), r as (select *, lag(k, 2) over (partition by sample_id order by w) as two from x where was is null or was <> k), n as (select sample_id, count(*) - 1 as switches, count(*) filter (two = k) as returns from r group by 1) select *, case when switches = 0 then 'stable' when returns >= 2 then 'nested' when returns = 1 then 'recombinant_tract' when switches = 1 then 'two_adjacent' else 'complex' end as architecture from n")
def architecture_class(v: Views) -> DataFrame:
    return N.architecture_class(v.labels)


@query(", s as (select marker, count(*) filter (dosage > 1) as support from dosage group by 1), g as (select d.marker, sample_id, sqrt(least(1.0, support / (select max(support) from s))) as w, dosage / 2 as q from dosage d join s using (marker)) select marker, sample_id, round(((1 - q) ** 2 - 1 / 3) * w + 1 / 3, 9) as g0, round((2 * q * (1 - q) - 1 / 3) * w + 1 / 3, 9) as g1, round((q ** 2 - 1 / 3) * w + 1 / 3, 9) as g2 from g")
def weight_by_support(v: Views) -> DataFrame:
    s, q = v.dosage.groupBy("marker").agg(F.count_if(F.col("dosage") > 1).alias("support")), F.col("dosage") / 2
    rows = v.dosage.select("marker", "sample_id", ((1 - q) ** 2).alias("g0"), (2 * q * (1 - q)).alias("g1"), (q**2).alias("g2"))
    return N.weight_by_support(rows, s, s.agg(F.max("support")).first()[0])


@query(_PAIRS + _SCORES + " select w, round(chi2, 9) as chi2, df, round(case df when 0 then 1 when 2 then exp(-chi2 / 2) when 4 then exp(-chi2 / 2) * (1 + chi2 / 2) end, 9) as p from sc")
def chi_square_test(v: Views) -> DataFrame:
    s = A.contingency_scores(A.contingency_table(A.label_pairs(v.labels), ["w"]), ["w"])
    return s.select("w", "chi2", "df", chi_square_tail(F.col("chi2"), F.col("df")).alias("p"))


from . import queries_bands, queries_loci, queries_planes, queries_sources, queries_votes  # noqa: E402, F401  they register more
