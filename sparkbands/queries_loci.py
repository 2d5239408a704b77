"""Queries of the operators on genotypes at loci, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import loci as L
from .registry import query
from .views import Views

_ALLOWED = "case when {p} = 1 and {q} = 1 then 0 when {c} between ({p} = 2)::int + ({q} = 2)::int and ({p} > 0)::int + ({q} > 0)::int then 1 else -1 end"


@query(", p as (select a, b, x.candidate_id, x.k as ka, y.k as kb from kin join calls x on x.sample_id = a join calls y on y.sample_id = b and y.candidate_id = x.candidate_id where kinship >= 0.177) select a, b, count(*) as n_informative, count(*) filter (abs(ka - kb) = 2) as n_contradictions, round(count(*) filter (abs(ka - kb) = 2) / count(*), 9) as rate, count(*) filter (abs(ka - kb) = 2) = 0 as compatible from p group by a, b")
def genotype_compat_dyads(v: Views) -> DataFrame:
    return L.genotype_compat_dyads(v.kin, v.calls)


@query(", e as (select a as child, b as p from kin where kinship >= 0.177 union all select b, a from kin where kinship >= 0.177), t as (select e.child, e.p, f.p as q, " + _ALLOWED.format(p="x.k", q="y.k", c="z.k") + " as s from e join e f on e.child = f.child and e.p < f.p join calls z on z.sample_id = e.child join calls x on x.sample_id = e.p and x.candidate_id = z.candidate_id join calls y on y.sample_id = f.p and y.candidate_id = z.candidate_id) select child, p, q, count(*) as n_tested, count(*) filter (s <> 0) as n_informative, count(*) filter (s < 0) as n_contradictions from t group by all")
def genotype_compat_trios(v: Views) -> DataFrame:
    return L.genotype_compat_trios(v.kin, v.calls)


@query(
    ", e as (select a, b, kinship from kin union all select b, a, kinship from kin), p as (select a, b from kin where kinship >= 0.177), c as (select p.a, p.b, e.b as c from p join e on e.a = p.a and e.kinship >= 0.177 and e.b <> p.b join e f on f.a = p.b and f.b = e.b and f.kinship >= 0.0884), s as (select c.a, c.b, "
    + _ALLOWED.format(p="x.k", q="z.k", c="y.k")
    + " as sa, "
    + _ALLOWED.format(p="y.k", q="z.k", c="x.k")
    + " as sb from c join calls x on x.sample_id = c.a join calls y on y.sample_id = c.b and y.candidate_id = x.candidate_id join calls z on z.sample_id = c.c and z.candidate_id = x.candidate_id), t as (select a, b, sum(sa)::bigint as total_a, sum(sb)::bigint as total_b, count(*) filter (sa <> 0 or sb <> 0) as n_informative from s group by 1, 2), g as (select *, case when abs(total_a) + abs(total_b) > 0 then abs(total_a - total_b) / (abs(total_a) + abs(total_b)) else 0.0 end as confidence from t) select a, b, total_a, total_b, n_informative, round(confidence, 9) as confidence, case when n_informative < 1 then 'UNDIRECTED' when total_a < 0 and total_b < 0 then 'INCOMPATIBLE' when confidence < 0.6 then 'UNDIRECTED' when total_a > total_b then 'A_TO_B' else 'B_TO_A' end as direction from g"
)
def dyad_direction(v: Views) -> DataFrame:
    return L.dyad_direction(v.kin, v.calls, least=1)


_ROLES = """
, al as (select chrom, pos_bp, allele, sum(reads)::bigint as total, count(distinct sample_id) as n_samples from variants where reads > 0 group by all),
rk as (select *, row_number() over (partition by chrom, pos_bp order by total desc, allele) as rank, count(*) over (partition by chrom, pos_bp) as n_alleles from al),
ro as (select * from rk where n_alleles >= 2), st as (select chrom, pos_bp, sum(total)::bigint as site_total from ro group by all),
pp as (select x.chrom, x.pos_bp, x.allele as aa, y.allele as ab, 'MAJOR' || case when x.rank = 1 then '' else null end as r1, x.rank as ra, y.rank as rb, x.total as ta, y.total as tb, x.n_samples as na, y.n_samples as nb, x.n_alleles from ro x join ro y on x.chrom = y.chrom and x.pos_bp = y.pos_bp and x.rank < y.rank),
pe as (select pp.chrom, pp.pos_bp, aa, ab, count(distinct sample_id) as either from pp join variants v on v.chrom = pp.chrom and v.pos_bp = pp.pos_bp and v.reads > 0 and v.allele in (aa, ab) group by all),
pairs as (select chrom || '_' || pos_bp || '_' || role_a || '_' || role_b || '_' || aa || '_' || ab as marker, * exclude (aa, ab, r1, ra, rb, ta, tb, site_total, na, nb, either), either as n_samples_either from
 (select *, case when ra = 1 then 'MAJOR' else 'MINOR' || (ra - 1) end as role_a, 'MINOR' || (rb - 1) as role_b, ta + tb as pair_count, least(ta, tb) as min_pair_allele_count, round((ta + tb) / site_total, 9) as pair_fraction, round(least(ta, tb) / (ta + tb), 9) as maf_pair, na as n_samples_a, nb as n_samples_b from pp join st using (chrom, pos_bp) join pe using (chrom, pos_bp, aa, ab)))
"""


@query(_ROLES + " select * from pairs")
def allele_roles_and_pairs(v: Views) -> DataFrame:
    return L.allele_pairs(v.variants)


@query(_ROLES + " select * from pairs where role_a = 'MAJOR' and role_b in ('MINOR1', 'MINOR2') and pair_fraction >= 0.5 and min_pair_allele_count >= 10 and maf_pair >= 0.1 and least(n_samples_a, n_samples_b) >= 2 and n_alleles between 2 and 4")
def filter_allele_pairs(v: Views) -> DataFrame:
    return L.filter_allele_pairs(L.allele_pairs(v.variants), ["MAJOR_MINOR1", "MAJOR_MINOR2"], 0.5, 10, 0.1, 2)


@query(
    _ROLES
    + ", r as (select * from pairs where role_a = 'MAJOR' and role_b in ('MINOR2', 'MINOR3') and n_samples_b between 1 and 30 and min_pair_allele_count >= 6), x as (select *, unnest(range(greatest(0, (pos_bp - 100000) // 50000 + 1), pos_bp // 50000 + 1)) * 50000 as start_bp from r), y as (select chrom, start_bp, count(*) as n_pairs, count(distinct pos_bp) as n_sites, median(n_samples_b) as median_carriers, median(min_pair_allele_count) as median_reads, start_bp + 100000 as end_bp from x group by chrom, start_bp having count(*) >= 5), z as (select *, (coalesce(max(end_bp) over (partition by chrom order by start_bp rows between unbounded preceding and 1 preceding), -1) < start_bp)::int as new from y) select * exclude (new), sum(new) over (partition by chrom order by start_bp)::bigint as stretch from z"
)
def rare_pair_windows(v: Views) -> DataFrame:
    return L.rare_pair_windows(L.allele_pairs(v.variants), 100_000, 50_000, carriers=(1, 30))


@query(", x as (select id, start_bp / 500.0 as l0, end_bp / 700.0 as l1, (end_bp - start_bp) / 90.0 as l2 from intervals), y as (select *, greatest(l0, l1, l2) as top from x) select id, round(exp(l0 - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top)), 9) as p0, round(exp(l1 - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top)), 9) as p1, round(exp(l2 - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top)), 9) as p2 from y")
def pair_likelihoods(v: Views) -> DataFrame:
    return L.pair_likelihoods(v.intervals.select("id", (F.col("start_bp") / 500).alias("l0"), (F.col("end_bp") / 700).alias("l1"), ((F.col("end_bp") - F.col("start_bp")) / 90).alias("l2")))


_LINE = ", li as (select l_suppkey as id, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as k, l_discount as d, l_tax as t, l_quantity as q, l_linestatus as s from lineitem)"


def _line(v: Views) -> DataFrame:
    k = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return v.table("lineitem").select(F.col("l_suppkey").alias("id"), k.alias("k"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_quantity").alias("q"), F.col("l_linestatus").alias("s"))


_PI = ", p as (select id, (avg(d) filter (k = 0) - 0.04) / 2 as pi_a, (avg(d) filter (k = 2) - 0.045) / 2 as pi_b, count(*) filter (k = 0) as n_aa, count(*) filter (k = 1) as n_ab, count(*) filter (k = 2) as n_bb from li group by 1)"


@query(
    _LINE
    + _PI
    + ", x as (select *, n_aa + n_ab + n_bb as n, (2 * n_aa + n_ab) / (2 * (n_aa + n_ab + n_bb)) as p, n_aa >= 5 and n_bb >= 5 and pi_a is not null and pi_b is not null as ok from p), y as (select *, case when ok and 2 * p * (1 - p) * n > 0 then n_ab / (2 * p * (1 - p) * n) end as r from x) select id, case when pi_a is null or pi_a < 0.005 then 'low' when pi_a > 0.015 then 'high' else 'mid' end as band_a, case when pi_b is null or pi_b < 0.005 then 'low' when pi_b > 0.015 then 'high' else 'mid' end as band_b, case when ok then pi_a > 0 and pi_b > 0 and greatest(pi_a, pi_b) >= 2 * least(pi_a, pi_b) else false end as asymmetric, round(r, 9) as ab_ratio, n as n_total, ok as sufficient, coalesce(r >= 1.2, false) as ab_excess from y"
)
def homokaryotype_diversity_pattern(v: Views) -> DataFrame:
    at = lambda k, c: F.avg(F.when(F.col("k") == k, F.col(c)))
    n = [F.count_if(F.col("k") == k).alias(s) for k, s in enumerate(("n_aa", "n_ab", "n_bb"))]
    return L.homokaryotype_diversity_pattern(_line(v).groupBy("id").agg(((at(0, "d") - 0.04) / 2).alias("pi_a"), ((at(2, "d") - 0.045) / 2).alias("pi_b"), *n))


@query("select id, case when source = 'O' and id % 5 = 0 then 'noise_or_recombinant' when id % 7 = 0 then 'compound_inversion_like' when end_bp - start_bp >= 0.3 * 300 then 'arm_scale_block' when id % 6 + 1 between 4 and 6 then 'nested_or_compound' when id % 6 + 1 = 3 then 'inversion_dosage_like' when id % 6 + 1 = 2 then 'simple_haplotype_split' when (end_bp - start_bp) / 100.0 <= 0.3 then 'recombination_gradient_like' else 'structural_block_like' end as structure from intervals")
def annotate_regime_structure(v: Views) -> DataFrame:
    i = F.col("id")
    kind = F.when((F.col("source") == "O") & (i % 5 == 0), "RANDOM_FAN")
    return L.regime_structure(v.intervals.select("id", kind.alias("consensus_class"), (i % 7 == 0).alias("nested"), "start_bp", "end_bp", F.lit(300).alias("arm_bp"), (i % 6 + 1).alias("m"), ((F.col("end_bp") - F.col("start_bp")) / 100).alias("sharpness")))


_SV = ", g as (select id, s, avg(d) as fdr, (count(*) filter (k > 0) + 0.5) / (count(*) filter (k = 0) + 0.5) * 3 as odds, count(*) filter (k = 1) / count(*) as het, count(*) filter (k = 0) / count(*) as ref, count(*) filter (k = 2) / count(*) as inv from li group by 1, 2)"


def _svs(v: Views) -> DataFrame:
    share = lambda k: F.count_if(F.col("k") == k) / F.count("*")
    odds = (F.count_if(F.col("k") > 0) + 0.5) / (F.count_if(F.col("k") == 0) + 0.5) * 3
    return _line(v).groupBy("id", "s").agg(F.avg("d").alias("fdr"), odds.alias("odds"), share(1).alias("het_share"), share(0).alias("ref_share"), share(2).alias("inv_share"))


@query(_LINE + _SV + " select id, case when fdr >= 0.10 then 'uninformative' when s = 'O' and fdr < 0.05 and odds > 20 then 'canonical_breakpoint_marker' when fdr < 0.05 and odds > 5 then 'dominant_presence_marker' when het > 0.6 and ref < 0.2 and inv < 0.2 and fdr < 0.05 then 'het_specific_marker' when s = 'F' and fdr < 0.05 then 'sub_haplotype_marker' when s = 'F' then 'internal_linked_marker' else 'uninformative' end as label from g")
def sv_pattern_label(v: Views) -> DataFrame:
    zone = F.when(F.col("s") == "O", "left_boundary").otherwise("inversion_body")
    return L.sv_pattern_label(_svs(v).withColumn("zone", zone))


@query(_LINE + _SV + ", d as (select * from (select unnest(['F', 'O']) as side), (select unnest(['DEL', 'DUP', 'INV', 'BND', 'INS']) as kind)), n as (select s as side, ['DEL', 'DUP', 'INV', 'BND'][id % 4 + 1] as kind, count(*) as a, count(*) filter (fdr < 0.05) as b from g group by all) select d.side, d.kind, coalesce(a, 0) as n_all, coalesce(b, 0) as n_significant from d left join n using (side, kind)")
def boundary_summary(v: Views) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("DEL", "DUP", "INV", "BND"))), (F.col("id") % 4 + 1).cast("int"))
    return L.boundary_summary(_svs(v).select(F.col("s").alias("side"), kind.alias("kind"), "fdr"), ["F", "O"], ["DEL", "DUP", "INV", "BND", "INS"])


_EV = ", one as (select l_suppkey as id, l_partkey as sample_id, count(*) filter (l_returnflag = 'A') as split, count(*) as discordant, count(*) filter (l_tax > 0.06) as mapq0, 'AA' as genotype from lineitem group by all), two as (select l_suppkey as id, l_partkey as sample_id, count(*) + 2 as split, count(*) filter (l_tax > 0.02) as discordant, null::bigint as mapq0, max(['AA', 'AB', 'BB'][l_linenumber % 3 + 1]) as genotype from lineitem where l_linestatus = 'O' group by all)"


@query(_EV + ", f as (select id, sample_id, coalesce(t.split, o.split) as split, coalesce(t.discordant, o.discordant) as discordant, coalesce(t.mapq0, o.mapq0) as mapq0, coalesce(t.genotype, o.genotype) as genotype from one o full join two t using (id, sample_id)) select id, sample_id, split >= 3 as split, discordant >= 3 as discordant, coalesce(mapq0 > 0, false) as mapq0, genotype in ('AB', 'BB') as called from f")
def sv_evidence_flags(v: Views) -> DataFrame:
    li, key = v.table("lineitem"), (F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("sample_id"))
    one = li.groupBy(*key).agg(F.count_if(F.col("l_returnflag") == "A").alias("split"), F.count("*").alias("discordant"), F.count_if(F.col("l_tax") > 0.06).alias("mapq0"), F.lit("AA").alias("genotype"))
    call = F.element_at(F.array(*map(F.lit, ("AA", "AB", "BB"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    two = li.where("l_linestatus = 'O'").groupBy(*key).agg((F.count("*") + 2).alias("split"), F.count_if(F.col("l_tax") > 0.02).alias("discordant"), F.lit(None).cast("long").alias("mapq0"), F.max(call).alias("genotype"))
    return L.sv_evidence_flags(one, two)


_LINK = ", t as (select count(distinct c_custkey) as n_total from customer where c_mktsegment = 'BUILDING'), n as (select candidate_id, k, count(*) as n from calls where sample_id in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by all), m as (select candidate_id, arg_max(k, n * 10 - k) as band, max(n) as n_band, sum(n)::bigint as n_seen from n group by 1)"


def _chosen(v: Views) -> DataFrame:
    return v.samples.where("ancestry = 'BUILDING'")


@query(_LINK + " select candidate_id, band, n_band, n_seen, round(n_band / n_seen, 9) as purity, n_band / n_seen >= 0.7 and n_band >= 5 as strong from m")
def lasso_linkage(v: Views) -> DataFrame:
    return L.linkage_of_set(v.calls, _chosen(v)).select("candidate_id", "band", "n_band", "n_seen", "purity", "strong")


@query(_LINK + " select candidate_id, band, n_band, round(n_band / n_total, 9) as purity from m, t where n_total >= 3 and n_band / n_total >= 0.0")
def tracked_linkage(v: Views) -> DataFrame:
    return L.linkage_of_set(v.calls, _chosen(v)).select("candidate_id", "band", "n_band", F.col("tracked_purity").alias("purity"))


@query(", f as (select w, sample_id, (k * 2 + (sample_id % 2))::int as r, case when sample_id % 11 = 0 then (k + 1) % 3 else k end as c from per_window), t as (select r, c, count(*) as n from f group by all), p as (select r, arg_max(c, n * 10 - c) as parent, max(n) / sum(n) as purity from t group by 1) select r, parent, round(purity, 9) as purity, chr((96 + row_number() over (partition by parent order by r))::int) as letter, case when count(*) filter (purity >= 0.8) over () = count(*) over () then 'NESTED' when count(*) filter (purity >= 0.8) over () = 0 then 'CROSS_CUTTING' else 'MIXED' end as verdict from p")
def subband_parent_map(v: Views) -> DataFrame:
    fine = v.labels.withColumn("k", (F.col("k") * 2 + F.col("sample_id") % 2).cast("int"))
    coarse = v.labels.withColumn("k", F.when(F.col("sample_id") % 11 == 0, (F.col("k") + 1) % 3).otherwise(F.col("k")))
    return L.subband_parents(fine, coarse, ["w", "sample_id"])


_FROH = ", fr as (select l_partkey as sample_id, avg(l_discount) as froh from lineitem group by 1)"


def _froh(v: Views) -> DataFrame:
    return v.table("lineitem").groupBy(F.col("l_partkey").alias("sample_id")).agg(F.avg("l_discount").alias("froh"))


@query(_FROH + " select candidate_id, k, count(froh) as n, round(avg(froh), 9) as mean, round(median(froh), 9) as median, round(stddev_samp(froh), 9) as sd, round(quantile_cont(froh, 0.25), 9) as q1, round(quantile_cont(froh, 0.75), 9) as q3, round(min(froh), 9) as low, round(max(froh), 9) as high from calls join fr using (sample_id) group by all")
def froh_by_arrangement(v: Views) -> DataFrame:
    return L.froh_by_arrangement(_froh(v), v.calls)


@query(", u as (select user_id as sample_id, event_type as metric, avg(value) as value from ev group by all) select w, k, metric, count(u.value) as n, round(avg(u.value), 9) as mean, round(median(u.value), 9) as median from per_window join u using (sample_id) group by all")
def band_diagnostics(v: Views) -> DataFrame:
    return L.band_diagnostics(v.labels, v.events.groupBy(F.col("user_id").alias("sample_id"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value")))


@query(
    _LINE
    + ", x as (select id, k, unnest(['discount', 'tax', 'quantity']) as metric, unnest([d, t, q]) as value from li), a as (select id as candidate_id, metric, "
    + ", ".join(f"count(value) filter (k = {k}) as n_{s}, median(value) filter (k = {k}) as median_{s}, quantile_cont(value, 0.75) filter (k = {k}) - quantile_cont(value, 0.25) filter (k = {k}) as iqr_{s}" for k, s in ((0, "ref"), (1, "het"), (2, "inv")))
    + " from x group by all), g as (select *, case when greatest(abs(median_ref), abs(median_inv)) > 0 then (median_inv - median_ref) / greatest(abs(median_ref), abs(median_inv)) else 0.0 end as gap from a) select candidate_id, metric, "
    + ", ".join(f"n_{s}, round(median_{s}, 9) as median_{s}, round(iqr_{s}, 9) as iqr_{s}" for s in ("ref", "het", "inv"))
    + ", case when n_ref < 5 or n_inv < 5 then 'insufficient_data' when abs(gap) <= 0.1 then 'neutral' when gap > 0 then 'inv_higher' else 'ref_higher' end as verdict from g"
)
def burden_by_karyotype(v: Views) -> DataFrame:
    rows = _line(v).select(F.col("id").alias("candidate_id"), "k", F.explode(F.create_map(F.lit("discount"), "d", F.lit("tax"), "t", F.lit("quantity"), "q")).alias("metric", "value"))
    return L.burden_by_karyotype(rows)


_REL = ", c as (select distinct candidate_id from calls), o as (select distinct x.l_suppkey as c1, y.l_suppkey as c2 from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_suppkey < y.l_suppkey), s as (select x.candidate_id as c1, y.candidate_id as c2 from calls x join calls y on x.sample_id = y.sample_id and x.candidate_id < y.candidate_id group by all having count(*) >= 15), pr as (select c1, c2 from o union select c1, c2 from s)"


@query(_REL + " select c1, c2, case when o.c1 is not null and s.c1 is not null then 'both' when o.c1 is not null then 'intersecting' when s.c1 is not null then 'co_occurring' else 'none' end as relation from pr left join o using (c1, c2) left join s using (c1, c2)")
def relationship_join_matrix(v: Views) -> DataFrame:
    li = v.table("lineitem").select("l_orderkey", "l_suppkey").distinct()
    overlap = li.withColumnRenamed("l_suppkey", "c1").join(li.withColumnRenamed("l_suppkey", "c2"), "l_orderkey").where("c1 < c2").select("c1", "c2").distinct()
    c = v.calls.select("candidate_id", "sample_id")
    strong = c.withColumnRenamed("candidate_id", "c1").join(c.withColumnRenamed("candidate_id", "c2"), "sample_id").where("c1 < c2").groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n >= 15").select("c1", "c2")
    return L.relationship_matrix(overlap.unionByName(strong).distinct(), overlap, strong)


@query(", g as (select w as id, chrom, start_bp - 20000 as start_bp, end_bp + 3600 * (w % 5) as end_bp, abs(z) as confidence from windows where n_snps >= 5), h as (select id, g.chrom, g.start_bp, g.end_bp, confidence, min(pos_bp) as first_pos, max(pos_bp) as last_pos from g join points p on p.chrom = g.chrom and p.pos_bp between g.start_bp and g.end_bp group by all) select * exclude (confidence), row_number() over (partition by chrom order by end_bp - start_bp desc, confidence desc, id) = 1 as \"primary\" from h")
def registry_overlay(v: Views) -> DataFrame:
    w = F.col("w")
    regimes = v.windows.where("n_snps >= 5").select(w.alias("id"), "chrom", (F.col("start_bp") - 20000).alias("start_bp"), (F.col("end_bp") + 3600 * (w % 5)).alias("end_bp"), F.abs("z").alias("confidence"))
    return L.registry_overlay(v.points, regimes, 3600)


@query(", p as (select id, 'C_gar_' || chrom as chrom, start_bp * 100 as pos_bp from intervals), a as (select case when id % 10 = 0 then id end as id, chrom, end_bp * 100 + 7 as pos_bp, id as ord from intervals where id % 3 = 0), i as (select p.id, min(ord) as o from p join a using (id) group by 1), nb as (select p.id, min(ord) as o from p join a on p.chrom = 'C_gar_' || a.chrom and abs(p.pos_bp - a.pos_bp) < 1000 group by 1) select p.id, coalesce(i.o, nb.o) as ord from p left join i using (id) left join nb using (id)")
def breakpoint_match(v: Views) -> DataFrame:
    i = v.intervals
    points = i.select("id", F.concat(F.lit("C_gar_"), "chrom").alias("chrom"), (F.col("start_bp") * 100).alias("pos_bp"))
    annotations = i.where("id % 3 = 0").select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("id"), "chrom", (F.col("end_bp") * 100 + 7).alias("pos_bp"), F.col("id").alias("ord"))
    return L.breakpoint_match(points, annotations, 1000)


_AXES = ", ax as (select id, case when id % 9 = 0 then null else (end_bp - start_bp) / 20.0 end as age, ['strong_divergence', 'weak_divergence', 'no_divergence', 'no_data'][id % 4 + 1] as divergence, ['load_rich', 'clean', 'mixed'][id % 3 + 1] as selection, ['no_signal', 'mild_outlier', 'strong_outlier', 'no_data', 'no_signal'][id % 5 + 1] as xpehh, ['DISTORTED', 'MENDELIAN'][id % 2 + 1] as segregation, case when id % 8 = 0 then null else ['general', 'co_shared', 'private'][id % 3 + 1] end as pangenome, ['simple_haplotype_split', 'nested_or_compound', 'recombination_gradient_like', 'noise_or_recombinant'][id // 4 % 4 + 1] as structure from intervals)"


def _axes(v: Views) -> DataFrame:
    i = F.col("id")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))
    return v.intervals.select(
        "id",
        F.when(i % 9 != 0, (F.col("end_bp") - F.col("start_bp")) / 20).alias("age"),
        pick(("strong_divergence", "weak_divergence", "no_divergence", "no_data"), i).alias("divergence"),
        pick(("load_rich", "clean", "mixed"), i).alias("selection"),
        pick(("no_signal", "mild_outlier", "strong_outlier", "no_data", "no_signal"), i).alias("xpehh"),
        pick(("DISTORTED", "MENDELIAN"), i).alias("segregation"),
        F.when(i % 8 != 0, pick(("general", "co_shared", "private"), i)).alias("pangenome"),
        pick(("simple_haplotype_split", "nested_or_compound", "recombination_gradient_like", "noise_or_recombinant"), F.floor(i / 4)).alias("structure"),
    )


@query(_AXES + " select id, case when age >= 5 and divergence = 'strong_divergence' and segregation = 'DISTORTED' then 'speciation_barrier' when selection = 'load_rich' and pangenome = 'co_shared' and segregation = 'MENDELIAN' then 'supergene' when selection = 'load_rich' and xpehh in ('mild_outlier', 'strong_outlier') then 'local_adaptation_container' when pangenome = 'co_shared' and structure in ('simple_haplotype_split', 'inversion_dosage_like') then 'ecotype_stabilizer' when divergence = 'strong_divergence' and selection <> 'load_rich' then 'recombination_modifier' when age <= 1 and selection = 'clean' and divergence in ('no_divergence', 'no_data') and xpehh in ('no_signal', 'no_data') then 'neutral_passenger' else 'unclassified' end as role from ax")
def evolutionary_role(v: Views) -> DataFrame:
    return L.evolutionary_role(_axes(v), 5.0, 1.0)


@query(_AXES + " select id, case when age < 1 then 'young' when age > 5 then 'ancient' when age is not null then 'intermediate' end as age_class, ['enriched', 'neutral', 'unknown'][id % 3 + 1] as burden_class, case when id % 8 <> 0 then ['cohort_wide', 'lineage_restricted', 'family_restricted'][id % 3 + 1] end as polymorphism_class, ['clean', 'composite_undecomposed', 'gradient', 'unknown'][id // 4 % 4 + 1] as internal_structure from ax")
def tier_axis_values(v: Views) -> DataFrame:
    return L.tier_axis_values(_axes(v))


@query(", f as (select candidate_id as id, sample_id % 4 as pop, count(*) as n, var_pop(k) as fst from calls group by all), d as (select id, max(fst) filter (n >= 5) as top, count(*) filter (n >= 5) as usable from f group by 1), z as (select candidate_id as id, max(abs(k - 1.0) * n / 10) as top, count(*) filter (abs(k - 1.0) * n / 10 >= 2) as mild from (select candidate_id, k, count(*) as n from calls group by all) group by 1) select id, case when usable = 0 then 'low_power' when d.top is null then 'no_data' when d.top >= 0.7 then 'strong_divergence' when d.top >= 0.6 then 'weak_divergence' else 'no_divergence' end as divergence, case when z.top >= 4 or mild >= 3 then 'strong_outlier' when mild > 0 then 'mild_outlier' else 'no_signal' end as xpehh from d join z using (id)")
def divergence_and_xpehh_labels(v: Views) -> DataFrame:
    id_ = F.col("candidate_id").alias("id")
    edges = v.calls.groupBy(id_, F.col("sample_id") % 4).agg(F.count("*").alias("n"), F.var_pop("k").alias("fst")).withColumn("low_power", F.col("n") < 5)
    values = v.calls.groupBy(id_, "k").agg(F.count("*").alias("n")).select("id", ((F.col("k") - 1.0) * F.col("n") / 10).alias("z"))
    return L.divergence_label(edges, 0.7, 0.6).join(L.xpehh_label(values), "id")


@query(_AXES + " select id, coalesce(divergence, '__missing__') as divergence, coalesce(pangenome, '__missing__') as pangenome, case when id % 2 = 0 then structure else '__missing__' end as structure, round(((divergence is not null)::int + (pangenome is not null)::int + (id % 2 = 0)::int) / 3, 9) as coverage from ax")
def classification_row(v: Views) -> DataFrame:
    a = _axes(v)
    return L.classification_rows([a.select("id", "divergence"), a.select("id", "pangenome"), a.where("id % 2 = 0").select("id", "structure")], ["divergence", "pangenome", "structure"], a.select("id"))


@query(", b as (select w, k, count(*) as n from per_window group by all), e as (select w as id, min(n) as smallest, count(*) as groups, stddev_pop(n) / avg(n) as sil from b group by 1), d as (select id, w.start_bp from e join windows w on w.w = e.id group by all) select id, case when id % 7 = 3 then 'dismissed' when id % 5 = 4 then 'already_covered' when sil < 0.03 then 'low_silhouette' when smallest < 5 then 'small_band' when groups < 2 then 'few_groups' when id * 40000 < 100000 then 'near_candidate' else 'pass' end as gate from e")
def l2_sweep_gates(v: Views) -> DataFrame:
    b = v.labels.groupBy("w", "k").agg(F.count("*").alias("n"))
    e = b.groupBy(F.col("w").alias("id")).agg(F.min("n").alias("smallest"), F.count("*").alias("groups"), (F.stddev_pop("n") / F.avg("n")).alias("silhouette"))
    e = e.withColumns({"dismissed": F.col("id") % 7 == 3, "covered": F.col("id") % 5 == 4, "distance": F.col("id") * 40000})
    return L.l2_gates(e, silhouette=0.03)


@query(", e as (select id as env_id, start_bp // 30 as grp, start_bp, end_bp from intervals), r as (select *, row_number() over (partition by grp order by start_bp, env_id) as i, count(*) over (partition by grp) as n from e) select grp, min(start_bp) as start_bp, max(end_bp) as end_bp, count(*) as n, max(env_id) filter (i = n // 2 + 1) as reference from r group by 1")
def promote_envelopes(v: Views) -> DataFrame:
    return L.promote_envelopes(v.intervals.select(F.col("id").alias("env_id"), F.floor(F.col("start_bp") / 30).alias("grp"), "start_bp", "end_bp"))
