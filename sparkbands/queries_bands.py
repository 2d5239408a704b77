"""Queries of the operators on bands along windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import bands as D
from .operators import clusters as C
from .operators import kmeans as K
from .operators import votes as V
from .operators.columns import steady_mean
from .registry import query
from .views import Views


def _envelopes(v: Views) -> DataFrame:
    """Three windows an envelope, as many as the track has."""
    return v.track.select(F.floor(F.col("w") / 3).cast("int").alias("env_id")).distinct().select("env_id", (F.col("env_id") * 3).alias("s0"), (F.col("env_id") * 3 + 2).alias("e0"))


_ENV = ", agg as (select w // 3 as env_id, sample_id, avg(value) as mean, median(value) as median, avg(k) as mean2, count(*) as n_windows from per_window group by all), envs as (select distinct w // 3 as env_id from per_window)"


@query(_ENV + " select env_id, sample_id, round(mean, 9) as mean, round(median, 9) as median, round(mean2, 9) as mean2, n_windows from agg")
def aggregate_l2(v: Views) -> DataFrame:
    return D.aggregate_l2(v.per_window.withColumn("value2", F.col("k")), _envelopes(v))


def _env_bands(v: Views) -> tuple[DataFrame, DataFrame]:
    """Labels by the best number of clusters of each envelope, and what was chosen."""
    rows = D.aggregate_l2(v.track, _envelopes(v)).select("env_id", "sample_id", F.col("mean").alias("value"))
    return K.adaptive(rows, ["env_id"], 2, 4, 3)


def _l2(then: str) -> str:
    from .queries import adaptive_sql, kmeans_sql

    return _ENV + ", src as (select env_id, sample_id, mean as value from agg)" + adaptive_sql("src", "env_id") + kmeans_sql("src", "env_id", out="fixed") + then


_FLAG = ", en as (select w // 3 as env_id, count(distinct w) as n_windows from per_window group by all), fl as (select env_id, used_k, best.silhouette, smallest, n_windows, case when n_windows < 2 then 'LOW_NWIN' when smallest < 3 then 'LOW_GROUP_N' else 'ok' end as flag from best join en using (env_id))"


def _flags(v: Views, best: DataFrame) -> DataFrame:
    n = v.track.select("w").distinct().groupBy(F.floor(F.col("w") / 3).cast("int").alias("env_id")).agg(F.count("*").alias("n_windows"))
    return D.cluster_l2(best, n)


@query(_l2(_FLAG + " select env_id, used_k, round(silhouette, 9) as silhouette, smallest, n_windows, flag from fl"))
def cluster_l2(v: Views) -> DataFrame:
    return _flags(v, _env_bands(v)[1])


@query(_l2(_FLAG + " select b.env_id, b.env_id * 3 as s0, b.env_id * 3 + 2 as e0, b.sample_id, family_id, used_k, b.k, f.k as fixed_k, round(fl.silhouette, 9) as silhouette, flag from bands b join fixed f on f.env_id = b.env_id and f.sample_id = b.sample_id left join samples on samples.sample_id = b.sample_id join fl on fl.env_id = b.env_id"))
def k_labels_table(v: Views) -> DataFrame:
    bands, best = _env_bands(v)
    bands = D.stored(bands)
    fixed = C.kmeans_1d(bands.select("env_id", "sample_id", "value"), by="env_id").select("env_id", "sample_id", F.col("k").alias("fixed_k"))
    return D.k_labels_table(bands.join(fixed, ["env_id", "sample_id"]), v.samples, _envelopes(v), _flags(v, best))


@query(
    """, x as (select a.w, a.sample_id, a.value, b.value as prev from per_window a left join per_window b on b.w = a.w - 1 and b.sample_id = a.sample_id), r as (select w, corr(value, prev) as r from x group by w),
c as (select w, case when sum((coalesce(r, 0) < 0)::int) over (order by w) % 2 = 1 then -1 else 1 end as chain from r), s as (select p.w, p.sample_id, chain, value * chain as value from per_window p join c using (w)),
m as (select sample_id, avg(value) as mean from s group by 1), q as (select w, chain, corr(value, mean) as r from s join m using (sample_id) group by 1, 2),
n as (select *, case when abs(r) >= 0.10 then case when r < 0 then -chain else chain end end as now from q) select w, coalesce(last_value(now ignore nulls) over (order by w rows unbounded preceding), chain)::int as sign, round(r, 9) as consensus_r from n"""
)
def sign_align(v: Views) -> DataFrame:
    return D.sign_align(v.track)


_WHOLE = ", wn as (select sample_id, k, count(*) as n from per_window group by all), wh as (select sample_id, arg_max(k, n * 10 - k) as k from wn group by 1), wm as (select sample_id, avg(value) as m from per_window group by 1)"


@query(_WHOLE + ", t as (select k, abs(avg(m)) as size from wm join wh using (sample_id) group by 1), b as (select k from t order by size desc, k limit 1), ch as (select sample_id from wm join wh using (sample_id) where k = (select k from b) order by abs(m) desc, sample_id limit 10) select w, sign(avg(value))::int as sign, count(*) as n from per_window where sample_id in (select sample_id from ch) group by 1")
def ordered_pc1_reference(v: Views) -> DataFrame:
    return D.reference_samples(v.track, v.labels)


@query(_WHOLE + ", x as (select sample_id, case k when 0 then 1 when 2 then 0 else 999 end as rank, m from wm join wh using (sample_id)) select sample_id, rank, row_number() over (order by rank, m, sample_id) - 1 as place from x")
def order_samples(v: Views) -> DataFrame:
    whole = v.labels.groupBy("sample_id").agg(F.mode("k", True).alias("grp"))
    rows = v.track.groupBy("sample_id").agg(steady_mean("value").alias("pc1")).join(whole, "sample_id")
    return D.order_samples(rows, v.spark.createDataFrame([(2, 0), (0, 1)], "grp int, rank int"))


_PC = ", pc as (select sample_id, avg(dosage) as pc1 from dosage where marker < 8 group by 1)"


def _pc(v: Views) -> DataFrame:
    return v.dosage.where("marker < 8").groupBy("sample_id").agg(F.avg("dosage").alias("pc1"))


@query(_PC + ", r as (select marker, abs(corr(dosage, pc1)) as r from dosage join pc using (sample_id) group by 1) select marker, round(r, 9) as r, row_number() over (order by r desc, marker) as place from r")
def order_markers(v: Views) -> DataFrame:
    return D.order_markers(v.dosage, _pc(v))


@query(_PC + ", d as (select marker, sample_id, dosage, pc1 from dosage join pc using (sample_id)), m as (select marker, avg(dosage) as m, covar_pop(dosage, pc1) as c from d group by 1) select marker, sample_id, case when c < 0 then -1 else 1 end as sign, round((dosage - m) * case when c < 0 then -1 else 1 end, 9) as centred from d join m using (marker)")
def center_and_polarize(v: Views) -> DataFrame:
    return D.center_and_polarize(v.dosage, _pc(v))


def _spans(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(s, 4 * s, 4 * s + 7) for s in range(14)], "span int, first int, last int")


@query(", s as (select unnest(range(14)) as span) select span::int as span, sample_id, round(avg(dosage), 9) as mean, count(dosage) as n from dosage join s on marker between 4 * span and 4 * span + 7 group by all")
def profile_matrix(v: Views) -> DataFrame:
    return D.profile_matrix(v.dosage, _spans(v))


@query(
    """, b as (select label as grp, sample_id, marker // 8 as bin, avg(dosage) as mean from dosage join embeddings on vec_id = sample_id group by all),
p as (select a.grp, a.sample_id as s1, c.sample_id as s2, a.bin, abs(a.mean - c.mean) as d, abs(a.mean - c.mean) < 0.5 as alike from b a join b c on a.grp = c.grp and a.bin = c.bin and a.sample_id < c.sample_id),
l as (select *, lag(alike) over (partition by s1, s2 order by bin) as prev, row_number() over (partition by s1, s2 order by bin) - row_number() over (partition by s1, s2, alike order by bin) as isle from p),
i as (select s1, s2, max(c) as best from (select s1, s2, isle, count(*) as c from l where alike group by all) group by all),
g as (select grp, s1, s2, avg(d) as diff, count(*) as n, count(*) filter (prev <> alike) as switches from l group by all)
select grp, s1, s2, round(greatest(0.0, diff + 0.5 * switches / (n - 1) - 0.15 * coalesce(best, 0) / n), 9) as distance from g left join i using (s1, s2)"""
)
def trajectory_distance(v: Views) -> DataFrame:
    label = v.table("embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("g"))
    bins = v.dosage.join(label, "sample_id").groupBy(F.col("g").alias("grp"), "sample_id", F.floor(F.col("marker") / 8).alias("bin")).agg(F.avg("dosage").alias("mean"))
    return D.trajectory_distance(bins)


@query(", b as (select w, k, count(*) as n from per_window group by all), r as (select w, k, rank() over (partition by w order by n) as r from b) select w, string_agg(k || ':' || r, '|' order by k) as signature from r group by 1")
def window_rank_signature(v: Views) -> DataFrame:
    return D.rank_signature(v.labels.groupBy("w", "k").agg(F.count("*").alias("value")))


_STEPS = ", bn as (select w, k, count(*) as n from per_window group by all), st as (select w, max(n) / sum(n) as share, ln(sum(n)) - sum(n * ln(n)) / sum(n) as entropy, arg_max(k, n * 10 - k) as band, case when max(n) / sum(n) >= 0.37 then 'co_seg' when max(n) / sum(n) >= 0.35 then 'partial' else 'split' end as verdict, w // 6 as chain from bn group by w)"


@query(_STEPS + ", g as (select *, w - row_number() over (partition by chain order by w) as run from st where verdict in ('co_seg', 'partial')), bc as (select chain, run, band, count(*) as c from g group by all), bm as (select chain, run, arg_max(band, c * 10 - band) as band from bc group by all) select chain, min(w) as start, max(w) as \"end\", count(*) as length, round(avg(share), 9) as mean_share, round(avg(entropy), 9) as mean_entropy, any_value(bm.band) as band from g join bm using (chain, run) group by chain, run having count(*) >= 2")
def track_runs(v: Views) -> DataFrame:
    n = v.labels.groupBy("w", "k").agg(F.count("*").alias("n")).groupBy("w").agg((F.max("n") / F.sum("n")).alias("share"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"), F.max_by("k", F.struct("n", -F.col("k"))).alias("band"))
    verdict = F.when(F.col("share") >= 0.37, "co_seg").when(F.col("share") >= 0.35, "partial").otherwise("split")
    return D.track_runs(n.withColumns({"verdict": verdict, "chain": F.floor(F.col("w") / 6)}))


@query(", x as (select id, case when id % 2 = 0 then 3 else 6 end as k1, case when id % 3 = 0 then 3 else 6 end as k2, case when id % 5 < 3 then 3 else 6 end as k3, (id % 11) / 10 as a1, (id % 13) / 12 as a2, id % 4 as f1, id // 4 % 4 as f2, id % 2 as s1, id // 8 % 2 as s2 from intervals) select id, case when (a1 < 0.5 and f1 + s1 = 0) or (a2 < 0.5 and f2 + s2 = 0) then 'UNSTABLE' when k1 = 3 and k2 = 3 and k3 = 3 and f1 + f2 + s1 + s2 = 0 and a1 >= 0.75 and a2 >= 0.75 then 'STABLE_3BAND' when k1 = 6 and k2 = 6 and k3 = 6 and f1 + f2 + s1 + s2 = 0 and a1 >= 0.75 and a2 >= 0.75 then 'STABLE_6BAND' when (k1 = 6 and k2 = 6 and k3 = 3 and f2 = 3 and s2 = 0) or (k1 = 6 and k2 = 3 and k3 = 3 and f1 = 3 and s1 = 0) then 'NESTED_3IN6' when k1 = 3 and k2 = 6 and k3 = 3 and f1 + s1 > 0 and f2 + s2 > 0 then 'OVERLAP_BREAKS_3' else 'UNSTABLE' end as verdict from x")
def scale_stability_verdict(v: Views) -> DataFrame:
    i = F.col("id")
    pane = lambda ok: F.when(ok, 3).otherwise(6)
    return D.scale_stability(v.intervals.select("id", pane(i % 2 == 0).alias("k1"), pane(i % 3 == 0).alias("k2"), pane(i % 5 < 3).alias("k3"), ((i % 11) / 10).alias("ari12"), ((i % 13) / 12).alias("ari23"), (i % 4).alias("fuse12"), (F.floor(i / 4) % 4).alias("fuse23"), (i % 2).alias("split12"), (F.floor(i / 8) % 2).alias("split23")))


_KINDS = ", kb as (select w as id, k, case when k = 1 then 'het' else 'hom' end as kind, median(value) as centre, avg(value) as mean, avg(value) / 50 as dosage from per_window group by w, k)"


def _kinds(v: Views) -> DataFrame:
    kind = F.when(F.col("k") == 1, "het").otherwise("hom")
    return v.per_window.groupBy(F.col("w").alias("id"), "k").agg(F.median("value").alias("centre"), F.avg("value").alias("mean"), (F.avg("value") / 50).alias("dosage")).withColumn("kind", kind)


@query(_KINDS + ", r as (select *, row_number() over (partition by id, kind order by centre nulls last, k) as p, count(*) over (partition by id, kind) as n from kb) select id, k, case when kind = 'het' then 'HET' when n = 1 then 'HOM' when p = 1 then 'HOM_REF' when p = n then 'HOM_INV' else 'HOM_MID' end as role from r")
def karyotype_roles(v: Views) -> DataFrame:
    return D.karyotype_roles(_kinds(v))


@query(", m as (select w as id, sample_id % 7 as block, avg(case when sample_id % 7 <> 5 then value end) as centre from per_window group by all) select id, block, round(centre, 9) as centre, row_number() over (partition by id order by centre nulls last, block) as number from m")
def arrangement_order(v: Views) -> DataFrame:
    block = F.col("sample_id") % 7
    return D.arrangement_order(v.per_window.select(F.col("w").alias("id"), block.alias("block"), F.when(block != 5, F.col("value")).alias("centre")))


@query(", h as (select w as id, k, value / 100 as het from per_window), m as (select id, k, stddev_samp(het) >= 0.15 as two from h group by all), s as (select id, k, count(*) as n, avg((het is not null and het < 0.4)::int) as low, avg((het is null or (het >= 0.4 and het < 0.5))::int) as mid, avg((het >= 0.5)::int) as high from h group by all) select id, k, n, round(low, 9) as low, round(mid, 9) as mid, round(high, 9) as high, case when two then 'mixed' when low >= 0.7 then 'hom-like' when high >= 0.7 then 'het-like' else 'ambiguous' end as reading, coalesce(two, false) as sub_band from s left join m using (id, k)")
def band_divergence_class(v: Views) -> DataFrame:
    het = v.per_window.select(F.col("w").alias("id"), "k", (F.col("value") / 100).alias("het"))
    return D.band_divergence_class(het, het.groupBy("id", "k").agg((F.stddev_samp("het") >= 0.15).alias("two_modes")))


@query(_KINDS + ", h as (select *, row_number() over (partition by id order by centre, k) as h from kb where kind = 'hom'), n as (select a.id, a.k, h.h, row_number() over (partition by a.id, a.k order by abs(a.centre - h.centre), h.h) as i from kb a join h on h.id = a.id where a.kind = 'het') select id, k, 'H' || h as name from h where h <= 3 union all select id, k, string_agg('H' || h, '/' order by h) as name from n where i <= 2 group by id, k")
def band_haplotypes(v: Views) -> DataFrame:
    return D.band_haplotypes(_kinds(v))


@query(_KINDS + ", x as (select *, min(mean) over (partition by id) as lo, max(mean) over (partition by id) as hi, count(*) over (partition by id) as n from kb), y as (select *, case when hi > lo then (mean - lo) / (hi - lo) end as share, abs(mean - (lo + hi) / 2) as off, abs(dosage - 1) as dev from x where n >= 3), m as (select id, arg_min(k, off) as k from (select * from y where share between 0.2 and 0.8 order by k) group by 1), d as (select id, arg_min(k, dev) as k from (select * from y where dev <= 0.35 order by k) group by 1) select id, coalesce(m.k, d.k) as k, case when m.k is not null then 'midpoint' when d.k is not null then 'dosage' end as by from (select distinct id from y) left join m using (id) left join d using (id)")
def het_band_candidate(v: Views) -> DataFrame:
    return D.het_band_candidate(_kinds(v))


@query(", s as (select sample_id, count(*) filter (k = w % 3) as n_het, count(*) filter (k = (w + 1) % 3) as n_hom_a, count(*) filter (k = (w + 2) % 3) as n_hom_b from per_window group by 1) select *, case when n_het + n_hom_a + n_hom_b < 3 then 'UNCALLED' when greatest(n_het, n_hom_a, n_hom_b) / (n_het + n_hom_a + n_hom_b) >= 0.66 then case when n_het = greatest(n_het, n_hom_a, n_hom_b) then 'HET' when n_hom_a = greatest(n_het, n_hom_a, n_hom_b) then 'HOM_A' else 'HOM_B' end else 'AMBIGUOUS' end as call from s")
def karyotype_calls_from_skeleton(v: Views) -> DataFrame:
    w = F.col("w")
    return D.calls_from_skeleton(v.labels, v.labels.select("w").distinct().select("w", (w % 3).alias("het"), ((w + 1) % 3).alias("hom_a"), ((w + 2) % 3).alias("hom_b")))


@query(", x as (select sample_id, w as axis, case when k < 2 then ['REF', 'HET'][k + 1] end as a, case when value < 40 then 'REF' when value < 60 then 'HET' when value < 90 then 'INV' end as b from per_window), y as (select *, case when a is null and b is null then 'NA' when a = b then 'HIGH' when a is not null and b is not null then 'FLAGGED' else 'LOW' end as confidence from x) select sample_id, axis, case when confidence <> 'FLAGGED' then coalesce(a, b) end as state, confidence from y")
def karyotype_call_per_axis(v: Views) -> DataFrame:
    a = F.when(F.col("k") == 0, "REF").when(F.col("k") == 1, "HET")
    b = F.when(F.col("value") < 40, "REF").when(F.col("value") < 60, "HET").when(F.col("value") < 90, "INV")
    return D.karyotype_call_per_axis(v.per_window.select("sample_id", F.col("w").alias("axis"), a.alias("by_pc1"), b.alias("by_dosage")))


@query(", x as (select id, case when id % 6 <> 0 then id % 40 end as trajectory, case when id % 3 = 0 then -1 else 1 end as sign, ['SINGLE', 'SPLIT', 'NOISE', 'MERGE'][id % 4 + 1] as projection, case when id % 10 = 0 then null else ['CLEAN', 'CONFLICT'][id // 2 % 2 + 1] end as vote from intervals), f as (select *, trajectory is not null as t, projection not in ('EMPTY', 'NOISE') as p, coalesce(vote not in ('CONFLICT', 'NO_DATA'), false) as o from x), g as (select *, t and p and projection not in ('SPLIT', 'MERGE') as tp, t and o as tv, p and o as pv from f), n as (select trajectory, least(avg((sign = -1)::int), 1 - avg((sign = -1)::int)) >= 0.20 as two from x where trajectory is not null group by 1) select id, case when tp and tv and pv then 'ALL_AGREE' when tp then 'TRAJ_PROJ_AGREE' when tv then 'TRAJ_VOTE_AGREE' when pv then 'PROJ_VOTE_AGREE' when t or p or o then 'DISAGREE' else 'INSUFFICIENT' end as agreement, case when trajectory is not null then trajectory || case when two then case when sign = -1 then '-' else '+' end else '' end end as macro_group from g left join n using (trajectory)")
def karyotype_model(v: Views) -> DataFrame:
    i = F.col("id")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))
    return D.karyotype_model(v.intervals.select("id", F.when(i % 6 != 0, i % 40).alias("trajectory"), F.when(i % 3 == 0, -1).otherwise(1).alias("sign"), pick(("SINGLE", "SPLIT", "NOISE", "MERGE"), i).alias("projection"), F.when(i % 10 != 0, pick(("CLEAN", "CONFLICT"), F.floor(i / 2))).alias("vote")))


_ALL = ", tb as (select x.w as w1, y.w as w2, x.k as a, y.k as b, count(*) as n from per_window x join per_window y on x.sample_id = y.sample_id and x.w <> y.w group by all)"


def _table(v: Views, neighbours: bool = False) -> DataFrame:
    """Windows against all others, or each against the next: a chromosome's seeds, met as bitmaps."""
    w = v.labels.select("w").distinct()
    met = F.col("w2") == F.col("w1") + 1 if neighbours else F.col("w1") != F.col("w2")
    pairs = w.select(F.col("w").alias("w1")).join(w.select(F.col("w").alias("w2")), met)
    return D.stored(V.pair_table(V.band_bits(v.labels, ()), pairs, ()))


_PROJ = (
    _ALL
    + """, t1 as (select *, sum(n) over (partition by w1, w2, a) as t, n / sum(n) over (partition by w1, w2, a) as share from tb),
t2 as (select *, sum(case when share >= 0.25 and n >= 3 then share end) over (partition by w1, w2, a order by share desc, b rows unbounded preceding) as cum, share >= 0.25 and n >= 3 as ok from t1),
t3 as (select w1, w2, a, max(t)::bigint as n_focal, max(share) as max_purity, max(cum) filter (ok) as held, list_sort(list(b) filter (ok and cum - share < 0.7)) as visited from t2 group by 1, 2, 3),
vo as (select w1, w2, a, n_focal, max_purity, case when n_focal < 5 then 'EMPTY' when max_purity >= 0.7 then 'SINGLE' when held >= 0.7 then 'SPLIT' else 'SCATTER' end as pattern, visited as vis from t3),
vt as (select * exclude (vis), case when pattern = 'SINGLE' then vis[1]::varchar when pattern = 'SPLIT' then array_to_string(vis, ',') else '' end as visited from vo)
"""
)


def _votes(v: Views) -> DataFrame:
    return D.projections(_table(v), purity=0.7, second=0.25)


@query(_PROJ + " select w1, w2, a, n_focal, round(max_purity, 9) as max_purity, pattern, visited from vt")
def breadth_votes(v: Views) -> DataFrame:
    """Also projection_stability: every voter set against every other window."""
    return _votes(v)


@query(_PROJ + " select w1, w2, string_agg(pattern, '|' order by a) as patterns, count(*) filter (pattern in ('SINGLE', 'SPLIT')) as n_informative from vt group by w1, w2")
def seed_votes(v: Views) -> DataFrame:
    """The pattern of each of a seed's bands among another seed's."""
    t = _votes(v).groupBy("w1", "w2")
    return t.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "pattern"))), lambda x: x["pattern"]), "|").alias("patterns"), F.count_if(F.col("pattern").isin("SINGLE", "SPLIT")).alias("n_informative"))


@query(_PROJ + " select w2 as w, count(*) as n, count(*) filter (pattern in ('SINGLE', 'SPLIT')) as n_informative, round(count(*) filter (pattern in ('SINGLE', 'SPLIT')) / count(*), 9) as share, case when count(*) filter (pattern in ('SINGLE', 'SPLIT')) < 3 then 'UNDETERMINED' when count(*) filter (pattern in ('SINGLE', 'SPLIT')) / count(*) >= 0.30 then 'VALID' else 'NOISE' end as verdict from vt group by w2")
def seed_reliability(v: Views) -> DataFrame:
    return D.seed_reliability(_votes(v))


@query(
    (_PROJ + ", gd as (select distinct w1, w2 from vt where pattern in ('SINGLE', 'SPLIT')), ge as (select x.w1 as a, x.w2 as b from gd x join gd y on x.w1 = y.w2 and x.w2 = y.w1), rc as (select distinct w as n, w as c from per_window union select ge.a, rc.c from rc join ge on ge.b = rc.n), lc as (select n, min(c) as c from rc group by 1) select n as w, dense_rank() over (order by c) - 1 as \"group\" from lc").replace(", tb as", ", tb as", 1)
)
def linkage_groups(v: Views) -> DataFrame:
    return D.linkage_groups(_votes(v), v.labels.select("w").distinct())


_SIG = _ALL + ", s1 as (select *, sum(n) over (partition by w1, w2, a) as ra, sum(n) over (partition by w1, w2, b) as cb, sum(n) over (partition by w1, w2) as t from tb), sg as (select w1, w2, max(t)::bigint as n, count(distinct a) as r, count(distinct b) as c, sum(n * n / (ra * cb)) as q, sum(-n * ln(n / ra)) / max(t) as h from s1 group by w1, w2), an as (select w1, w2, n, case when n >= 5 then case when least(r, c) < 2 then 0.0 else least(1.0, sqrt(greatest(0.0, (q - 1) / (least(r, c) - 1)))) end end as v, case when n >= 5 then h end as entropy from sg)"


@query(_SIG + " select w1, w2, n, round(v, 9) as v, case when n < 4 then 'INSUFFICIENT' when v >= 0.15 then 'MERGE' else 'SEPARATE' end as verdict from an where w2 = w1 + 1")
def adjacent_seed_merge(v: Views) -> DataFrame:
    return D.adjacent_seed_merge(V.anchor_signals(_table(v, neighbours=True), 3, ()), merge=0.15)


_MEANS_BY_W = ", mw as (select w, sample_id % 40 as g, avg(value) as m from per_window group by all), rr as (select x.g as a, y.g as b, corr(x.m, y.m) as r from mw x join mw y on x.w = y.w and x.g < y.g group by all)"


@query(
    _MEANS_BY_W
    + ", ee as (select * from rr where abs(r) >= 0.6), dd as (select a * 2 as a, b * 2 + (r < 0)::int as b from ee union all select a * 2 + 1, b * 2 + 1 - (r < 0)::int from ee), du as (select a, b from dd union all select b, a from dd), rc as (select unnest([g * 2, g * 2 + 1]) as n, unnest([g * 2, g * 2 + 1]) as c from (select distinct g from mw) union select du.a, rc.c from rc join du on du.b = rc.n), lc as (select n, min(c) as c from rc group by 1) select n // 2 as node, c // 2 as grp, case when c % 2 = 0 then 1 else -1 end as sign from lc where n % 2 = 0"
)
def trajectory_groups(v: Views) -> DataFrame:
    m = v.per_window.groupBy("w", (F.col("sample_id") % 40).alias("g")).agg(F.avg("value").alias("m"))
    r = m.withColumnsRenamed({"g": "a", "m": "x"}).join(m.withColumnsRenamed({"g": "b", "m": "y"}), "w").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
    return D.signed_groups(r, m.select(F.col("g").alias("node")).distinct(), 0.6)


_SETS = ", me as (select distinct l_suppkey as id, l_returnflag as chrom, l_partkey as sample_id from lineitem where l_linestatus = 'F'), sn as (select id || chrom as id, chrom, sample_id from me), sc as (select id, count(*) as n from sn group by 1), sp as (select x.id as id1, y.id as id2, count(*) as n_both from sn x join sn y on x.sample_id = y.sample_id and x.id < y.id group by all), sj as (select id1, id2, n_both, n_both / (p.n + q.n - n_both) as jaccard from sp join sc p on p.id = id1 join sc q on q.id = id2)"


def _sets(v: Views) -> DataFrame:
    m = v.table("lineitem").where("l_linestatus = 'F'").select("l_suppkey", F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("sample_id")).distinct()
    return m.select(F.concat(F.col("l_suppkey").cast("string"), "chrom").alias("id"), "chrom", "sample_id")


@query(_SETS + " select id1, id2, n_both, round(jaccard, 9) as jaccard from sj where right(id1, 1) <> right(id2, 1) and n_both >= 5 and jaccard >= 0.05")
def cross_chrom_links(v: Views) -> DataFrame:
    s = _sets(v)
    return D.cross_chrom_links(s.select("id", "sample_id"), s.select("id", "chrom").distinct(), jaccard=0.05)


@query(_SETS + ", hx as (select id1 as a, id2 as b from sj where jaccard >= 0.06), hu as (select a, b from hx union all select b, a from hx), rc as (select distinct id as n, id as c from sn union select hu.a, rc.c from rc join hu on hu.b = rc.n) select n as node, min(c) as component from rc group by 1")
def het_axes(v: Views) -> DataFrame:
    """Bands whose sample sets reach a Jaccard are one axis."""
    s = _sets(v)
    p = D.set_pairs(s.select("id", "sample_id"), []).where("jaccard >= 0.06")
    return D.components(p.select(F.col("id1").alias("a"), F.col("id2").alias("b")), s.select(F.col("id").alias("node")).distinct())


_TOPO = ", o as (select i.id, start_bp, end_bp, o_custkey as c from intervals i join orders on id = o_orderkey), tp as (select x.id as id1, y.id as id2, x.start_bp as s1, x.end_bp as e1, y.start_bp as s2, y.end_bp as e2, (x.id * y.id) % 9 as shared, (x.id + y.id) % 10 / 10 as jaccard from o x join o y on x.c = y.c and x.id < y.id), tq as (select *, greatest(0, least(e1, e2) - greatest(s1, s2)) as ov, least(e1 - s1, e2 - s2) as small from tp), tr as (select *, case when ov > 0 then 0 else greatest(0, greatest(s1, s2) - least(e1, e2)) end as gap, case when small > 0 then ov / small else 0 end as held from tq)"


def _neighbours(v: Views) -> DataFrame:
    o = v.intervals.join(v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c")), "id").select("id", "start_bp", "end_bp", "c")
    p = o.withColumnsRenamed({"id": "id1", "start_bp": "s1", "end_bp": "e1"}).join(o.withColumnsRenamed({"id": "id2", "start_bp": "s2", "end_bp": "e2"}), "c").where("id1 < id2")
    return p.withColumns({"shared": F.col("id1") * F.col("id2") % 9, "jaccard": (F.col("id1") + F.col("id2")) % 10 / 10})


@query(_TOPO + " select id1, id2, ov as overlap_bp, gap as gap_bp, case when held >= 0.9 and jaccard >= 0.3 then 'nested' when ov > 0 and not jaccard >= 0.3 then 'overlapping_conflict' when gap <= 200 and shared >= 3 and jaccard >= 0.5 then 'chained' when gap <= 200 and not jaccard >= 0.3 then 'adjacent' else 'independent' end as relation from tr")
def regime_topology(v: Views) -> DataFrame:
    return D.regime_topology(_neighbours(v), 200, 0.3)


@query(_TOPO + ", ir as (select *, (id1 % 10) / 10 as aa, (id2 % 10) / 10 as bb, (id1 % 7) / 7 as ab, (id2 % 7) / 7 as ba, (id1 % 4) / 4 as hh, (s1 >= s2 and e1 <= e2) or (s2 >= s1 and e2 <= e1) as inside from tr) select id1, id2, case when gap <= 200 and least(ab, ba) >= 0.5 and least(ab, ba) > least(aa, bb) then 'swapped' when gap <= 200 and least(aa, bb) >= 0.5 and not inside then 'extension' when inside and least(aa, bb) >= 0.5 then 'nested' when hh >= 0.5 then 'shared_het' else 'unrelated' end as relation from ir")
def interval_relations(v: Views) -> DataFrame:
    n, one, two = _neighbours(v), F.col("id1"), F.col("id2")
    gap = F.greatest(F.lit(0), F.greatest("s1", "s2") - F.least("e1", "e2"))
    inside = ((F.col("s1") >= F.col("s2")) & (F.col("e1") <= F.col("e2"))) | ((F.col("s2") >= F.col("s1")) & (F.col("e2") <= F.col("e1")))
    return D.interval_relations(n.select("id1", "id2", gap.alias("gap_bp"), inside.alias("inside"), (one % 10 / 10).alias("aa"), (two % 10 / 10).alias("bb"), (one % 7 / 7).alias("ab"), (two % 7 / 7).alias("ba"), (one % 4 / 4).alias("hh")), gap=200)


@query(_TOPO + ", sx as (select id1 as a, id2 as b, case when (id1 + id2) % 3 = 0 then -1.0 else 1.0 end as r from tr where gap <= 60 and jaccard >= 0.6), sd as (select a * 2 as a, b * 2 + (r < 0)::int as b from sx union all select a * 2 + 1, b * 2 + 1 - (r < 0)::int from sx), su as (select a, b from sd union all select b, a from sd), rc as (select id * 2 as n, id * 2 as c from intervals union select id * 2 + 1, id * 2 + 1 from intervals union select su.a, rc.c from rc join su on su.b = rc.n), lc as (select n, min(c) as c from rc group by 1) select n // 2 as node, c // 2 as grp, case when c % 2 = 0 then 1 else -1 end as sign from lc where n % 2 = 0")
def signed_regime_clusters(v: Views) -> DataFrame:
    n = _neighbours(v)
    gap = F.greatest(F.lit(0), F.greatest("s1", "s2") - F.least("e1", "e2"))
    edges = n.where((gap <= 60) & (F.col("jaccard") >= 0.6)).select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.when((F.col("id1") + F.col("id2")) % 3 == 0, -1.0).otherwise(1.0).alias("r"))
    return D.signed_groups(edges, v.intervals.select(F.col("id").alias("node")), 0.5)


_MEMBERS = ", mm as (select w // 3 as regime, w as member, case when w % 2 = 0 then 1 else -1 end as sign, ['hom_a', 'het', 'hom_b'][k + 1] as band, sample_id from per_window)"


@query(_MEMBERS + ", x as (select *, case when sign = -1 then case band when 'hom_a' then 'hom_b' when 'hom_b' then 'hom_a' else band end else band end as b from mm), n as (select regime, count(distinct member) as m from mm group by 1), h as (select x.regime, b, sample_id, count(distinct member) as hits from x group by all) select regime, b as band, count(*) as n, min(sample_id) as first, max(sample_id) as last from h join n using (regime) where b = 'het' or hits = m group by all")
def refine_regimes(v: Views) -> DataFrame:
    band = F.element_at(F.array(*map(F.lit, ("hom_a", "het", "hom_b"))), F.col("k") + 1)
    return D.refine_regimes(v.labels.select(F.floor(F.col("w") / 3).alias("regime"), F.col("w").alias("member"), F.when(F.col("w") % 2 == 0, 1).otherwise(-1).alias("sign"), band.alias("band"), "sample_id"))


@query("select id, chrom, end_bp - start_bp as span, chrom || ':' || id as uid from intervals")
def merge_per_chrom_regimes(v: Views) -> DataFrame:
    t = v.intervals.select("id", "chrom", (F.col("end_bp") - F.col("start_bp")).alias("span"))
    chroms = [r.chrom for r in t.select("chrom").distinct().collect()]  # one table a chromosome
    return D.merge_per_chrom([t.where(F.col("chrom") == c) for c in chroms])


@query(", l as (select event_type as chrom, floor(s / 3600)::int as w, ['fst', 'pi', 'dxy', 'other'][user_id % 4 + 1] as name, value, row_number() over (order by user_id, s, value) as ord from ev), f as (select *, row_number() over (partition by chrom, w, name order by ord) as i from l where name in ('fst', 'pi', 'dxy')) select f.chrom, f.w, name, round(value, 9) as value from f join windows w on w.chrom = f.chrom and w.w = f.w and w.n_snps >= 2 where i = 1")
def merge_enrichment_layers(v: Views) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("fst", "pi", "dxy", "other"))), (F.col("user_id") % 4 + 1).cast("int"))
    layers = v.events.select(F.col("event_type").alias("chrom"), F.floor(F.col("s") / 3600).cast("int").alias("w"), name.alias("name"), "value", F.struct("user_id", "s", "value").alias("ord"))
    return D.merge_layers(v.windows.where("n_snps >= 2"), layers, ["fst", "pi", "dxy"])
