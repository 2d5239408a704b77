"""Queries from labels along chromosomes to seeds, votes and consensus, with their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import association as A
from .operators import bands as B
from .operators import clusters as C
from .operators import planes as P
from .operators import regime_tables as R
from .operators import votes as D
from .registry import query
from .storage import stored
from .views import Views

CLASSES, _REACH = 4, 12
_SEED = {"stride": 8, "search": 3, "least_quality": 0.30, "radius": 10, "extend": 10, "tries": 3, "least": 4, "thresholds": {"sure": 0.25}}


class _Bands:
    """The panel's bands, their bitmaps, and the quality of its windows, each written once."""

    def __init__(self, v: Views):
        self.v = v

    @cached_property
    def labels(self) -> DataFrame:
        return stored(self.v.panel_bands)

    @cached_property
    def bits(self) -> DataFrame:
        return D.band_bits(self.labels)

    @cached_property
    def quality(self) -> DataFrame:
        """(chrom, w, quality, size_balance, eigen, k_eff): silhouette, balance, and the variance between bands over that inside them."""
        rows = self.labels.withColumn("w", F.concat_ws(":", "chrom", F.col("w").cast("string")))
        m = rows.groupBy("w", "k").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("s"))
        spread = m.groupBy("w").agg((F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 2)).alias("lam1"), (F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("lam2"))
        q = B.band_quality(rows, C.silhouette_1d(rows).select("w", "silhouette"), spread)
        at = F.split("w", ":")
        # to nine digits, so that equal windows tie whatever the order of sums
        return stored(q.withColumns({"chrom": at[0], "w": at[1].cast("int"), "quality": F.round("quality", 9)}))

    @cached_property
    def means(self) -> DataFrame:
        return stored(self.labels.groupBy("chrom", "w", "k").agg(F.avg("value").alias("mean")))

    def table(self, radius: int) -> DataFrame:
        return stored(D.pair_table(self.bits, D.window_pairs(self.labels, radius)))

    @cached_property
    def votes(self) -> DataFrame:
        v = D.projections(self.table(_REACH), D.band_sizes(self.bits))
        return stored(D.projection_stability(v, self.bits, CLASSES))

    @cached_property
    def pairs(self) -> DataFrame:
        """Co-association at each target window, its bands being outcomes of one window."""
        votes = self.votes.withColumn("locus", F.concat_ws(":", "chrom", F.col("w2").cast("string")))
        return stored(D.coassociation(votes, grouped=True))

    @cached_property
    def kept(self) -> DataFrame:
        return stored(B.partition_scores(self.pairs.select("locus", "i", "j", "affinity", "weight"), B.partitions_of(self.v.spark, CLASSES)))


# -- quality ---------------------------------------------------------------

_QUALITY = """, pn as (select chrom, w, k, count(*) as n, avg(value) as m, var_pop(value) as s from pband group by all),
pl as (select chrom, w, (sum(n * m * m) / sum(n) - pow(sum(n * m) / sum(n), 2)) / greatest(sum(n * s) / sum(n), 1e-9) as ratio, case when count(*) > 1 then (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) else 0.0 end as bal, count(*) as k_eff from pn group by all),
pd as (select x.chrom, x.w, x.sample_id, x.k, y.k as kb, sum(abs(x.value - y.value)) as d, count(*) as c from pband x join pband y on x.chrom = y.chrom and x.w = y.w group by all),
pm_ as (select chrom, w, sample_id, max(case when k = kb and c > 1 then d / (c - 1) end) as a, min(case when k <> kb then d / c end) as b from pd group by all),
ps as (select chrom, w, avg(case when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end) as sil from pm_ where a is not null and b is not null group by all),
pq as (select chrom, w, round(least(least(1.0, greatest(0.0, sil)), bal, greatest(0.0, 1 - exp(-(ratio - 1) / 1.5))), 9) as quality, bal as size_balance, greatest(0.0, 1 - exp(-(ratio - 1) / 1.5)) as eigen, k_eff from pl join ps using (chrom, w))
"""


@query(_QUALITY + " select chrom, w, round(quality, 9) as quality, round(size_balance, 9) as size_balance, round(eigen, 9) as eigen, k_eff from pq")
def band_quality(v: Views) -> DataFrame:
    return _Bands(v).quality


@query(_QUALITY + ", t as (select chrom, count(*) as n_windows, count(*) filter (quality >= 0.3) as pass_3, count(*) filter (quality >= 0.4) as pass_4, count(*) filter (quality >= 0.5) as pass_5, avg(quality) as mean, max(quality) as max from pq group by all) select chrom, n_windows, pass_3, pass_4, pass_5, round(mean, 9) as mean, round(max, 9) as max, case when pass_5 >= 5 then 0.5 when pass_4 >= 5 then 0.4 when pass_3 >= 5 then 0.3 else round(greatest(0.2, least(0.3, max / 2)), 9) end as threshold from t")
def band_quality_stats(v: Views) -> DataFrame:
    return B.band_quality_stats(_Bands(v).quality, ("chrom",))


# -- pairs of windows ------------------------------------------------------

_PERMS = ", pm as (select row_number() over (order by a, b, c, d) - 1 as perm, [a, b, c, d] as p from range(4) t(a), range(4) u(b), range(4) x(c), range(4) y(d) where a <> b and a <> c and a <> d and b <> c and b <> d and c <> d)"


def _table_sql(on: str) -> str:
    return f", pt as (select x.chrom, x.w as w1, y.w as w2, x.k as a, y.k as b, count(*) as n from pband x join pband y on x.chrom = y.chrom and x.sample_id = y.sample_id and {on} group by all)"


def _best_sql(table: str, by: str, out: str) -> str:
    """The best permutation of each table of cells (a, b, n)."""
    return f", {out}_d as (select {by}, perm, any_value(p) as p, sum(case when p[a + 1] = b then n else 0 end) as diag, sum(n) as n from {table}, pm group by {by}, perm), {out} as (select {by}, p, diag, n from {out}_d qualify row_number() over (partition by {by} order by diag desc, perm) = 1)"


_SIGNALS = _PERMS + _best_sql("pt", "chrom, w1, w2", "bp") + """,
sc as (select pt.*, bp.p[a + 1] as own, sum(pt.n) over (partition by pt.chrom, pt.w1, pt.w2, a) as ra, sum(pt.n) over (partition by pt.chrom, pt.w1, pt.w2, b) as cb from pt join bp on bp.chrom = pt.chrom and bp.w1 = pt.w1 and bp.w2 = pt.w2),
so as (select chrom, w1, w2, sum(g) as gone, sum(g * ln(g) - nl) / ln(3) as h from (select chrom, w1, w2, a, sum(n) as g, sum(n * ln(n)) as nl from sc where b <> own group by all) group by all),
sg as (select chrom, w1, w2, sum(n)::bigint as n, count(distinct a) as r, count(distinct b) as c, sum(n * n / (ra * cb)) as q from sc group by all),
an as (select sg.chrom, sg.w1, sg.w2, n, case when n >= 5 then case when least(r, c) < 2 then 0.0 else least(1.0, sqrt(greatest(0.0, (q - 1) / (least(r, c) - 1)))) end end as v, case when n >= 5 then h / gone end as h_off from sg left join so on so.chrom = sg.chrom and so.w1 = sg.w1 and so.w2 = sg.w2)
"""


@query(_table_sql(f"x.w <> y.w and abs(x.w - y.w) <= {_REACH}") + _SIGNALS + " select chrom, w1, w2, n, round(v, 9) as v, round(h_off, 9) as h_off from an")
def anchor_signals(v: Views) -> DataFrame:
    """Each window as an anchor against those around it."""
    return D.anchor_signals(_Bands(v).table(_REACH), CLASSES)


_CHAIN = (
    _table_sql("y.w = x.w + 1")
    + _PERMS
    + _best_sql("pt", "chrom, w1, w2", "bp")
    + """,
st as (select chrom, w2 as w, diag / n as concordance, list_transform([0, 1, 2, 3], lambda c: list_position(p, c) - 1) as turn from bp),
cr as (select chrom, w, [0, 1, 2, 3]::bigint[] as turn, 0::bigint as chain, null::double as concordance from (select chrom, min(w) as w from pband group by chrom)
  union all select st.chrom, st.w, case when st.concordance < 0.5 then [0, 1, 2, 3]::bigint[] else list_transform(st.turn, lambda c: cr.turn[c + 1]) end, cr.chain + (st.concordance < 0.5)::bigint, st.concordance from cr join st on st.chrom = cr.chrom and st.w = cr.w + 1),
al as (select p.chrom, p.w, sample_id, k, turn[k + 1]::int as aligned, chain, concordance from pband p join cr on cr.chrom = p.chrom and cr.w = p.w)
"""
)


def _aligned(b: _Bands) -> DataFrame:
    return D.chain_projection(b.labels, b.bits, CLASSES)


@query(_CHAIN + " select chrom, w, sample_id, k, aligned, chain, round(concordance, 9) as concordance from al")
def chain_projection(v: Views) -> DataFrame:
    return _aligned(_Bands(v))


@query(_CHAIN + " select chrom, sample_id, chain, aligned as band, count(*) as votes from al group by all")
def k_band_votes(v: Views) -> DataFrame:
    """Windows of a chain that each sample spends in each of its bands, after alignment."""
    return _aligned(_Bands(v)).groupBy("chrom", "sample_id", "chain", F.col("aligned").alias("band")).agg(F.count("*").alias("votes"))


_LOCI = (
    _QUALITY
    + _table_sql("y.w = x.w + 1")
    + """, sz as (select chrom, w, k, count(*) as m from pband group by all),
jb as (select pt.chrom, w2 as w, a, max(n / (x.m + y.m - n)) as j from pt join sz x on x.chrom = pt.chrom and x.w = w1 and x.k = a join sz y on y.chrom = pt.chrom and y.w = w2 and y.k = b group by all),
wo as (select chrom, w, min(j) as worst from jb group by all), g as (select pq.chrom, pq.w, quality, worst from pq left join wo using (chrom, w) where quality >= 0.3),
c as (select *, (coalesce(lag(w) over (partition by chrom order by w) + 1 <> w, true) or coalesce(worst < 0.5, true))::int as cut from g), d as (select *, sum(cut) over (partition by chrom order by w) as chain from c)
"""
)


@query(_LOCI + " select chrom, min(w) as start, max(w) as \"end\", count(*) as length, round(avg(quality), 9) as quality from d group by chrom, chain having count(*) >= 3")
def locus_chains(v: Views) -> DataFrame:
    b = _Bands(v)
    table = D.pair_table(b.bits, D.window_pairs(b.labels, 1).where("w2 = w1 + 1"))
    return B.locus_chains(b.quality, B.band_jaccards(table, D.band_sizes(b.bits), ("chrom",)), 0.3, 0.5, 3, ("chrom",))


# -- seeds -----------------------------------------------------------------

_SEEDS = (
    _QUALITY
    + """, ends as (select chrom, min(w) as s0, max(w) as e0 from pq group by chrom),
grid as (select chrom, s0, e0, unnest(range(s0, e0 + 1, 8)) as center from ends),
anc as (select distinct chrom, w as anchor, quality, s0, e0 from (select g.chrom, center, s0, e0, pq.w, quality, row_number() over (partition by g.chrom, center order by quality desc, pq.w) as i from grid g join pq on pq.chrom = g.chrom and pq.w between center - 3 and center + 3) where i = 1 and quality >= 0.30),
pt as (select x.chrom, x.w as w1, y.w as w2, x.k as a, y.k as b, count(*) as n from anc join pband x on x.chrom = anc.chrom and x.w = anchor join pband y on y.chrom = x.chrom and y.sample_id = x.sample_id and y.w <> x.w and abs(y.w - x.w) <= 30 group by all)"""
    + _SIGNALS
    + """, kd as (select an.chrom, w1 as anchor, w2 as w, case when quality < 0.25 or v is null then 'UNRELIABLE' when v >= 0.7 then 'INTERIOR' when v < 0.4 then 'REGIME_END' when h_off is null or h_off <= 0.4 then 'CROSSOVER' else 'REGIME_END' end as class from an join pq on pq.chrom = an.chrom and pq.w = an.w2),
x1 as (select *, sign(w - anchor)::int as side, abs(w - anchor) as d, (class = 'REGIME_END')::int as fin from kd where class <> 'UNRELIABLE'),
x2 as (select *, sum(fin) over (partition by chrom, anchor, side order by d) as ends_ from x1),
x3 as (select *, ends_ - coalesce(max(case when fin = 0 then ends_ end) over (partition by chrom, anchor, side order by d), 0) as since from x2),
x4 as (select *, min(case when since >= 2 then d end) over (partition by chrom, anchor, side) as stopped from x3),
x5 as (select chrom, anchor, side, min(stopped) as stopped, max(d) filter (fin = 0 and d < coalesce(stopped, 1000) and d <= 10) as k1, max(d) filter (fin = 0 and d < coalesce(stopped, 1000) and d <= 20) as k2, max(d) filter (fin = 0 and d < coalesce(stopped, 1000) and d <= 30) as k3 from x4 group by all),
x6 as (select a.chrom, a.anchor, a.quality, s.side, case when s.side = 1 then e0 - a.anchor else a.anchor - s0 end as room, stopped, coalesce(k1, 0) as k1, coalesce(k2, 0) as k2, coalesce(k3, 0) as k3 from anc a cross join (select unnest([-1, 1]) as side) s left join x5 on x5.chrom = a.chrom and x5.anchor = a.anchor and x5.side = s.side),
x7 as (select chrom, anchor, quality, bool_or(coalesce(stopped > 10, true) and k1 >= least(room, 10) - 2 and room > 10) as m1, bool_or(coalesce(stopped > 20, true) and k2 >= least(room, 20) - 2 and room > 20) as m2,
  max(case when side = -1 then k1 end) as l1, max(case when side = 1 then k1 end) as r1, max(case when side = -1 then k2 end) as l2, max(case when side = 1 then k2 end) as r2, max(case when side = -1 then k3 end) as l3, max(case when side = 1 then k3 end) as r3 from x6 group by all),
x8 as (select chrom, anchor, quality, anchor - case when not m1 then l1 when not m2 then l2 else l3 end as s, anchor + case when not m1 then r1 when not m2 then r2 else r3 end as e from x7),
x9 as (select *, row_number() over (partition by chrom order by quality desc, anchor) as i from x8 where e - s + 1 >= 4),
dd as (select chrom, 1::bigint as i, [{'a': anchor, 's': s, 'e': e}] as kept from x9 where i = 1
  union all select x9.chrom, x9.i, case when len(list_filter(kept, lambda o: least(o.e, x9.e) - greatest(o.s, x9.s) + 1 >= 0.5 * (least(o.e - o.s, x9.e - x9.s) + 1))) > 0 then kept else list_append(kept, {'a': x9.anchor, 's': x9.s, 'e': x9.e}) end from dd join x9 on x9.chrom = dd.chrom and x9.i = dd.i + 1),
fs as (select x9.chrom, x9.anchor, x9.quality, x9.s, x9.e, x9.e - x9.s + 1 as n_windows from x9 join (select chrom, max_by(kept, i) as kept from dd group by chrom) k on k.chrom = x9.chrom where list_contains(list_transform(kept, lambda o: o.a), x9.anchor))
"""
)


@query(_SEEDS + " select chrom, anchor, round(quality, 9) as quality, s, e, n_windows from fs")
def seed_discovery(v: Views) -> DataFrame:
    b = _Bands(v)
    return D.seed_discovery(b.labels, b.bits, b.quality.select("chrom", "w", "quality"), CLASSES, **_SEED)


# -- regime tables ---------------------------------------------------------

_REGIMES = (
    _SEEDS
    + """, lc as (select chrom, chrom || ':' || s || '-' || e as locus, s, e from fs), lw as (select chrom, locus, s, unnest(range(s, e + 1)) as w from lc),
rp as (select l.chrom, l.locus, l.w, x.k as a, y.k as b, count(*) as n from lw l join pband x on x.chrom = l.chrom and x.w = l.s join pband y on y.chrom = l.chrom and y.w = l.w and y.sample_id = x.sample_id group by all)"""
    + _best_sql("rp", "chrom, locus, w", "rb")
    + """, rs as (select *, sum(n) over (partition by chrom, locus, w, a) as ra, sum(n) over (partition by chrom, locus, w, b) as cb from rp),
rv as (select chrom, locus, w, case when sum(n) >= 4 then case when least(count(distinct a), count(distinct b)) < 2 then 0.0 else least(1.0, sqrt(greatest(0.0, (sum(n * n / (ra * cb)) - 1) / (least(count(distinct a), count(distinct b)) - 1)))) end end as v from rs group by chrom, locus, w),
ws as (select rb.chrom, rb.locus, rb.w, rb.n::bigint as n, diag / n as agreement, v, coalesce(round(diag / n, 9) >= 0.6 and round(v, 9) >= 0.4, false) as supported, p from rb join rv on rv.chrom = rb.chrom and rv.locus = rb.locus and rv.w = rb.w)
"""
)


def _regimes(b: _Bands) -> tuple:
    seeds = D.seed_discovery(b.labels, b.bits, b.quality.select("chrom", "w", "quality"), CLASSES, **_SEED)
    name = F.concat(F.col("chrom"), F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"))
    loci = stored(seeds.select("chrom", name.alias("locus"), "s", "e"))
    support, turns = R.window_support(loci, b.bits, CLASSES)
    dosage = b.labels.select("chrom", "w", "sample_id", F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 + F.col("z"))).alias("dosage"))
    return loci, support, turns, R.reference(loci, b.labels, dosage)


@query(_REGIMES + " select chrom, locus, w, n, round(agreement, 9) as agreement, round(v, 9) as v, supported from ws")
def regime_tables(v: Views) -> DataFrame:
    """Window support of each seed's regime; samples' calls and the summary are the next two."""
    return _regimes(_Bands(v))[1]


_CALLS = (
    _REGIMES
    + """, rd as (select l.chrom, l.locus, sample_id, avg(least(2.0, greatest(0.0, 1 + z))) as dosage from lw l join pband p on p.chrom = l.chrom and p.w = l.w group by all),
rf as (select l.chrom, l.locus, p.sample_id, k as band, dosage from lc l join pband p on p.chrom = l.chrom and p.w = l.s left join rd on rd.chrom = l.chrom and rd.locus = l.locus and rd.sample_id = p.sample_id)
"""
)


@query(
    _CALLS
    + """, sh as (select rf.chrom, rf.locus, rf.sample_id, avg((ws.p[rf.band + 1] = x.k)::int) as share from rf join ws on ws.chrom = rf.chrom and ws.locus = rf.locus join pband x on x.chrom = rf.chrom and x.w = ws.w and x.sample_id = rf.sample_id group by all),
bd as (select chrom, locus, band, round(avg(dosage), 9) as bdos from rf group by all),
tt as (select rf.*, share, bdos, coalesce(round(share, 9) < 0.5, false) as weak, case when bdos <= 0.4 then 'homA_like' when bdos between 0.6 and 1.4 then 'het_like' when bdos >= 1.6 then 'homB_like' end as tier from rf join bd on bd.chrom = rf.chrom and bd.locus = rf.locus and bd.band = rf.band left join sh on sh.chrom = rf.chrom and sh.locus = rf.locus and sh.sample_id = rf.sample_id)
select chrom, locus, sample_id, band, case when weak then 'uncertain' else coalesce(tier, 'uncertain') end as call, round(share, 9) as share, round(share * case when weak or tier is null then 0.5 else 1.0 end, 9) as confidence,
 concat_ws(',', case when bdos is null then 'no_band_dosage' when tier is null then 'band_dosage_between_tiers' end, case when weak then 'low_support_fraction' end) as notes from tt"""
)
def regime_sample_calls(v: Views) -> DataFrame:
    b = _Bands(v)
    _, _, turns, ref = _regimes(b)
    return R.sample_calls(ref, b.labels, turns)


@query(
    _CALLS
    + """, np as (select x.chrom, x.w as w1, x.k as a, y.k as b, count(*) as n from pband x join pband y on y.chrom = x.chrom and y.w = x.w + 1 and y.sample_id = x.sample_id group by all)"""
    + _best_sql("np", "chrom, w1", "nb")
    + """, nr as (select *, sum(n) over (partition by chrom, w1, a) as ra, sum(n) over (partition by chrom, w1, b) as cb from np),
nv as (select chrom, w1, case when sum(n) >= 5 then case when least(count(distinct a), count(distinct b)) < 2 then 0.0 else least(1.0, sqrt(greatest(0.0, (sum(n * n / (ra * cb)) - 1) / (least(count(distinct a), count(distinct b)) - 1)))) end end as v from nr group by chrom, w1),
nn as (select nb.chrom, nb.w1, diag / n as agr, n, v from nb join nv on nv.chrom = nb.chrom and nv.w1 = nb.w1 where n >= 4 and v is not null),
s1 as (select chrom, locus, count(*) as n_windows, count(*) filter (supported) as n_supported, avg(agreement) as agreement from ws group by all),
s2 as (select lc.chrom, locus, avg(v) as mean_v, avg(agr) as pair_agreement, count(*) as n_pairs from lc join nn on nn.chrom = lc.chrom and w1 >= s and w1 + 1 <= e group by all),
s3 as (select *, row_number() over (partition by chrom, locus order by n) as i, count(*) over (partition by chrom, locus) as m from (select chrom, locus, band, count(*) as n, round(avg(dosage), 9) as d from rf group by all)),
s4 as (select chrom, locus, sum(n)::bigint as n_samples, count(*) as n_bands, count(*) filter (n >= 2) as active, coalesce(bool_or(d between 0.6 and 1.4), false) as het, string_agg(band || '=' || n, '|' order by n desc, band) as pattern, 1 - sum((2 * i - m - 1) * n) / (max(m) * sum(n)) as balance from s3 group by chrom, locus),
s5 as (select chrom, locus, count(*) filter (round(dosage, 9) <= 0.4) as n_hom_a, count(*) filter (round(dosage, 9) between 0.6 and 1.4) as n_het, count(*) filter (round(dosage, 9) >= 1.6) as n_hom_b from rf group by all),
s6 as (select lc.*, n_windows, n_supported, agreement, mean_v, pair_agreement, coalesce(n_pairs, 0) as n_pairs, n_samples, n_bands, active, het, pattern, balance, n_hom_a, n_het, n_hom_b, greatest(0, n_samples - n_hom_a - n_het - n_hom_b) as n_uncertain, n_supported / n_windows as support, round(mean_v, 9) as mv from lc join s1 using (chrom, locus) left join s2 using (chrom, locus) join s4 using (chrom, locus) join s5 using (chrom, locus)),
s7 as (select *, concat_ws(',', case when n_windows < 5 then 'few_windows' end, case when n_pairs < 4 then 'few_pairs' end, case when n_samples < 8 then 'few_samples' end, case when n_uncertain > 0 then 'uncertain=' || n_uncertain end) as notes from s6)
select chrom, locus, s, e, n_samples, n_bands, active, pattern, n_windows, n_supported, round(agreement, 9) as agreement, mv as mean_v, round(pair_agreement, 9) as pair_agreement, n_pairs, het, n_hom_a, n_het, n_hom_b, n_uncertain,
 case when mv is null or n_windows < 4 or n_pairs < 2 or n_samples < 8 then 'low_confidence_regime' when mv < 0.25 then 'diffuse_regime' when mv >= 0.5 and support < 0.5 then 'split_regime' when mv >= 0.5 and active >= 3 and n_bands >= 4 then 'nested_multiband_regime' when mv >= 0.5 and n_bands = 3 and het and active = 3 then 'stable_three_band_regime' when mv >= 0.5 then 'stable_two_band_regime' else 'low_confidence_regime' end as class,
 round(greatest(0.0, least(1.0, (0.45 * coalesce(mean_v, 0) + 0.45 * support + 0.10) * (0.5 + 0.5 * least(1.0, ln(1 + n_windows) / ln(51))) * (0.5 + 0.5 * least(1.0, sqrt(n_samples) / 10)))), 9) as confidence,
 round(0.4 * coalesce(agreement, 0) + 0.3 * least(1.0, n_supported / 20) + 0.2 * greatest(0.0, least(1.0, balance)) + 0.1 * case when notes = '' then 1.0 else 0.5 end, 9) as support_score, notes from s7"""
)
def regime_locus_summary(v: Views) -> DataFrame:
    """Also regime_class_and_confidence and the quality table's figures."""
    b = _Bands(v)
    loci, support, _, ref = _regimes(b)
    table = stored(D.pair_table(b.bits, D.window_pairs(b.labels, 1).where("w2 = w1 + 1")))
    best = D.best_permutation(table, ["chrom", "w1", "w2"], CLASSES).select("chrom", "w1", "w2", (F.col("diagonal") / F.col("n")).alias("agreement"))
    near = D.anchor_signals(table, CLASSES).join(best, ["chrom", "w1", "w2"])
    return R.locus_summary(loci, support, ref, near, CLASSES)


# -- tracks of one band ----------------------------------------------------

_TRACKED = (
    _QUALITY
    + _table_sql("abs(x.w - y.w) = 1")
    + """, sz as (select chrom, w, k, count(*) as m from pband group by all),
je as (select pt.chrom, w2 - w1 as side, w1 as w, a as k, w2 as to_w, b as to_k, n / (x.m + y.m - n) as j from pt join sz x on x.chrom = pt.chrom and x.w = w1 and x.k = a join sz y on y.chrom = pt.chrom and y.w = w2 and y.k = b),
jp as (select * from je where j >= 0.5 qualify row_number() over (partition by chrom, side, w, k order by j desc, to_k) = 1),
me as (select chrom, w, k, avg(value) as mean from pband group by all), sn as (select chrom, w, min(mean) as lo, max(mean) as hi, count(*) as n from me group by all),
hc as (select chrom, w, k from me join sn using (chrom, w) where n >= 3 and hi > lo and (mean - lo) / (hi - lo) between 0.2 and 0.8 qualify row_number() over (partition by chrom, w order by round(abs(mean - (lo + hi) / 2), 9), k) = 1),
hs as (select hc.* from hc join pq using (chrom, w) where quality >= 0.5),
tk as (select chrom, w as seed_w, k as seed_k, side, w, k, 1.0::double as j from hs cross join (select unnest([-1, 1]) as side)
  union all select tk.chrom, seed_w, seed_k, tk.side, to_w, to_k, jp.j from tk join jp on jp.chrom = tk.chrom and jp.side = tk.side and jp.w = tk.w and jp.k = tk.k),
tr as (select chrom, seed_w, seed_k, w, k, j from tk where side = 1 or w <> seed_w)
"""
)


def _tracks(b: _Bands) -> DataFrame:
    """Tracks of the heterozygous band of every window of enough quality."""
    near = D.window_pairs(b.labels, 1)
    partners = P.best_partners(B.band_jaccards(D.pair_table(b.bits, near), D.band_sizes(b.bits), ("chrom",)))
    named = b.means.withColumns({"id": F.struct("chrom", "w"), "dosage": F.lit(None).cast("double")})
    seeds = B.het_band_candidate(named).where("k is not null").select("id.chrom", "id.w", "k").join(b.quality.where("quality >= 0.5"), ["chrom", "w"], "left_semi")
    return P.single_band_track(partners, seeds)


@query(_TRACKED + " select chrom, seed_w, seed_k, w, k, round(j, 9) as jaccard from tr")
def single_band_track(v: Views) -> DataFrame:
    return _tracks(_Bands(v))


_SKELETON = _TRACKED + """, sk as (select tr.chrom, seed_w, seed_k, min(tr.w) as s, max(tr.w) as e, min(tr.w)::bigint * 43200 as start_bp, max(tr.w)::bigint * 43200 + 43199 as end_bp, count(*) as n_windows, avg(case when hi > lo then (mean - lo) / (hi - lo) end) as mean_share, coalesce(avg(j) filter (tr.w <> seed_w), 0.0) as mean_continuity, coalesce(min(j) filter (tr.w <> seed_w), 0.0) as min_continuity
  from tr join me on me.chrom = tr.chrom and me.w = tr.w and me.k = tr.k join sn on sn.chrom = tr.chrom and sn.w = tr.w group by tr.chrom, seed_w, seed_k)"""


def _skeleton(b: _Bands) -> DataFrame:
    w = F.col("w").cast("long")
    windows = b.labels.select("chrom", "w").distinct().select("chrom", "w", (w * 43200).alias("start_bp"), (w * 43200 + 43199).alias("end_bp"))
    return P.het_skeleton(_tracks(b), b.means, windows)


@query(_SKELETON + " select chrom, seed_w, seed_k, s, e, start_bp, end_bp, n_windows, round(mean_share, 9) as mean_share, round(mean_continuity, 9) as mean_continuity, round(min_continuity, 9) as min_continuity from sk")
def het_skeleton(v: Views) -> DataFrame:
    return _skeleton(_Bands(v))


@query(
    _SKELETON
    + """, iv as (select sk.chrom, start_bp, end_bp, list(sample_id) as core, row_number() over (partition by sk.chrom order by start_bp, end_bp, seed_w) as i from sk join pband p on p.chrom = sk.chrom and p.w = seed_w and p.k = seed_k group by sk.chrom, start_bp, end_bp, seed_w),
mg as (select chrom, i, start_bp as s0, end_bp as e0, core as u, 1::bigint as grp, 1::bigint as c from iv where i = 1
  union all select v.chrom, v.i, case when ok then s0 else v.start_bp end, case when ok then greatest(e0, v.end_bp) else v.end_bp end, case when ok then list_distinct(u || v.core) else v.core end, grp + (not ok)::bigint, case when ok then c + 1 else 1 end
  from (select iv.*, mg.s0, mg.e0, mg.u, mg.grp, mg.c, iv.start_bp - mg.e0 <= 43200 and len(list_intersect(mg.u, iv.core)) >= 0.5 * len(list_distinct(mg.u || iv.core)) as ok from mg join iv on iv.chrom = mg.chrom and iv.i = mg.i + 1) v)
select chrom, max(s0) as start_bp, max(e0) as end_bp, max(c) as n, max(len(u)) as n_core from mg group by chrom, grp"""
)
def merge_het_intervals(v: Views) -> DataFrame:
    """Skeletons whose heterozygous samples agree, the bitmap of the seed's band being the core."""
    b = _Bands(v)
    core = b.bits.groupBy("chrom", F.col("w").alias("seed_w"), F.col("k").alias("seed_k")).agg(F.collect_list(F.struct("chunk", "b0", "b1", "b2", "b3")).alias("core"))
    rows = stored(_skeleton(b)).join(core, ["chrom", "seed_w", "seed_k"])
    return P.merge_het_intervals(rows.select("chrom", F.col("seed_w").alias("id"), "start_bp", "end_bp", "core"), gap=43200)


@query(
    """, lk as (select chrom || ':' || w // 10 as id, sample_id, k, count(*) as c from pband group by all), lb as (select id, sample_id, arg_max(k, c * 10 - k) as k from lk group by all), tv as (select chrom || ':' || w // 10 as id, w, sample_id, value from panel),
rw as (select lb.id, lb.sample_id, k, w, value from lb join tv on tv.id = lb.id and tv.sample_id = lb.sample_id), sz as (select id, k, count(*) as n from lb group by all),
ce as (select id, k, avg(m) as centre from (select id, k, w, avg(value) as m from rw group by all) group by all),
si as (select id, k, avg(o) as sigma from (select rw.id, rw.k, sample_id, avg(abs(value - centre)) as o from rw join ce on ce.id = rw.id and ce.k = rw.k group by all) group by all),
bb as (select sz.id, sz.k, n, centre, sigma, count(*) over (partition by sz.id) as size, row_number() over (partition by sz.id order by centre, sz.k) - 1 as place, row_number() over (partition by sz.id order by sigma, sz.k) - 1 as rnk from sz join ce on ce.id = sz.id and ce.k = sz.k join si on si.id = sz.id and si.k = sz.k),
bc as (select *, max(case when rnk = size // 2 then sigma end) over (partition by id) as middle, max(case when n >= 5 then round(sigma, 9) end) over (partition by id) as hs from bb),
bd as (select *, case when middle > 0 and hs > 0 then hs / middle else 1.0 end as ratio, min(case when n >= 5 and round(sigma, 9) = hs then k end) over (partition by id) as hk from bc),
be as (select *, coalesce(k = hk and round(ratio, 9) > 1.4, false) as het, place / greatest(1, size - 1) as share from bd)
select id, k, n, round(centre, 9) as centre, round(sigma, 9) as sigma, case when size <= 3 then 'standard' else 'multi2' end as vocab,
 case when n < 5 then 'RECOMBINANT' when size <= 3 then case when het then 'HET' when place = 0 then 'HOM_REF' when place = size - 1 then 'HOM_INV' else 'HET' end when het then 'H1/H2' when share < 0.34 then 'H1/H1' when share > 0.66 then 'H2/H2' else 'H1/H2' end as label,
 case when n < 5 then 'medium' when size > 3 then case when het then 'medium' else 'low' end when het then 'high' when place = 0 or place = size - 1 then case when round(ratio, 9) > 1.4 then 'high' else 'medium' end else 'low' end as confidence from be"""
)
def band_labels_auto(v: Views) -> DataFrame:
    """Ten windows a candidate; a sample's label is the one it has most often, the lowest on ties."""
    part = F.concat_ws(":", "chrom", F.floor(F.col("w") / 10).cast("string")).alias("id")
    locked = v.panel_bands.groupBy(part, "sample_id").agg(F.mode("k", True).alias("k"))
    return B.band_labels_auto(locked, v.panel.select(part, "w", "sample_id", "value"))


# -- votes and consensus ---------------------------------------------------

_VOTES = (
    _table_sql(f"x.w <> y.w and abs(x.w - y.w) <= {_REACH}")
    + """, sz as (select chrom, w, k, count(*) as m from pband group by all),
v1 as (select p.chrom, p.w1, f.k as a, p.w2, f.m as n_focal, g.k as b, coalesce(pt.n, 0) as n, coalesce(pt.n, 0) / f.m as share from (select distinct chrom, w1, w2 from pt) p join sz f on f.chrom = p.chrom and f.w = p.w1 join sz g on g.chrom = p.chrom and g.w = p.w2 left join pt on pt.chrom = p.chrom and pt.w1 = p.w1 and pt.w2 = p.w2 and pt.a = f.k and pt.b = g.k),
v2 as (select *, max(share) over (partition by chrom, w1, a, w2) as top, row_number() over (partition by chrom, w1, a, w2 order by share desc, b) as i, share >= 0.2 and n >= 3 as ok, coalesce(sum(case when share >= 0.2 and n >= 3 then share end) over (partition by chrom, w1, a, w2 order by share desc, b rows unbounded preceding), 0.0) as cum from v1),
v3 as (select *, case when top >= 0.8 then i = 1 and n >= 3 else ok and round(cum - share, 9) < 0.8 end as t1 from v2),
v4 as (select *, t1 and (top >= 0.8 or round(sum(case when t1 then share end) over (partition by chrom, w1, a, w2), 9) >= 0.8) as taken from v3),
v5 as (select chrom, w1, a, w2, max(n_focal) as n_focal, sum(n) as n_there, max(top) as max_purity, coalesce(list(b order by b) filter (taken), []) as vis, coalesce(list(b order by b) filter (not coalesce(taken, false) and share <= 0.1), []) as exc from v4 group by all),
v6 as (select *, n_focal < 5 or n_there = 0 as none from v5),
v7 as (select chrom, w1, a, w2, n_focal, max_purity, case when none then [] else vis end as visited, case when none then [] else exc end as excluded, case when none then 'EMPTY' when len(vis) = 1 then 'SINGLE' when len(vis) = 2 then 'SPLIT_TWO' when len(vis) > 2 then 'SUBSET_SPLIT' when max_purity < 0.2 then 'SCATTER' else 'RANDOM_FAN' end as static from v6)"""
    + _PERMS
    + """, dc as (select v.chrom, v.w1, v.a as voter, v.w2, z.w, list_position(visited, y.k) - 1 as a, z.k as b, count(*) as n, max(len(visited)) as size from v7 v join pband x on x.chrom = v.chrom and x.w = v.w1 and x.k = v.a join pband y on y.chrom = v.chrom and y.w = v.w2 and y.sample_id = x.sample_id and list_contains(visited, y.k)
  join pband z on z.chrom = v.chrom and z.sample_id = x.sample_id and abs(z.w - v.w2) between 1 and 3 where static = 'SUBSET_SPLIT' group by v.chrom, v.w1, v.a, v.w2, z.w, list_position(visited, y.k) - 1, z.k),
dw as (select chrom, w from sz group by all having count(*) >= 2), de as (select dc.* from dc join dw using (chrom, w))"""
    + _best_sql("de", "chrom, w1, voter, w2, w", "dp")
    + """, dj as (select q.chrom, q.w1, q.voter, q.w2, q.w, q.d, coalesce(max(de.n) filter (de.a = d and de.b = p[d + 1]), 0) as both_, coalesce(sum(de.n) filter (de.a = d), 0) as r, coalesce(sum(de.n) filter (de.b = p[d + 1]), 0) as c from (select dp.*, unnest(range((select max(size) from de))) as d from dp where n >= 5) q join de on de.chrom = q.chrom and de.w1 = q.w1 and de.voter = q.voter and de.w2 = q.w2 and de.w = q.w where d < de.size group by all),
dk as (select chrom, w1, voter as a, w2, median(case when r + c - both_ > 0 then both_ / (r + c - both_) end) as stability from dj group by all having count(distinct w) >= 3),
vt as (select v7.*, stability, case when stability >= 0.7 then 'COHERENT_SPLIT' when stability is not null then 'RANDOM_FAN' else static end as pattern from v7 left join dk using (chrom, w1, a, w2))
"""
)


@query(_VOTES + " select chrom, w1, a, w2, n_focal, round(max_purity, 9) as max_purity, array_to_string(visited, ',') as visited, array_to_string(excluded, ',') as excluded, static, round(stability, 9) as stability, pattern from vt")
def projection_stability(v: Views) -> DataFrame:
    text = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("visited", "excluded")}
    return _Bands(v).votes.withColumns(text)


_PAIRED = _VOTES + """, cw as (select chrom || ':' || w2 as locus, visited, excluded, case pattern when 'SINGLE' then 1.0 when 'SUBSET_SPLIT' then 0.7 when 'SPLIT_TWO' then 0.5 else 0.0 end::double as weight from vt),
cm as (select locus, weight, row_number() over () as vote, visited, excluded from cw where weight > 0),
ce as (select locus, vote, weight, unnest(visited) as b, true as yes from cm union all (select locus, vote, weight, unnest(excluded), false from cm)),
pa as (select x.locus, x.b as i, y.b as j, sum(case when x.yes and y.yes then x.weight else 0 end) as together, sum(x.weight) as weight, count(*) as n_votes, sum(case when x.yes and y.yes then x.weight else 0 end) / sum(x.weight) as affinity from ce x join ce y on x.vote = y.vote and x.b < y.b group by all)
"""


@query(_PAIRED + " select locus, i, j, round(together, 9) as together, round(weight, 9) as weight, n_votes, round(affinity, 9) as affinity from pa")
def coassociation(v: Views) -> DataFrame:
    return _Bands(v).pairs


_PARTNERS = _PAIRED + """, pb as (select locus, i as band, j as other, affinity, weight from pa union all (select locus, j, i, affinity, weight from pa)),
pk as (select *, case when weight < 1 then 'none' when affinity >= 0.7 then 'primary' when affinity < 0.3 then 'excluded' when affinity >= 0.4 then 'secondary' else 'uncertain' end as kind from pb),
pz_ as (select locus, max(j) + 1 as size from pa group by locus),
pp as (select locus, band, coalesce(string_agg(other::varchar, ',' order by other) filter (kind = 'primary'), '') as "primary", coalesce(string_agg(other::varchar, ',' order by other) filter (kind = 'secondary'), '') as secondary, coalesce(string_agg(other::varchar, ',' order by other) filter (kind = 'excluded'), '') as excluded, coalesce(string_agg(other::varchar, ',' order by other) filter (kind = 'uncertain'), '') as uncertain,
  count(*) filter (kind = 'secondary') > 0 and coalesce(round(min(affinity) filter (kind = 'primary') - max(affinity) filter (kind = 'secondary'), 9) >= 0.15, true) as separable, sum(greatest(affinity, 1 - affinity) * weight) / sum(weight) as agreement, greatest(0.0, 2 * (1 - sum(greatest(affinity, 1 - affinity) * weight) / sum(weight))) as residual, sum(weight) as evidence, case when any_value(size) > 1 then count(*) filter (kind = 'secondary') / (any_value(size) - 1) else 0.0 end as conflict from pk join pz_ using (locus) group by locus, band)
"""


@query(_PARTNERS + ' select locus, band, "primary", secondary, excluded, uncertain, separable, round(agreement, 9) as agreement, round(residual, 9) as residual, round(evidence, 9) as evidence, round(conflict, 9) as conflict from pp')
def band_partner_sets(v: Views) -> DataFrame:
    return D.band_partners(_Bands(v).pairs)


_WAYS = ", gs as (select '0' || a || b || c as partition, [0, a, b, c] as g from (select unnest(range(0, 2)) as a), (select unnest(range(0, 3)) as b), (select unnest(range(0, 4)) as c) where b <= a + 1 and c <= greatest(a, b) + 1)"
_KEPT = _PARTNERS + _WAYS + ", sc1 as (select locus, partition, sum(case when g[i + 1] = g[j + 1] then affinity else 1 - affinity end * weight) / sum(weight) as score, sum(weight) as total_weight from pa, gs group by all), sc2 as (select *, max(score) over (partition by locus) as best, row_number() over (partition by locus order by round(score, 9) desc, partition) as place from sc1), kp as (select locus, partition, score, total_weight, place from sc2 where round(score, 9) >= round(best - 0.10, 9) and place <= 10)"


@query(_KEPT + " select locus, partition, round(score, 9) as score, round(total_weight, 9) as total_weight, place from kp")
def partition_scores(v: Views) -> DataFrame:
    return _Bands(v).kept


_REFINES = "len(list_distinct(list_transform([1, 2, 3, 4], lambda i: {a}[i] || {b}[i]))) = len(list_distinct(string_split({a}, '')))"


@query(
    _KEPT
    + ", b as (select locus, partition as p, score as top, total_weight as weight from kp where place = 1), o as (select kp.locus, bool_or(not ("
    + _REFINES.format(a="partition", b="p")
    + ") and not ("
    + _REFINES.format(a="p", b="partition")
    + """)) as apart from kp join b on b.locus = kp.locus where place > 1 and round(score, 9) >= 0.55 group by 1),
am as (select locus, count(*) filter (round(residual, 9) >= 0.5) as n_ambiguous from pp group by 1), gr as (select locus, avg((round(affinity, 9) between 0.3 and 0.7)::int) as grey, max(j) + 1 as size from pa group by 1),
t as (select b.locus, p, top, round(top, 9) as r, weight, apart, coalesce(n_ambiguous, 0) as n, grey, size from b left join o using (locus) left join am using (locus) left join gr using (locus))
select locus, p as partition, r as score, n as n_ambiguous, round(grey, 9) as grey, case when r < 0.5 or weight < 1 then 'NO_CLEAN_CONSENSUS' when apart then case when n > 0 and n < greatest(1, ceil(size * 0.34)) and r >= 0.65 then 'AMBIGUOUS_BAND' else 'MULTI_LAYER_STRUCTURE' end when n > 0 and r >= 0.65 then 'AMBIGUOUS_BAND' when r >= 0.85 then 'CLEAN_PARTITION' when grey >= 0.3 then 'OVERLAPPING_VOTES' else 'SOFT_PARTITION' end as consensus from t"""
)
def consensus_class(v: Views) -> DataFrame:
    b = _Bands(v)
    return D.consensus_class(b.kept, D.band_partners(b.pairs), b.pairs)


@query(_KEPT + ", r as (select locus, avg(residual) as band, avg(conflict) as conflict from pp where evidence > 0 group by 1), t as (select locus, max(score) as score, sum(score) filter (score > 0) as s, sum(score * ln(score)) filter (score > 0) as sl, count(*) as n from kp group by 1), u as (select locus, score, greatest(1 - score, coalesce(band, 0)) as residual, case when n > 1 and s > 0 then (ln(s) - sl / s) / ln(n) else 0.0 end as entropy, coalesce(conflict, 0) as conflict from t left join r using (locus)) select locus, round(score, 9) as score, round(residual, 9) as residual, round(entropy, 9) as entropy, round(conflict, 9) as conflict, case when round(residual, 9) < 0.2 then 'CLEAN_RESOLUTION' when round(residual, 9) < 0.4 then 'COMPLEX_BUT_RESOLVABLE' when round(residual, 9) < 0.6 then 'LOW_RESOLUTION_REVIEW' else 'INVALID_HIDDEN_REGIME_CONFLICT' end as resolving from u")
def consensus_summary(v: Views) -> DataFrame:
    b = _Bands(v)
    return D.consensus_summary(b.kept, D.band_partners(b.pairs))


# -- association -----------------------------------------------------------

_AMI = """, ra as (select chrom, w1, a, sum(n) as ra from pt group by all), cb as (select chrom, w1, b, sum(n) as cb from pt group by all), tt as (select chrom, w1, sum(n) as t from pt group by all),
mi as (select pt.chrom, pt.w1, sum(n / t * ln(n * t / (ra * cb))) as mi from pt join ra on ra.chrom = pt.chrom and ra.w1 = pt.w1 and ra.a = pt.a join cb on cb.chrom = pt.chrom and cb.w1 = pt.w1 and cb.b = pt.b join tt on tt.chrom = pt.chrom and tt.w1 = pt.w1 group by all),
ha as (select chrom, w1, -sum(ra / t * ln(ra / t)) as ha from ra join tt using (chrom, w1) group by all), hb as (select chrom, w1, -sum(cb / t * ln(cb / t)) as hb from cb join tt using (chrom, w1) group by all),
mg as (select chrom, w1, ra, cb, t, unnest(range(greatest(1, ra + cb - t)::bigint, least(ra, cb)::bigint + 1)) as k from ra join cb using (chrom, w1) join tt using (chrom, w1)),
em as (select chrom, w1, sum(k / t * ln(t * k / (ra * cb)) * exp(lgamma(ra + 1) - lgamma(k + 1) - lgamma(ra - k + 1) + lgamma(t - ra + 1) - lgamma(cb - k + 1) - lgamma(t - ra - cb + k + 1) - lgamma(t + 1) + lgamma(cb + 1) + lgamma(t - cb + 1))) as emi from mg group by all),
ai as (select chrom, w1 as w, t::bigint as n, mi, ha, hb, coalesce(emi, 0) as emi from mi join tt using (chrom, w1) join ha using (chrom, w1) join hb using (chrom, w1) left join em using (chrom, w1))
"""


@query(_table_sql("y.w = x.w + 1") + _AMI + " select chrom, w, n, round(mi, 9) as mi, round(case when ha > 1e-12 and hb > 1e-12 then greatest(0.0, least(1.0, mi / sqrt(ha * hb))) else 0.0 end, 9) as nmi, round(emi, 9) as emi, round(case when abs(greatest(ha, hb) - emi) < 1e-12 then 0.0 else greatest(-1.0, least(1.0, (mi - emi) / (greatest(ha, hb) - emi))) end, 9) as ami from ai")
def mutual_information_scores(v: Views) -> DataFrame:
    b = _Bands(v)
    table = D.pair_table(b.bits, D.window_pairs(b.labels, 1).where("w2 = w1 + 1"))
    return A.mutual_information(table.withColumnRenamed("w1", "w").drop("w2"), ["chrom", "w"])


@query(
    """, xr as (select a.candidate_id as c1, b.candidate_id as c2, a.k as a, b.k as b from calls a join calls b on a.sample_id = b.sample_id and a.candidate_id < b.candidate_id),
xc as (select p.c1, p.c2, i as a, j as b, count(xr.a) as m from (select distinct c1, c2 from xr) p cross join (select unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) as i, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) as j) g left join xr on xr.c1 = p.c1 and xr.c2 = p.c2 and xr.a = i and xr.b = j group by all),
xe as (select *, sum(m) over (partition by c1, c2) as n, sum(m) over (partition by c1, c2, a) * sum(m) over (partition by c1, c2, b) / sum(m) over (partition by c1, c2) as e from xc),
xd as (select *, row_number() over (partition by c1, c2 order by m desc, a, b) as i from xe),
xs as (select c1, c2, max(n)::bigint as n, sum(case when e > 0 then (m - e) * (m - e) / e else 0 end) as chi2, count(*) filter (e < 5) as few, coalesce(string_agg(a || ':' || b || ':' || m, ' ' order by m desc, a, b) filter (m >= greatest(5, ceil(0.05 * n)) and i <= 6), '') as dominant from xd group by all)
select c1, c2, n, case when n >= 10 then round(sqrt(chi2 / (n * 2)), 9) end as v, case when n >= 10 then round(chi2, 9) end as chi2, case when n >= 10 then 4 else 0 end as df, case when n >= 10 then round(exp(-chi2 / 2) * (1 + chi2 / 2), 9) end as p, case when n >= 10 then few else 0 end as cells_below_5, n < 10 or few > 0.20 * 9 as low_count, case when n >= 10 then dominant else '' end as dominant from xs"""
)
def cross_candidate_matrix(v: Views) -> DataFrame:
    return A.cross_candidate_matrix(v.calls)
