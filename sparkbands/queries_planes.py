"""Queries of the operators in the plane and along paths, with SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import bands as D
from .operators import clusters as C
from .operators import joins as J
from .operators import planes as P
from .operators.columns import steady_mean
from .queries import _SIL, kmeans_sql
from .registry import query
from .views import Views


def _points(v: Views) -> DataFrame:
    by = v.events.groupBy(F.floor(F.col("s") / 259200).cast("int").alias("w"), F.col("user_id").alias("sample_id"))
    return by.agg(steady_mean("value").alias("x"), F.max("value").alias("y"))


def _kmeans_2d_sql(rounds: int = 8) -> str:
    far = [f"((x - x{i}) * (x - x{i}) + (y - y{i}) * (y - y{i}))" for i in range(3)]
    near = f"case when {far[0]} <= {far[1]} and {far[0]} <= {far[2]} then 0 when {far[1]} <= {far[2]} then 1 else 2 end"
    out = ", po as (select floor(s / 259200)::int as w, user_id as sample_id, avg(value) as x, max(value) as y from ev group by all), qt as (select w, " + ", ".join(f"quantile_disc(x, {round((i + 0.5) / 3, 4)}) as q{i}" for i in range(3)) + " from po group by w)"
    out += ", c0 as (select po.w, " + ", ".join(f"avg({c}) filter (x = q{i}) as {c}{i}" for i in range(3) for c in "xy") + " from po join qt using (w) group by po.w)"
    for r in range(1, rounds + 1):
        mean = ", ".join(f"coalesce(avg({c}) filter (j = {i}), any_value({c}{i})) as {c}{i}" for i in range(3) for c in "xy")
        out += f", c{r} as (select w, {mean} from (select po.w, x, y, {near} as j, c.* exclude (w) from po join c{r - 1} c using (w)) group by w)"
    rank = "case j when 0 then (x1 < x0)::int + (x2 < x0)::int when 1 then (x0 <= x1)::int + (x2 < x1)::int else (x0 <= x2)::int + (x1 <= x2)::int end"
    own = lambda c: f"case j when 0 then {c}0 when 1 then {c}1 else {c}2 end"
    return out + f", km as (select w, sample_id, x, y, {rank} as k, {own('x')} as cx, {own('y')} as cy from (select po.w, sample_id, x, y, {near} as j, c.* exclude (w) from po join c{rounds} c using (w)))"


_KM = _kmeans_2d_sql()


@query(_KM + " select w, sample_id, round(x, 9) as x, round(y, 9) as y, k, round(cx, 9) as cx, round(cy, 9) as cy from km")
def kmeans_2d(v: Views) -> DataFrame:
    return P.kmeans_2d(_points(v))


@query(_KM + ", e as (select w, coalesce(atan2(max(cy) filter (k = 2) - max(cy) filter (k = 0), max(cx) filter (k = 2) - max(cx) filter (k = 0)), 0) as g from km group by w) select km.w, sample_id, k, round(x * cos(g) + y * sin(g), 9) as u, round(y * cos(g) - x * sin(g), 9) as v from km join e using (w)")
def uv_rotation(v: Views) -> DataFrame:
    return P.uv_rotation(D.stored(P.kmeans_2d(_points(v))))


@query(_KM + ", d as (select *, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) as d from km), s as (select w, k, avg(d) as m, stddev_samp(d) as sd from d group by all), z as (select d.sample_id, d.k, case when sd > 1e-9 then greatest(0, (d - m) / sd) else 0.0 end as z from d join s using (w, k)), c as (select sample_id, max(n) / sum(n) as consistency from (select sample_id, k, count(*) as n from z group by all) group by 1) select z.sample_id, round(avg(z), 9) as mean_z, round(max(z), 9) as max_z, count(*) as n, round(any_value(consistency), 9) as consistency, max(z) >= 2 as suspicious from z join c using (sample_id) group by z.sample_id")
def band_residual_suspicion(v: Views) -> DataFrame:
    return P.residual_suspicion(D.stored(P.kmeans_2d(_points(v))))


@query()
def band_modes(v: Views) -> DataFrame:
    """A band of a window is the key: 10 * window + band."""
    return P.band_modes(v.per_window.select((F.col("w") * 10 + F.col("k")).alias("key"), "sample_id", (F.col("value") / 100).alias("value")))


_SLAB = ", src as (select w // 5 as env_id, sample_id, avg(value) as value from per_window group by all)" + kmeans_sql("src", "env_id")


@query(_SLAB + " select env_id as slab, sample_id, k, round(value, 9) as value from bands")
def cluster_slab(v: Views) -> DataFrame:
    n = v.track.agg(F.max("w")).first()[0]
    s = v.spark.createDataFrame(P.slabs((n or 0) + 1, 2), "env_id int, s0 int, e0 int")
    return C.kmeans_1d(D.aggregate_l2(v.track, s).select("env_id", "sample_id", F.col("mean").alias("value")), by="env_id").withColumnRenamed("env_id", "slab")


_NESTED = ", nb as (select w % 2 as stratum, w, count(value) as n from per_window group by all having count(value) >= 10), src as (select stratum * 100000 + p.w as w, sample_id, value from per_window p join nb on nb.w = p.w)" + kmeans_sql("src") + _SIL.replace("per_window", "bands")


@query(_NESTED + ", si as (select w, avg(case when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end) as silhouette from ab where a is not null and b is not null group by 1) select w // 100000 as stratum, w % 100000 as w, round(silhouette, 9) as silhouette, silhouette > 0.5 as nested from si")
def nested_band_scan(v: Views) -> DataFrame:
    return P.nested_band_scan(v.track.withColumn("stratum", F.col("w") % 2))


@query()
def detect_groups(v: Views) -> DataFrame:
    return P.detect_groups(v.dosage.groupBy(F.col("grp").alias("key"), "sample_id").agg(F.avg("dosage").alias("value")))


@query()
def subsample_control(v: Views) -> DataFrame:
    pool = v.measures.select(F.col("test_id").alias("id"), "grp", "value")
    return P.subsample_control(pool.where("grp <> 'P'").select("id", "value"), pool.where("grp = 'P'").groupBy("id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), reps=20)


@query(
    """, x as (select chrom, w, n_snps::double as n, row_number() over (partition by chrom order by w) as i from windows),
p as (select f.chrom, f.w as fw, f.n as fn, x.w, x.n, case when x.i < f.i then 0 else 1 end as side, abs(x.i - f.i) as d from x f join x on x.chrom = f.chrom and x.i <> f.i),
q as (select *, sum(n) over (partition by chrom, fw, side order by d) - n as key from p),
o as (select *, sum(n) over (partition by chrom, fw order by key, side, d rows unbounded preceding) - n as before, row_number() over (partition by chrom, fw order by key, side, d) as place from q),
t as (select *, fn + before < 40.0 as taken from o),
g as (select chrom, fw, any_value(fn) + coalesce(sum(n) filter (taken), 0) as held, min(w) filter (taken) as lo, max(w) filter (taken) as hi from t group by all)
select x.chrom, x.w, coalesce(least(lo, x.w), x.w) as first, coalesce(greatest(hi, x.w), x.w) as last, coalesce(held, x.n) as held, coalesce(held, x.n) >= 40.0 as met from x left join g on g.chrom = x.chrom and g.fw = x.w"""
)
def snp_and_kb_bands(v: Views) -> DataFrame:
    """Every window as the focal one."""
    return P.grow_span(v.windows, v.windows.select("chrom", "w"), 40.0, "n_snps").drop("asymmetric")


@query(", b as (select sample_id, marker // 8 as bin, avg(dosage) as mean from dosage group by all), s as (select sample_id, string_agg(case when mean < 0.5 then '0' when mean < 1.5 then '1' else '2' end, '' order by bin) as signature from b group by 1), r as (select *, row_number() over (partition by signature order by sample_id) as i from s) select signature, count(*) as n, string_agg(sample_id, ',' order by sample_id) filter (i <= 4) as representatives from r group by 1")
def tier_signature_collapse(v: Views) -> DataFrame:
    return P.tier_signatures(v.dosage.groupBy("sample_id", F.floor(F.col("marker") / 8).alias("bin")).agg(F.avg("dosage").alias("mean")))


@query(", e as (select a as x, b as y, kinship from kin union all select b, a, kinship from kin), c as (select k.a, k.b, e.y as c, e.kinship as first, f.kinship as second from kin k join e on e.x = k.a and e.kinship >= 0.177 and e.y <> k.b join e f on f.x = k.b and f.y = e.y and f.kinship >= 0.0884 where k.kinship >= 0.177) select a, b, count(*) as n, min(c) as smallest from c group by 1, 2")
def common_relative_join(v: Views) -> DataFrame:
    return J.common_relatives(v.kin).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("c").alias("smallest"))
