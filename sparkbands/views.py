"""The engine's tables, shaped from the star-schema and event tables of a data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.columns import steady_mean

_START = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))"


class Views:
    """Lazy tables; each reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select("user_id", "event_type", "value", F.expr(f"floor({_START} / 1000000)").alias("s"))

    @cached_property
    def per_window(self) -> DataFrame:
        """One row for each user and run of three days."""
        by = self.events.groupBy(F.floor(F.col("s") / 259200).cast("int").alias("w"), F.col("user_id").alias("sample_id"))
        return by.agg((F.count("*") % 3).cast("int").alias("k"), steady_mean("value").alias("value"))

    @property
    def labels(self) -> DataFrame:
        return self.per_window.select("w", "sample_id", "k")

    @property
    def track(self) -> DataFrame:
        return self.per_window.select("w", "sample_id", "value")

    @cached_property
    def panel(self) -> DataFrame:
        """Running sums of each user's values along the half days of each event type, as chromosomes of many windows."""
        from pyspark.sql import Window as W

        cell = self.events.groupBy(F.col("event_type").alias("chrom"), F.floor(F.col("s") / 43200).cast("int").alias("w"), F.col("user_id").alias("sample_id")).agg(F.sum("value").alias("x"))
        last = F.broadcast(cell.agg(F.max("w").alias("last")))  # one row
        grid = cell.select("chrom", "sample_id").distinct().join(last).select("chrom", "sample_id", F.explode(F.sequence(F.lit(0), "last")).alias("w"))
        run = W.partitionBy("chrom", "sample_id").orderBy("w").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row for each window
        return grid.join(cell, ["chrom", "sample_id", "w"], "left").select("chrom", "w", "sample_id", F.sum(F.coalesce("x", F.lit(0.0))).over(run).alias("value"))

    @cached_property
    def panel_bands(self) -> DataFrame:
        """Four bands of each window of the panel, by the distance from the mean in standard deviations."""
        s = self.panel.groupBy("chrom", "w").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
        z = F.round((F.col("value") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd")), 9)
        k = F.when(z < -0.8, 0).when(z < 0.0, 1).when(z < 0.8, 2).otherwise(3)
        return self.panel.join(s, ["chrom", "w"]).select("chrom", "w", "sample_id", k.alias("k"), "value", z.alias("z"))

    @cached_property
    def windows(self) -> DataFrame:
        """Hours of each event type as windows along it."""
        m, sd = self.events.agg(F.avg("value"), F.stddev_pop("value")).first()
        w = self.events.groupBy(F.col("event_type").alias("chrom"), F.floor(F.col("s") / 3600).cast("int").alias("w"))
        w = w.agg(F.count("*").cast("int").alias("n_snps"), F.var_pop("value").alias("lam1"), F.avg("value").alias("lam2"))
        return w.select("chrom", "w", (F.col("w").cast("long") * 3600).alias("start_bp"), (F.col("w").cast("long") * 3600 + 3599).alias("end_bp"), "n_snps", "lam1", "lam2", ((F.col("lam2") - m) / sd).alias("z"))

    @cached_property
    def points(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("chrom"), F.col("s").alias("pos_bp"))

    @cached_property
    def dosage(self) -> DataFrame:
        """Vectors as markers by samples, values in [0, 2]; three groups of samples."""
        e = self.table("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("marker", "x"))
        d = F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 + 2 * F.col("x").cast("double")))
        return e.select("marker", (1000 * (F.col("marker") + 1)).cast("long").alias("pos_bp"), F.col("vec_id").alias("sample_id"), (F.col("label") % 3).alias("grp"), d.alias("dosage"))

    @cached_property
    def intervals(self) -> DataFrame:
        """Orders as intervals of days, from the order date to the last ship date."""
        day = lambda c: F.datediff(c, F.lit("1992-01-01")).cast("long")
        last = self.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("ship"))
        o = self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("chrom"), F.col("o_orderstatus").alias("source"), "o_orderdate")
        return o.join(last, "id").select("id", "chrom", "source", day(F.col("o_orderdate")).alias("start_bp"), F.greatest(day(F.col("ship")), day(F.col("o_orderdate"))).alias("end_bp"))

    @cached_property
    def measures(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderpriority").alias("test_id"), F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("value"))

    @cached_property
    def calls(self) -> DataFrame:
        """Suppliers as candidates and parts as samples; the flag of the smallest line is the label."""
        k = F.create_map(*(F.lit(x) for x in ("A", 0, "N", 1, "R", 2)))
        line = F.struct("l_orderkey", "l_linenumber", "l_returnflag")
        g = self.table("lineitem").groupBy(F.col("l_suppkey").alias("candidate_id"), F.col("l_partkey").alias("sample_id")).agg(F.min(line).alias("m"))
        return g.select("candidate_id", "sample_id", k[F.col("m.l_returnflag")].alias("k"))

    @cached_property
    def kin(self) -> DataFrame:
        """Relatedness edges a < b: parts that follow one another in an order, by the larger discount."""
        from pyspark.sql import Window as W

        other = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_discount"))
        p = self.table("lineitem").select(F.col("l_partkey").alias("x"), other.alias("y"), "l_discount").where("y is not null and x <> y")
        return p.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg((F.max("l_discount") * 3).alias("kinship"))

    @cached_property
    def variants(self) -> DataFrame:
        """Allele counts by site, sample and allele: orders' lines as reads of four alleles at sites of a chromosome."""
        allele = F.element_at(F.array(*map(F.lit, "ACGT")), (F.col("l_linenumber") % 4 + 1).cast("int"))
        site = self.table("lineitem").select(F.col("l_shipdate").alias("d"), F.col("l_returnflag").alias("chrom"), F.col("l_suppkey").alias("sample_id"), allele.alias("allele"), F.col("l_quantity").cast("long").alias("reads"))
        return site.select("chrom", (F.datediff("d", F.lit("1992-01-01")) * 1000).cast("long").alias("pos_bp"), "sample_id", "allele", "reads")

    @cached_property
    def samples(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("family_id"), F.col("c_mktsegment").alias("ancestry"))


#: The same tables for SQL, as common table expressions; later ones may use earlier ones.
SQL_VIEWS = {
    "ev": "select user_id, event_type, value, floor(epoch_us(ts) / 1000000 - 1704067200)::bigint as s from events",
    "per_window": "select floor(s / 259200)::int as w, user_id as sample_id, (count(*) % 3)::int as k, avg(value) as value from ev group by all",
    "pcell": "select event_type as chrom, floor(s / 43200)::int as w, user_id as sample_id, sum(value) as x from ev group by all",
    "pgrid": "select chrom, sample_id, unnest(range((select max(w) + 1 from pcell)))::int as w from (select distinct chrom, sample_id from pcell)",
    "panel": "select g.chrom, g.w, g.sample_id, sum(coalesce(x, 0.0)) over (partition by g.chrom, g.sample_id order by g.w) as value from pgrid g left join pcell c on c.chrom = g.chrom and c.sample_id = g.sample_id and c.w = g.w",
    "pz": "select *, round((value - avg(value) over (partition by chrom, w)) / nullif(stddev_pop(value) over (partition by chrom, w), 0), 9) as z from panel",
    "pband": "select chrom, w, sample_id, case when z < -0.8 then 0 when z < 0.0 then 1 when z < 0.8 then 2 else 3 end as k, value, z from pz",
    "windows": "select event_type as chrom, floor(s / 3600)::int as w, floor(s / 3600)::bigint * 3600 as start_bp, floor(s / 3600)::bigint * 3600 + 3599 as end_bp, count(*)::int as n_snps, var_pop(value) as lam1, avg(value) as lam2, (avg(value) - (select avg(value) from ev)) / (select stddev_pop(value) from ev) as z from ev group by all",
    "points": "select event_type as chrom, s as pos_bp from ev",
    "emb": "select vec_id, label, unnest(embedding) as x, unnest(range(len(embedding))) as marker from embeddings",
    "dosage": "select marker::int as marker, 1000 * (marker + 1) as pos_bp, vec_id as sample_id, label % 3 as grp, least(2, greatest(0, 1 + 2 * x::double)) as dosage from emb",
    "ship": "select l_orderkey as id, max(l_shipdate) as ship from lineitem group by all",
    "intervals": "select id, o_orderpriority as chrom, o_orderstatus as source, date_diff('day', date '1992-01-01', o_orderdate::date) as start_bp, greatest(date_diff('day', date '1992-01-01', ship::date), date_diff('day', date '1992-01-01', o_orderdate::date)) as end_bp from orders join ship on id = o_orderkey",
    "measures": "select o_orderpriority as test_id, o_orderstatus as grp, o_totalprice as value from orders",
    "calls": "select l_suppkey as candidate_id, l_partkey as sample_id, case arg_min(l_returnflag, l_orderkey * 100 + l_linenumber) when 'A' then 0 when 'N' then 1 else 2 end as k from lineitem group by all",
    "kin": "select least(x, y) as a, greatest(x, y) as b, max(d) * 3 as kinship from (select l_partkey as x, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_discount) as y, l_discount as d from lineitem) where y is not null and x <> y group by all",
    "variants": "select l_returnflag as chrom, date_diff('day', date '1992-01-01', l_shipdate::date) * 1000 as pos_bp, l_suppkey as sample_id, ['A', 'C', 'G', 'T'][l_linenumber % 4 + 1] as allele, l_quantity::bigint as reads from lineitem",
    "samples": "select c_custkey as sample_id, c_nationkey as family_id, c_mktsegment as ancestry from customer",
}


def with_views(sql: str) -> str:
    """A query, or more expressions and a query (beginning with a comma), after the tables."""
    return ("with recursive " if "union select" in sql or "union all select" in sql else "with ") + ",\n".join(f"{k} as ({v})" for k, v in SQL_VIEWS.items()) + "\n" + sql
