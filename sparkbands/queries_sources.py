"""Queries of the text and document sources and sinks: views are written in each format and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query
from .sources import documents, text
from .storage import new_folder
from .views import Views


def _lines(v: Views, name: str, *parts: DataFrame) -> str:
    """Text files of the parts' one column."""
    path = new_folder(v.spark, name)
    for p in parts:
        p.toDF("value").write.mode("append").text(path)
    return path


def _header(v: Views, cells: list) -> DataFrame:
    return v.spark.createDataFrame([("\t".join(cells),)], "value string")


def _by_marker(v: Views, cell) -> DataFrame:
    """(marker, cells) with a text for each sample in order of its id."""
    rows = v.dosage.groupBy("marker").agg(F.array_sort(F.collect_list(F.struct("sample_id", "dosage"))).alias("xs"))
    return rows.select("marker", F.array_join(F.transform("xs", lambda x: cell(x["dosage"])), "\t").alias("cells"))


def _samples(v: Views) -> list:
    return [str(r[0]) for r in v.dosage.select("sample_id").distinct().orderBy("sample_id").collect()]  # a header's names


@query(", m as (select max(marker) as last from dosage) select 'm' || marker as marker, 'A' as allele1, 'C' as allele2, sample_id::varchar as sample_id, round(dosage, 9) as dosage, (select last + 1 from m)::bigint as n_dropped from dosage")
def read_beagle(v: Views) -> DataFrame:
    """Every marker has a second line that is cut short."""
    ids = _samples(v)
    header = _header(v, ["marker", "allele1", "allele2", *(i for i in ids for _ in range(3))])
    text_of = lambda x: x.cast("string")
    rows = _by_marker(v, lambda d: F.concat_ws("\t", text_of((1 - d / 2) * (1 - d / 2)), text_of(d * (1 - d / 2)), text_of(d * d / 4)))
    name = F.concat(F.lit("m"), F.col("marker").cast("string"))
    good = rows.select(F.concat_ws("\t", name, F.lit("A"), F.lit("C"), "cells"))
    long, dropped = text.read_beagle(v.spark, _lines(v, "beagle", header, good, rows.select(F.concat_ws("\t", name, F.lit("A")))))
    return long.join(F.broadcast(dropped))


@query(", m as (select max(marker) as last from dosage) select 'c' || marker % 2 as chrom, pos_bp, sample_id::varchar as sample_id, case when dosage < 1.9 then round(dosage, 9) end as dosage, (select last + 1 from m)::bigint as n_dropped from dosage")
def read_dosage_matrix(v: Views) -> DataFrame:
    """Cells from 1.9 on are written as NA, and every marker has a second line without a position."""
    rows = _by_marker(v, lambda d: F.when(d < 1.9, d.cast("string")).otherwise("NA"))
    marker = F.col("marker")
    name = F.concat(F.lit("c"), (marker % 2).cast("string"), F.when(marker % 3 == 0, ":").otherwise("_"), (1000 * (marker + 1)).cast("string"))
    path = _lines(v, "dosage", _header(v, ["marker", *_samples(v)]), rows.select(F.concat_ws("\t", name, "cells")), rows.select(F.concat_ws("\t", F.lit("nowhere"), "cells")))
    long, dropped = text.read_dosage_matrix(v.spark, path)
    return long.join(F.broadcast(dropped))


@query("select distinct chrom, pos_bp from points")
def read_sites(v: Views) -> DataFrame:
    """Lines of four and of five columns; those with words for positions are skipped."""
    four = v.points.select(F.concat_ws("\t", "chrom", F.col("pos_bp").cast("string"), F.lit("A"), F.lit("C")))
    five = v.points.select(F.concat_ws(" ", F.concat_ws("_", "chrom", "pos_bp"), "chrom", "pos_bp", F.lit("A"), F.lit("C")))
    bad = v.points.select(F.concat_ws("\t", "chrom", F.lit("here"), F.lit("A"), F.lit("C")))
    return text.read_sites(v.spark, _lines(v, "sites", _header(v, ["marker", "chrom", "pos", "a", "b"]), four, five, bad))


@query(", m as (select marker, count(*) as n, avg(dosage) as mean, max(pos_bp) as pos from dosage group by 1) select 'm' || marker as marker, pos::double as pos, n::double as n, case when mean < 1 then round(mean, 9) end as mean from m")
def read_marker_sidecar(v: Views) -> DataFrame:
    """Means of 1 and more are written empty; markers are joined from the left."""
    m = v.dosage.groupBy("marker").agg(F.max("pos_bp").alias("pos"), F.count("*").alias("n"), F.avg("dosage").alias("mean"))
    name = F.concat(F.lit("m"), F.col("marker").cast("string")).alias("marker")
    path = new_folder(v.spark, "sidecar")
    m.select(name, "pos", "n", F.when(F.col("mean") < 1, F.col("mean")).alias("mean")).write.csv(path, sep="\t", header=True)
    return m.select(name).join(text.read_marker_sidecar(v.spark, path, ["pos", "n", "mean"]), "marker", "left")


@query("select p.chrom, p.w, dense_rank() over (partition by p.chrom, p.w order by sample_id) - 1 as sample_idx, sample_id::varchar as sample_id, round(value, 9) as pc1, round(-value, 9) as pc2 from panel p")
def read_chrom_json(v: Views) -> DataFrame:
    """A document for each chromosome of the panel, a line each."""
    order = F.array_sort(F.collect_list(F.struct("sample_id", "value")))
    w = v.panel.groupBy("chrom", "w").agg(order.alias("xs"))
    start = F.col("w").cast("long") * 43200
    pc = lambda sign: F.transform("xs", lambda x: x["value"] * sign)
    window = F.struct(F.col("w").alias("idx"), start.alias("start_bp"), (start + 43199).alias("end_bp"), F.lit(1).alias("n_snps"), F.lit(1.0).alias("lam1"), F.lit(0.5).alias("lam2"), F.lit(None).cast("double").alias("z"), pc(1.0).alias("pc1"), pc(-1.0).alias("pc2"))
    doc = w.groupBy("chrom").agg(F.max(F.transform("xs", lambda x: x["sample_id"].cast("string"))).alias("samples"), F.collect_list(window).alias("windows"))
    path = new_folder(v.spark, "chroms")
    doc.withColumn("l2_envelopes", F.array(F.struct(F.lit("e").alias("id"), F.lit(None).cast("string").alias("parent_l1_id"), F.lit(1).alias("start_w"), F.lit(2).alias("end_w")))).write.json(path)
    return documents.read_chrom_json(v.spark, path, lines=True)["scores"]


_TYPES = ", ut as (select user_id, event_type, count(*) as n from ev group by all), uk as (select u.user_id, t.event_type, coalesce(ut.n, 0) as n from (select distinct user_id from ev) u cross join (select distinct event_type from ev) t left join ut on ut.user_id = u.user_id and ut.event_type = t.event_type)"


@query(_TYPES + " select user_id::varchar as sample_id, dense_rank() over (order by event_type) - 1 as k, round(n / sum(n) over (partition by user_id), 9) as q from uk")
def read_ancestry_q(v: Views) -> DataFrame:
    """Shares of event types in a user's events, with comments in the list of samples."""
    kinds = [r[0] for r in v.events.select("event_type").distinct().orderBy("event_type").collect()]  # columns of the matrix
    n = v.events.groupBy("user_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("event_type") == k).alias(f"n{i}") for i, k in enumerate(kinds)))
    rows = n.orderBy("user_id").coalesce(1)
    q = _lines(v, "q", rows.select(F.concat_ws(" ", *((F.col(f"n{i}") / F.col("n")).cast("string") for i in range(len(kinds))))))
    s = _lines(v, "samples", rows.select(F.concat_ws("\n", F.lit("# a sample"), F.concat(F.col("user_id").cast("string"), F.lit(" of the cohort")))))
    return documents.read_ancestry_q(v.spark, q, s)


@query("select 'hours' as of, chrom, w, n_snps from windows")
def read_annotated_tsv(v: Views) -> DataFrame:
    """One file: parameters, a header, and the windows below."""
    head = v.spark.createDataFrame([(0, "# of = hours"), (1, "chrom\tw\tn_snps")], "i int, value string")
    rows = v.windows.select(F.lit(2).alias("i"), F.concat_ws("\t", "chrom", F.col("w").cast("string"), F.col("n_snps").cast("string")).alias("value"))
    whole = head.unionByName(rows).coalesce(1).sortWithinPartitions("i").select("value")
    params, found = documents.read_annotated_tsv(v.spark, _lines(v, "annotated", whole), "chrom string, w int, n_snps int")
    return found.withColumn("of", F.lit(params["of"]))


_DENSE = ", dn as (select chrom, w, count(*) as n, sum(value) as s from panel group by all)"


@query(_DENSE + " select chrom, 'te' as class, w, round(s / n, 9) as density, 1::bigint as n_rejected from dn")
def density_track_ingest(v: Views) -> DataFrame:
    """A document for each chromosome, in which a second class is too short and rejected."""
    d = v.panel.groupBy("chrom", "w").agg((F.sum("value") / F.count("*")).alias("d"))
    xs = F.transform(F.array_sort(F.collect_list(F.struct("w", "d"))), lambda x: x["d"])
    doc = d.groupBy("chrom").agg(xs.alias("xs")).select("chrom", F.size("xs").alias("n_windows"), F.struct(F.struct(F.col("xs").alias("densities")).alias("te"), F.struct(F.slice("xs", 1, 2).alias("densities")).alias("short")).alias("by_class"))
    path = new_folder(v.spark, "density")
    doc.write.json(path)
    good, bad = documents.density_track_ingest(v.spark, path, lines=True)
    return good.join(bad.groupBy("chrom").agg(F.count("*").alias("n_rejected")), "chrom").select("chrom", "class", "w", "density", "n_rejected")


@query("select chrom, w, n_snps, 'density' as layer_type, 'hours' as dataset_id, 'review' as status, 'v1' as schema_version, 'events' as sources from windows")
def layer_publish(v: Views) -> DataFrame:
    path = new_folder(v.spark, "layers")
    documents.layer_publish(v.windows.select("chrom", "w", "n_snps"), path, "density", "hours", "staging", "v1", ["events"], "chrom string, w int, n_snps int")
    out = v.spark.read.parquet(path)
    return out.select("chrom", "w", "n_snps", "layer_type", "dataset_id", "provenance.status", "provenance.schema_version", F.array_join("provenance.sources", ",").alias("sources"))


@query(
    """, cd as (select distinct candidate_id from calls), cs as (select distinct sample_id from calls)
select sample_id::varchar || chr(9) || string_agg(coalesce(['0/0', '0/1', '1/1'][k + 1], ''), chr(9) order by candidate_id) as line from cs cross join cd left join calls using (candidate_id, sample_id) group by sample_id
union all select 'sample_id' || chr(9) || string_agg(candidate_id::varchar, chr(9) order by candidate_id) from cd"""
)
def export_tables(v: Views) -> DataFrame:
    """The matrix of samples by candidates, which are its columns, as lines of the written files."""
    call = F.element_at(F.array(*map(F.lit, ("0/0", "0/1", "1/1"))), F.col("k") + 1)
    names = [r[0] for r in v.calls.select("candidate_id").distinct().orderBy("candidate_id").collect()]  # the header
    path = new_folder(v.spark, "export")
    text.write_karyotype_matrix(v.calls.select("sample_id", "candidate_id", call.alias("call")), names, path)
    return v.spark.read.text(path).select(F.col("value").alias("line"))


@query(
    """, lo as (select chrom, w // 10 as part, chrom || ':' || w // 10 as locus, min(w)::bigint * 43200 as s_bp, max(w)::bigint * 43200 + 43199 as e_bp from pband group by all),
bm as (select chrom || ':' || w // 10 as locus, k, count(distinct sample_id) as n, min(sample_id) as first from pband group by all)
select row_number() over (order by lo.chrom, s_bp, lo.locus) - 1 as index, lo.locus as old_index, s_bp, e_bp, count(*) as n_bands, sum(n)::bigint as n_members, (select count(*) from lo) as n_loci, (select count(*) from bm) as all_bands from lo join bm on bm.locus = lo.locus group by lo.chrom, lo.locus, s_bp, e_bp"""
)
def regime_catalogue_build(v: Views) -> DataFrame:
    """Ten windows a locus; the bands' samples are those that are in them anywhere."""
    rows = v.panel_bands.withColumn("locus", F.concat_ws(":", "chrom", F.floor(F.col("w") / 10).cast("string")))
    w = F.col("w").cast("long")
    loci = rows.groupBy("locus", F.col("chrom").alias("chrom_idx")).agg((F.min(w) * 43200).alias("s_bp"), (F.max(w) * 43200 + 43199).alias("e_bp"))
    out, manifest = documents.regime_catalogue(loci, rows.select("locus", F.col("k").alias("band"), "sample_id").distinct(), "{}")
    total = F.aggregate("bands", F.lit(0).cast("long"), lambda s, b: s + b["n"])
    out = out.select("index", "old_index", "s_bp", "e_bp", F.size("bands").cast("long").alias("n_bands"), total.alias("n_members"))
    return out.join(F.broadcast(manifest.select("n_loci", F.col("n_bands").alias("all_bands"))))
