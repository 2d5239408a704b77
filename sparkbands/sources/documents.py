"""Documents and layers: chromosome JSON, ancestry matrices, annotated tables, density tracks, published layers, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Document of a chromosome: windows with one array of scores in cohort order each, and envelopes with bounds that count from 1.
CHROM_SCHEMA = (
    "chrom string, samples array<string>, "
    "windows array<struct<idx int, start_bp long, end_bp long, n_snps int, lam1 double, lam2 double, z double, pc1 array<double>, pc2 array<double>>>, "
    "l2_envelopes array<struct<id string, parent_l1_id string, start_w int, end_w int>>"
)


def read_chrom_json(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """``windows``, ``scores`` (a row for each window and sample), ``samples`` and ``envelopes`` (bounds from 0) of chromosome documents, one a file or one a line."""
    doc = spark.read.option("multiLine", not lines).schema(CHROM_SCHEMA).json(path).where("chrom is not null")
    w = doc.select("chrom", "samples", F.explode("windows").alias("w"))
    each = F.posexplode(F.arrays_zip(F.col("samples").alias("sample_id"), F.col("w.pc1").alias("pc1"), F.col("w.pc2").alias("pc2"))).alias("sample_idx", "s")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c.split(".")[-1])
    return {
        "windows": w.select("chrom", F.col("w.idx").alias("w"), "w.start_bp", "w.end_bp", "w.n_snps", *(known(f"w.{c}") for c in ("lam1", "lam2", "z"))),
        "scores": w.select("chrom", F.col("w.idx").alias("w"), each).select("chrom", "w", "sample_idx", "s.sample_id", known("s.pc1"), known("s.pc2")),
        "samples": doc.select("chrom", F.posexplode("samples").alias("sample_idx", "sample_id")),
        "envelopes": doc.select("chrom", F.explode("l2_envelopes").alias("e")).select("chrom", F.col("e.id").alias("env_id"), F.col("e.parent_l1_id").alias("parent_id"), (F.col("e.start_w") - 1).alias("s0"), (F.col("e.end_w") - 1).alias("e0")),
    }


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, line) of the lines of one file that are neither blank nor comments, numbered from 0."""
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("i", "line"))


def read_ancestry_q(spark: SparkSession, q_path: str, samples_path: str) -> DataFrame:
    """(sample_id, k, q) of a matrix of shares, row by row beside a list of samples.

    Fails where rows and samples differ in number, rows in width, a share is no
    finite number, or there are fewer than 2 or more than 50 columns.
    """
    q = _numbered_lines(spark, q_path).select("i", F.split("line", r"\s+").alias("c"))
    s = _numbered_lines(spark, samples_path).select("i", F.split("line", r"\s+")[0].alias("sample_id"))
    both = q.join(s, "i", "full").withColumn("width", F.max(F.size("c")).over(W.partitionBy()))  # a row a sample of one file
    bad = F.col("c").isNull() | F.col("sample_id").isNull()
    c = F.when(bad, F.raise_error(F.lit("rows and samples differ in number")).cast("array<string>"))
    c = c.when(F.size("c") != F.col("width"), F.raise_error(F.lit("rows differ in width")).cast("array<string>"))
    c = c.when(~F.col("width").between(2, 50), F.raise_error(F.lit("a number of columns from 2 to 50 is needed")).cast("array<string>")).otherwise(F.col("c"))
    long = both.select("sample_id", F.posexplode(c).alias("k", "raw")).withColumn("x", F.col("raw").try_cast("double"))
    sure = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    return long.select("sample_id", "k", F.when(sure, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("no finite share: "), "raw")).cast("double")).alias("q"))


def read_annotated_tsv(spark: SparkSession, path: str, schema: str | None = None) -> tuple[dict[str, str], DataFrame]:
    """Parameters of the leading ``# key = value`` lines, and the rows below them."""
    params = spark.read.text(path).where(F.col("value").rlike(r"^#\s*[^=\s]+\s*="))
    pair = lambda k: F.trim(F.regexp_extract("value", r"^#\s*([^=\s]+)\s*=(.*)$", k))
    found = {r.k: r.v for r in params.select(pair(1).alias("k"), pair(2).alias("v")).collect()}  # lines of a header
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", schema=schema)
    return found, rows


def density_track_ingest(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chrom, w, class, density) of density documents, and (chrom, class, n) of the blocks that are rejected for their length."""
    schema = "chrom string, n_windows int, by_class map<string, struct<densities array<double>>>"
    doc = spark.read.option("multiLine", not lines).schema(schema).json(path)
    each = doc.select("chrom", "n_windows", F.explode("by_class").alias("class", "v")).withColumn("n", F.coalesce(F.size("v.densities"), F.lit(0)))
    good = each.where("n = n_windows").select("chrom", "class", F.posexplode("v.densities").alias("w", "density"))
    return good.select("chrom", "w", "class", "density"), each.where("n <> n_windows").select("chrom", "class", "n")


def layer_publish(df: DataFrame, folder: str, layer: str, dataset: str, stage: str, version: str, sources: list[str], schema: str | None = None) -> None:
    """Append a layer with its provenance; a normalised layer must have exactly the fields of ``schema``, and one in staging is for review."""
    if schema is not None:
        want = df.sparkSession.createDataFrame([], schema).dtypes
        if sorted(df.dtypes) != sorted(want):
            raise ValueError(f"layer {layer} has fields {sorted(df.dtypes)}, not {sorted(want)}")
    provenance = F.struct(F.lit(version).alias("schema_version"), F.lit(stage).alias("stage"), F.array(*map(F.lit, sources)).cast("array<string>").alias("sources"), F.current_timestamp().alias("created_at"), F.lit("review" if stage == "staging" else "active").alias("status"))
    out = df.withColumns({"provenance": provenance, "layer_type": F.lit(layer), "dataset_id": F.lit(dataset)})
    out.write.mode("append").partitionBy("layer_type", "dataset_id").parquet(folder)


def regime_catalogue(loci: DataFrame, members: DataFrame, settings: str) -> tuple[DataFrame, DataFrame]:
    """A record for each locus (locus, chrom_idx, s_bp, e_bp) with its bands' samples nested, numbered by place, and a manifest row.

    A locus that ends before it begins fails.  A band's samples are one array,
    as the record asks for.
    """
    bands = members.groupBy("locus", "band").agg(F.array_sort(F.collect_list("sample_id")).alias("samples"))
    bands = bands.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("band", F.size("samples").alias("n"), "samples"))).alias("bands"))
    end = F.when(F.col("e_bp") < F.col("s_bp"), F.raise_error(F.lit("a locus ends before it begins")).cast("long")).otherwise(F.col("e_bp"))
    order = W.orderBy("chrom_idx", "s_bp", "locus")  # a row a locus
    out = loci.withColumn("e_bp", end).join(bands, "locus", "left").withColumns({"index": F.row_number().over(order) - 1, "old_index": F.col("locus")})
    digest = F.substring(F.sha1(F.lit(settings).cast("binary")), 1, 12)
    manifest = out.agg(F.count("*").alias("n_loci"), F.sum(F.coalesce(F.size("bands"), F.lit(0))).alias("n_bands")).withColumn("settings_digest", digest)
    return out, manifest
