"""Small things that the operators share: the shared folder, splits by crc32, plain document columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="sparkbands-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps survive lost executors without the lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, n: int) -> Column:
    """crc32(id as text) mod n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, held_out: int, sample: int) -> tuple[DataFrame, dict]:
    """Rows (doc_id, text, y, at) of at most ``sample`` labelled documents per class, and the class sizes.

    Only ids outside the held-out remainder count.  Null labels and ids are left
    out; an id labelled more than once counts as 1 if any label is.  The sample
    is the ids with the smallest hash ``at``, so reruns agree.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.where(remainder("doc_id", n) != held_out).withColumn("at", F.xxhash64("doc_id"))
    size = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("at", "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows of three numbers
    return written(texts.repartition(16), f"{label}-rows"), size


def map_texts(docs: DataFrame, run, schema: str) -> DataFrame:
    """docs(doc_id, text) through mapInPandas; ids travel as text, so null ids and large ones stay what they are."""
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def maybe_in(rows: DataFrame, wanted: DataFrame, keys: list[str], words: int = 1 << 20) -> DataFrame:
    """Adds ``maybe``: false only for rows whose keys are not in ``wanted``, true for all others and a few more.

    The keys' hashes set bits in at most ``words`` numbers of 64 bits, a table
    of bounded size that is broadcast.  So rows with long texts that are not
    wanted, or those that are not to be left out, need no shuffle.
    """
    at = lambda: F.pmod(F.xxhash64(*keys), F.lit(words * 64))
    bits = wanted.select(at().alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    rows = rows.withColumn("bit", at()).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(bits), "word", "left")
    return rows.withColumn("maybe", F.coalesce(F.expr("bit_get(bits, cast(bit % 64 as int))") == 1, F.lit(False))).drop("bit", "word", "bits")
