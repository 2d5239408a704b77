"""A training corpus from raw documents: five stages, each a DataFrame in and out.

A filtering stage keeps the rows that its operator accepts, with the columns of
the documents.  Decisions are made for each row by itself: rows without an id, or
with one that others have too, are told apart.  Null texts are empty: the classifiers give them the
score of a text that says nothing, the mix leaves them out, as it does texts
without words.  The mix repeats a document once for each whole pass that takes
it, and once more if the last pass takes at least half of its words; each file
it writes holds its rows in the order of the schedule.  Equal rows are near
duplicates like others, so one of them stays.  An empty table gives an empty
table, columns beyond those of the documents are dropped.  The last stage returns (doc_id, n_tokens, ids_sha256), one row for each row of the mix.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbands.llm import bpe_reuse, mixing, near_dup, quality, toxicity
from sparkbands.llm.common import maybe_in, shared_folder, written
from sparkbands.llm.queries import word_bpe_path
from sparkbands.llm.text import batches

#: Columns of the documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _scored(docs: DataFrame, model) -> DataFrame:
    """Adds the model's ``score`` of each row's text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            found = [sent.value.score(f["text"].tolist()) for f in batches([part.to_frame("text")], "text", 2 << 20)]
            yield pd.Series(np.concatenate(found) if found else np.empty(0))

    return docs.select(*COLUMNS, score("text").alias("score"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds ``mark``, a hash of the row, and ``row``, a key that only this row has; written once, so the key stays what it is."""
    return written(docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("mark"), F.monotonically_increasing_id().alias("row")), "keyed")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return _scored(docs, model).where("score < 0.5").select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, _labels(spark, sf_dir))
    return _scored(docs, model).where("score >= 0.7").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words and a similarity of 0.8; one row of each group stays, of those with the smallest id."""
    docs = _keyed(docs)
    groups = near_dup.link(docs.select(F.col("row").alias("doc_id"), "text"), width=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("row"), "component_id").join(docs.select("row", "doc_id", "mark"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row"))
    keep = written(groups.groupBy("component_id").agg(first.alias("first")).select("first.row"), "kept")
    drop = written(groups.select("row").join(keep, "row", "left_anti"), "dropped")
    # rows that are surely not among those to drop stay where they are
    docs = maybe_in(docs, drop, ["row"])
    rest = docs.where("maybe").join(drop, "row", "left_anti")
    return docs.where("not maybe").unionByName(rest.select(docs.columns)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(docs)
    taken = mixing.mix(docs, keep=("mark", "row"))
    times = F.floor(F.when(F.col("size") > 0, F.col("taken") / F.col("size") + 0.5).otherwise(0)).cast("int")
    many = written(taken.select("row", times.alias("times"), "first_slot").where("times > 0"), "times")
    # almost as many rows as documents: never broadcast, whatever the size
    rows = docs.join(many.hint("merge"), "row").withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return rows.sortWithinPartitions("copy", "first_slot").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe_reuse.encode(docs, word_bpe_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("toxicity", not_toxic),
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each_group),
    ("source mix", mixed),
    ("BPE", encoded),
]

#: Two learned models and minwise search have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
