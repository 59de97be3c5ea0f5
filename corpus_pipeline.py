"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, mixing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; ``run`` writes each
result as Parquet into the shared checkpoint folder and reads it again for the next one. All stages but the last
return the columns of ``documents``; the last returns every document as often as the mix takes it, numbered by ``copy``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm import decontam, jaccard, langid, linededup, mixing
from churnlake.llm.common import cut, small
from churnlake.session import ensure_checkpoint_dir

#: Documents whose language is less certain than this go, as do those without a letter.
LEAST_SCORE = 0.4


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (doc_id, each once); null is an id like any other."""
    ids = small(cut(ids.withColumnRenamed("doc_id", "_id")))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labelled ones; rows that share a doc_id stay if one of them would."""
    said = langid.label(docs).withColumn("ok", (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _without(docs, said.groupBy("doc_id").agg(F.max("ok").alias("ok")).where("not ok").select("doc_id"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; those of which nothing is left go."""
    out = linededup.dedup(docs)
    return out.where((F.col("n_dropped") == 0) | (F.trim("text") != "")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each class of near duplicates."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus."""
    return mixing.mix(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontaminate", decontaminate), ("mix_sources", mix)]

#: A trained network and components of a graph are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
