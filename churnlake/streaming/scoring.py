"""Incremental feature + risk scoring of arriving customer rows.

The feature projections (FE4-FE16) and the serving projections (SV1, SV5)
are row-local, so they run unchanged on a streaming DataFrame. The two
table statistics (max late payments, NPS terciles) are fitted once on the
train table and joined as a static one-row side (stream-static join), i.e.
the ``stats_from='train'`` mode: a stream has no "whole table" to refit on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import banding, soften
from ..operators.features import engineer_features, feature_stats
from ..operators.serving import STATUS_CUTS, STATUS_DEFAULT
from ..plans.base import score_expr
from ..session import ensure_checkpoint_dir
from ..sources.customers import CUSTOMER_SCHEMA


def read_customer_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Customer rows arriving as parquet files under ``path`` (explicit schema)."""
    r = spark.readStream.schema(CUSTOMER_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def score_stream(stream: DataFrame, train: DataFrame) -> DataFrame:
    """Features with train statistics, deterministic risk probability,
    softened risk score and status for every arriving row."""
    st = feature_stats(train)
    feats = engineer_features(stream, st)
    p = score_expr()
    return feats.select("*", p.alias("churn_probability")).select(
        "*", F.bround(soften("churn_probability"), 6).alias("risk_score_pct")).withColumn(
        "status", banding(F.col("risk_score_pct"), STATUS_CUTS, STATUS_DEFAULT))


def start_scoring(spark: SparkSession, source: str, train: DataFrame, sink: str, name: str = "churn_scoring",
                  available_now: bool = True) -> StreamingQuery:
    """Start the scoring stream into a parquet sink; the checkpoint lives in
    the shared checkpoint folder so a restarted driver resumes exactly."""
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = (score_stream(read_customer_stream(spark, source), train).writeStream
         .format("parquet").option("path", sink).option("checkpointLocation", ckpt).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
