"""Feature importance tables (ML16) and the dashboard driver views (SV6, SV7).

Importances come either from fitted tree models (``models.model_importances``)
or, deterministically, from the data (``statistical_importance``): two
per-feature measures computed in one aggregate over the encoded table. Either
way the combination step is the same: join on feature, average ranks (W1),
mean rank, sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.customers import TARGET_COL
from .correlation import pearson
from .ranking import average_rank

IMP_DP = 6


def statistical_importance(enc: DataFrame, features: Sequence[str], target: str = TARGET_COL) -> DataFrame:
    """feature, imp_a, imp_b; each column sums to 1 over the features.

    imp_a = |Pearson r(x, y)|; imp_b = |mean(x | y=1) - mean(x | y=0)| /
    (max x - min x). Undefined values (constant column) count as 0.

    One scan in long form: rows are unpivoted to (feature, x, y) inside the
    scan stage and aggregated per feature with map-side partial aggregation,
    so the shuffle carries (partitions x features) rows and the generated
    code stays small however many features there are. The normalisation
    runs on the per-feature table (one row per feature: bounded).
    """
    y = F.col(target).cast("double")
    long = enc.select(y.alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_x")) for f in features])).alias("_kv")
    ).select("_kv.feature", "_kv._x", "_y")
    x, yy = F.col("_x"), F.col("_y")
    per = long.groupBy("feature").agg(
        pearson(x, yy).alias("_r"), F.avg(F.when(yy == 1, x)).alias("_m1"), F.avg(F.when(yy == 0, x)).alias("_m0"),
        F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    per = per.select("feature", F.coalesce(F.abs(F.col("_r")), F.lit(0.0)).alias("a"),
                     F.coalesce(F.try_divide(F.abs(F.col("_m1") - F.col("_m0")), F.col("_hi") - F.col("_lo")),
                                F.lit(0.0)).alias("b"))
    tot = Window.partitionBy()  # one row per feature: bounded
    return per.select("feature",
                      F.bround(F.try_divide(F.col("a"), F.sum("a").over(tot)), IMP_DP).alias("imp_a"),
                      F.bround(F.try_divide(F.col("b"), F.sum("b").over(tot)), IMP_DP).alias("imp_b"))


def combined_importance(features: DataFrame, imp_a: DataFrame, imp_b: DataFrame) -> DataFrame:
    """ML16 (J2 + W1): feature, imp_a, imp_b, rank_a, rank_b, avg_rank;
    sorted by avg_rank. Inputs: (feature), (feature, imp_a), (feature, imp_b);
    all are one row per feature, so the joins are broadcast-sized by
    construction and the rank windows run on the feature table."""
    j = features.join(F.broadcast(imp_a), "feature").join(F.broadcast(imp_b), "feature")
    j = average_rank(j, "imp_a", "rank_a")
    j = average_rank(j, "imp_b", "rank_b")
    j = j.withColumn("avg_rank", (F.col("rank_a") + F.col("rank_b")) / 2.0)
    return j.orderBy("avg_rank", "feature")


def churn_drivers(combined: DataFrame, top: int = 10) -> DataFrame:
    """SV6: readable feature name ('_' -> ' ', one long label shortened) and
    the mean of the two importances at 4 dp (half-up, as Math.round); top."""
    name = F.replace(F.regexp_replace(F.col("feature"), "_", " "),
                     F.lit("tenure category Loyal (4y+)"), F.lit("tenure(Loyal 4y+)"))
    imp = F.round((F.coalesce(F.col("imp_a"), F.lit(0.0)) + F.coalesce(F.col("imp_b"), F.lit(0.0))) / 2.0, 4)
    top_rows = combined.orderBy("avg_rank", "feature").limit(top)
    w = Window.orderBy("avg_rank", "feature")
    return top_rows.select(F.row_number().over(w).alias("position"), name.alias("feature"), imp.alias("importance"))


def driver_percent(drivers: DataFrame, top: int = 8) -> DataFrame:
    """SV7: name with '_' -> ' ', round(importance * 100) (half-up); top 8."""
    return drivers.orderBy("position").limit(top).select(
        "position", F.regexp_replace(F.col("feature"), "_", " ").alias("name"),
        F.round(F.col("importance") * 100.0, 0).cast("long").alias("importance"))
