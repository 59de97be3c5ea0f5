"""Classification metrics on (label, prediction, score) tables (ML8, ML10,
ML13, ML14, ML20). All of them reduce to conditional counts (one aggregate
with map-side partial aggregation), except the AUC which needs the order of
the scores and is computed with bucketed prefix sums (below)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRIC_DP = 6


def _r(c: Column) -> Column:
    return F.bround(c, METRIC_DP)


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction",
                     group: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp (per group)."""
    y, p = F.col(label), F.col(pred)
    aggs = [F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp")]
    return df.groupBy(*group).agg(*aggs)


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """ML13: actual, predicted, count, pct of all rows (all four cells)."""
    c = confusion_counts(df, label, pred)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return c.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(k).alias("count"),
                 _r(F.try_divide(F.col(k) * 100.0, n)).alias("pct")) for a, b, k in cells])).alias("m")).select("m.*")


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    prec = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return prec, rec, f1


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                   group: Sequence[str] = ()) -> DataFrame:
    """accuracy, f1, precision, recall of the positive class (0 when
    undefined, as scikit-learn's zero_division default)."""
    c = confusion_counts(df, label, pred, group)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    prec, rec, f1 = _prf(tp, fp, fn)
    acc = F.try_divide((tp + tn).cast("double"), tp + tn + fp + fn)
    return c.select(*group, _r(acc).alias("accuracy"), _r(f1).alias("f1"), _r(prec).alias("precision"),
                    _r(rec).alias("recall"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """ML13: rows '0', '1', 'accuracy', 'macro avg', 'weighted avg' with
    precision, recall, f1, support (scikit-learn layout)."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = _prf(tp, fp, fn)
    p0, r0, f0 = _prf(tn, fn, fp)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    acc = F.try_divide((tp + tn).cast("double"), n)
    w = lambda a, b: F.try_divide(a * s0 + b * s1, n)
    rows = [
        ("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        ("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), n),
    ]
    return c.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("class"), _r(p).alias("precision"), _r(r).alias("recall"), _r(f).alias("f1"),
                 s.cast("long").alias("support")) for k, p, r, f, s in rows])).alias("m")).select("m.*")


AUC_BUCKETS = 4096


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", group: Sequence[str] = ()) -> DataFrame:
    """ML14: exact ROC AUC with ties counted half (Mann-Whitney), per group.

    AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N) over the distinct
    scores s. The distinct scores are first reduced with partial
    aggregation (a score shared by a third of all rows is one row here).
    "Negatives below s" is a prefix sum computed in two levels, so no task
    sees every distinct score:

    * distinct scores go to equal-count buckets, whose split points come
      from an approximate quantile sketch of the distinct scores (bounded:
      ``AUC_BUCKETS`` values reach the driver) and are applied JVM-side
      (``Bucketizer``, a binary search per row). The buckets only partition
      the work, so the result stays exact, and equal counts mean no hot
      bucket even when the scores crowd into a tiny interval;
    * bucket totals get a prefix sum over the (bounded) bucket table;
    * each bucket is scanned in its own window partition.
    """
    from pyspark.ml.feature import Bucketizer
    g = list(group)
    s = F.col(score).cast("double")
    d = df.groupBy(*g, s.alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_pos"),
                                          F.count_if(F.col(label) == 0).alias("_neg"))
    probs = [i / AUC_BUCKETS for i in range(1, AUC_BUCKETS)]
    row = d.agg(F.percentile_approx("_s", probs, 10 * AUC_BUCKETS).alias("q")).head()
    cuts = sorted({float(x) for x in (row["q"] or []) if x is not None}) or [0.5]  # Bucketizer needs >= 3 splits
    splits = [float("-inf")] + cuts + [float("inf")]
    d = Bucketizer(splits=splits, inputCol="_s", outputCol="_bd", handleInvalid="keep").transform(d) \
        .withColumn("_b", F.col("_bd").cast("long")).drop("_bd")
    per_b = d.groupBy(*g, "_b").agg(F.sum("_neg").alias("_bneg"))
    wb = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.withColumn("_before", F.coalesce(F.sum("_bneg").over(wb), F.lit(0)))
    ws = Window.partitionBy(*g, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(per_b.select(*g, "_b", "_before"), [*g, "_b"]) \
        .withColumn("_below", F.col("_before") + F.coalesce(F.sum("_neg").over(ws), F.lit(0)))
    agg = d.groupBy(*g).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)).alias("_u"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return agg.select(*g, _r(F.try_divide(F.col("_u"), F.col("_p") * F.col("_n"))).alias("roc_auc"))


def evaluate(df: DataFrame, label: str = "label", pred: str = "prediction", score: str = "score",
             group: Sequence[str] = ()) -> DataFrame:
    """accuracy, f1, precision, recall, roc_auc (per group)."""
    m = binary_metrics(df, label, pred, group)
    a = roc_auc(df, label, score, group)
    return m.join(a, list(group), "inner") if group else m.crossJoin(a)


def soft_vote(df: DataFrame, prob_cols: Sequence[str], threshold: float = 0.5, out: str = "vote_probability") -> DataFrame:
    """ML8: mean of the members' class-1 probabilities; predicted 1 at >= threshold."""
    p = sum((F.col(c) for c in prob_cols[1:]), F.col(prob_cols[0])) / float(len(prob_cols))
    return df.withColumn(out, p).withColumn("vote_prediction", (F.col(out) >= threshold).cast("int"))


def rank_models(metrics: DataFrame, metric: str = "f1", model: str = "model") -> DataFrame:
    """ML10: models ranked by ``metric`` (descending, name as tie-breaker);
    ``is_champion`` marks rank 1. One row per model: a bounded window."""
    w = Window.orderBy(F.col(metric).desc(), F.col(model).asc())
    return metrics.withColumn("rank", F.row_number().over(w)).withColumn("is_champion", F.col("rank") == 1)


def model_performance(ranked: DataFrame) -> DataFrame:
    """ML20: champion metrics x 100 at 1 dp (half-even) plus its name."""
    ch = ranked.filter(F.col("is_champion"))
    pct = lambda c: F.bround(F.col(c) * 100.0, 1).alias(c)
    return ch.select(pct("f1"), pct("precision"), pct("recall"), pct("roc_auc"), pct("accuracy"),
                     F.col("model").alias("champion_model"))
