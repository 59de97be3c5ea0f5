"""Correlation operators (AG14-AG16).

Pearson r is computed as covar_samp / (stddev_samp x * stddev_samp y) with
``try_divide``: Spark's ``corr`` raises DIVIDE_BY_ZERO on a constant column
under ANSI mode (T2); this form yields NULL instead. All three aggregates use
Spark's numerically stable streaming updates and merge map-side.
All pairs of many columns (AG16) would be thousands of such aggregates in
one plan: there, Arrow batches are multiplied block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.customers import TARGET_COL
from .profile import unpivot_row

R_DP = 6


def pearson(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation, NULL for a constant column."""
    x, y = x.cast("double"), y.cast("double")
    # pairwise-complete rows, as pandas / DuckDB: mask each side by the other
    xm = F.when(y.isNotNull(), x)
    ym = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(xm) * F.stddev_samp(ym))


def target_correlation(df: DataFrame, col: str, target: str = TARGET_COL) -> DataFrame:
    """AG14: one row, r(col, target)."""
    return df.agg(F.bround(pearson(F.col(col), F.col(target)), R_DP).alias("r"))


def correlation_with_target(df: DataFrame, features: Sequence[str], target: str = TARGET_COL,
                            top: int = 15) -> DataFrame:
    """AG15: feature, r, direction; by |r| descending, top ``top``.
    One aggregate for every feature, then an unpivot of that row."""
    row = df.agg(*[pearson(F.col(f), F.col(target)).alias(f"_r{i}") for i, f in enumerate(features)])
    long = unpivot_row(row, {f: {"r": F.bround(F.col(f"_r{i}"), R_DP)} for i, f in enumerate(features)}, "feature")
    long = long.filter(F.col("r").isNotNull()).withColumn(
        "direction", F.when(F.col("r") > 0, "up").otherwise("down"))
    return long.orderBy(F.abs("r").desc(), "feature").limit(top)


PAIR_SCHEMA = "a int, b array<int>, n array<long>, mx array<double>, my array<double>, cxx array<double>, cyy array<double>, cxy array<double>"
#: A spread below this share of the mean is rounding: the column counts as constant on the pair's rows.
FLAT = 1e-14


def _moments(x: np.ndarray) -> np.ndarray:
    """Pairwise-complete moments of the columns of ``x`` (missing: NaN), by block products of values and masks: n, mean and
    squared deviations of the first column, the same of the second, product of deviations; each columns x columns."""
    present = np.isfinite(x)
    mask = present.astype(float)
    # deviations from a value of the column itself: no cancellation, and constant columns give exact zeros
    shift = np.where(present.any(0), x[present.argmax(0), np.arange(x.shape[1])], 0.0)
    dev = np.where(present, x - shift, 0.0)
    n = mask.T @ mask
    s, q, p = dev.T @ mask, (dev * dev).T @ mask, dev.T @ dev  # row: the column summed, column: whose mask
    some = np.maximum(n, 1.0)
    mx, my = s / some, s.T / some
    cxx = np.maximum(q - s * mx, 0.0)
    return np.stack([n, mx + shift[:, None], my + shift[None, :], cxx, cxx.T, p - s * my])


def _merge(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together."""
    if a is None:
        return b
    n = a[0] + b[0]
    some = np.maximum(n, 1.0)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / some
    # where one side has no rows its means say nothing
    mean = [np.where(b[0] == 0, a[k], np.where(a[0] == 0, b[k], a[k] + (b[k] - a[k]) * b[0] / some)) for k in (1, 2)]
    return np.stack([n, *mean, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def pair_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, n, mx, my, cxx, cyy, cxy) per pair of positions a < b and input partition with rows of both: one pass, lazy. A task
    holds one Arrow batch and six columns x columns blocks, and emits one row per feature."""
    width = len(features)

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                total = _merge(total, _moments(x))
        if total is None:
            return
        for i in range(width - 1):
            js = [j for j in range(i + 1, width) if total[0, i, j] > 0]
            cols = [pa.array([[int(v) for v in total[0, i, js]]], pa.list_(pa.int64())), *(pa.array([total[k, i, js].tolist()], pa.list_(pa.float64())) for k in range(1, 6))]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([js], pa.list_(pa.int32())), *cols], [f.split()[0] for f in PAIR_SCHEMA.split(", ")])

    values = df.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    parts = values.mapInArrow(run, PAIR_SCHEMA)
    return parts.select("a", F.inline(F.arrays_zip("b", "n", "mx", "my", "cxx", "cyy", "cxy")))


def pairwise_correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, n, r) for every pair of ``features`` in their order, over the rows that have both (null, NaN and
    infinite values count as missing); r is null where a column is constant on those rows or there are under two.

    The partitions' moments meet per pair, around the pair's overall means (a window and an aggregate on the same key: one
    shuffle of partitions x pairs rows), so means up to 1e10 times the spread leave six digits of r right."""
    pair = Window.partitionBy("a", "b")
    n = F.sum("n").over(pair)
    m = pair_moments(df, features).select("*", (F.sum(F.col("n") * F.col("mx")).over(pair) / n).alias("gx"),
                                          (F.sum(F.col("n") * F.col("my")).over(pair) / n).alias("gy"))
    dx, dy = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")
    t = m.groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.max(F.abs("gx")).alias("gx"), F.max(F.abs("gy")).alias("gy"),
        F.sum(F.col("cxx") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("cyy") + F.col("n") * dy * dy).alias("yy"),
        F.sum(F.col("cxy") + F.col("n") * dx * dy).alias("xy"))

    def spread(c: str, g: str) -> Column:
        return (F.col("n") >= 2) & (F.col(c) > F.col("n") * F.pow(F.lit(FLAT) * F.col(g), 2))

    r = F.when(spread("xx", "gx") & spread("yy", "gy"), F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))
    names = F.array(*map(F.lit, features))
    return t.select(names[F.col("a")].alias("feature_a"), names[F.col("b")].alias("feature_b"), "n", r.alias("r"))


def correlated_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.85, top: int = 10) -> DataFrame:
    """AG16: upper-triangle pairs with |r| > threshold, |r| descending, top; pairwise-complete like pandas. Lazy, one pass over the rows."""
    r = pairwise_correlation(df, features).filter(F.abs("r") > threshold)
    return r.select("feature_a", "feature_b", F.round(F.abs("r"), R_DP).alias("abs_r")).orderBy(F.desc("abs_r"), "feature_a", "feature_b").limit(top)
