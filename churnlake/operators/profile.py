"""Profiling and data-quality operators (AG1-AG12, AG18, AG19, AG27, AG30).

Pattern: one scan, one wide ``agg`` computing every statistic of every
column (partial aggregation on the map side, a one-row shuffle), then an
unpivot of that single row into (column, stat...) rows. Distinct counts use
an unpivot + ``distinct`` instead of N ``countDistinct`` (which would make
Spark expand every input row N times).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, NumericType, StringType

from ..sources.customers import ID_COL, TARGET_COL

STAT_DP = 6  # aggregate doubles are reported at 6 dp (order-independent, T10)


def _r(c: Column, dp: int = STAT_DP) -> Column:
    return F.bround(c.cast("double"), dp)


def dtype_name(dt) -> str:
    return dt.simpleString()


def columns_of_type(df: DataFrame, kinds: Sequence[str]) -> list[str]:
    """PF3: column names by Spark type: 'int', 'double', 'string', 'numeric'."""
    out = []
    for f in df.schema.fields:
        t = f.dataType
        if ("numeric" in kinds and isinstance(t, NumericType)) or \
           ("int" in kinds and isinstance(t, (IntegerType, LongType))) or \
           ("double" in kinds and isinstance(t, (DoubleType, FloatType))) or \
           ("string" in kinds and isinstance(t, StringType)):
            out.append(f.name)
    return out


def unpivot_row(one_row: DataFrame, per_column: dict[str, dict[str, Column]], name: str = "column") -> DataFrame:
    """Turn a one-row table of statistics into one row per column.

    ``per_column`` maps an output row key to {stat name: expression over the
    one-row table}."""
    structs = [F.struct(F.lit(k).alias(name), *[e.alias(s) for s, e in stats.items()])
               for k, stats in per_column.items()]
    return one_row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def shape(df: DataFrame) -> DataFrame:
    """AG1: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def _as_key(df: DataFrame, c: str) -> Column:
    """Value as a comparable string: for floating columns NaN counts as
    missing (pandas ``nunique``) and -0.0 equals 0.0."""
    if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
        x = F.col(c)
        return F.when(F.isnan(x), F.lit(None)).otherwise(x + F.lit(0.0)).cast("string")
    return F.col(c).cast("string")


def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _as_key(df, c).alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value")


def column_profile(df: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """AG2: column, dtype, n_unique (NULL excluded).

    Exact: unpivot to (column, value), deduplicate with map-side partial
    aggregation, count per column. ``approx=True`` uses one HyperLogLog++
    sketch per column in a single aggregate instead (bounded memory)."""
    cols = df.columns
    types = {f.name: dtype_name(f.dataType) for f in df.schema.fields}
    dtypes = F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])
    if approx:
        row = df.agg(*[F.approx_count_distinct(c, rsd).alias(f"_{i}") for i, c in enumerate(cols)])
        return unpivot_row(row, {c: {"n_unique": F.col(f"_{i}")} for i, c in enumerate(cols)}) \
            .select("column", dtypes[F.col("column")].alias("dtype"), "n_unique")
    counts = (_long_values(df, cols).filter(F.col("value").isNotNull()).distinct()
              .groupBy("column").agg(F.count(F.lit(1)).alias("n_unique")))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (names.join(counts, "column", "left")
            .select("column", dtypes[F.col("column")].alias("dtype"),
                    F.coalesce(F.col("n_unique"), F.lit(0)).cast("long").alias("n_unique")))


def target_distribution(df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """AG3: value, count, pct."""
    counts = df.groupBy(F.col(target).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # over the (tiny) grouped result
    return counts.select("value", "count", _r(F.col("count") * 100.0 / total).alias("pct"))


def class_counts(df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """One row: n, n0, n1 (count_if per class in one pass)."""
    t = F.col(target)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(t == 0).alias("n0"), F.count_if(t == 1).alias("n1"))


def imbalance_ratio(df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """AG4: count0 / count1 (NULL without positives)."""
    return class_counts(df, target).select(_r(F.try_divide(F.col("n0").cast("double"), F.col("n1"))).alias("imbalance_ratio"))


def class_distribution(df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """AG27: not_churned, churned, churn_rate (metadata form)."""
    return class_counts(df, target).select(
        F.col("n0").alias("not_churned"), F.col("n1").alias("churned"),
        _r(F.try_divide(F.col("n1").cast("double"), F.col("n"))).alias("churn_rate"))


def _is_missing(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    if isinstance(t, (DoubleType, FloatType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def missing_values(df: DataFrame) -> DataFrame:
    """AG5: column, missing, pct (NaN counts as missing, T6)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(_is_missing(df, c)).alias(f"_{i}") for i, c in enumerate(cols)])
    return unpivot_row(row, {c: {"missing": F.col(f"_{i}"),
                                 "pct": _r(F.try_divide(F.col(f"_{i}") * 100.0, F.col("_n")))}
                             for i, c in enumerate(cols)})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """AG6: rows minus distinct rows (NULLs compare equal), one plan."""
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    distinct = df.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    return total.crossJoin(distinct).select((F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def duplicate_ids(df: DataFrame, key: str = ID_COL) -> DataFrame:
    """AG7: number of rows whose id was already seen."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
            .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicate_ids")))


def negative_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG8: column, negatives, min_value."""
    row = df.agg(*[F.count_if(F.col(c) < 0).alias(f"_n{i}") for i, c in enumerate(cols)],
                 *[F.min(F.col(c)).cast("double").alias(f"_m{i}") for i, c in enumerate(cols)])
    return unpivot_row(row, {c: {"negatives": F.col(f"_n{i}"), "min_value": F.col(f"_m{i}")}
                             for i, c in enumerate(cols)})


def range_check(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """AG9: column, out_of_range (strictly outside [lo, hi]), min, max."""
    items = list(bounds.items())
    row = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"_o{i}") for i, (c, (lo, hi)) in enumerate(items)],
                 *[F.min(F.col(c)).cast("double").alias(f"_a{i}") for i, (c, _) in enumerate(items)],
                 *[F.max(F.col(c)).cast("double").alias(f"_b{i}") for i, (c, _) in enumerate(items)])
    return unpivot_row(row, {c: {"out_of_range": F.col(f"_o{i}"), "min_value": F.col(f"_a{i}"),
                                 "max_value": F.col(f"_b{i}")} for i, (c, _) in enumerate(items)})


def int_ranges(df: DataFrame, exclude: Sequence[str] = (TARGET_COL,)) -> DataFrame:
    """AG10: column, min, max, compact (fits 0..255) for integer columns."""
    cols = [c for c in columns_of_type(df, ["int"]) if c not in set(exclude)]
    row = df.agg(*[F.min(c).alias(f"_a{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"_b{i}") for i, c in enumerate(cols)])
    return unpivot_row(row, {c: {"min_value": F.col(f"_a{i}").cast("long"), "max_value": F.col(f"_b{i}").cast("long"),
                                 "compact": (F.col(f"_a{i}") >= 0) & (F.col(f"_b{i}") <= 255)}
                             for i, c in enumerate(cols)})


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """AG11: column, count, pct, lower, upper for columns with outliers.

    Quartiles are exact linear-interpolated (equal to pandas ``quantile``),
    found for all columns together by distributed selection (bounded driver
    traffic, no task holding every distinct value); the bounds then enter the
    counting pass as literals, one aggregate for all columns. Bounds are
    strict."""
    from ..functions.quantiles import exact_quantiles
    q = exact_quantiles(df, cols, [0.25, 0.75])
    bounds = {}
    for c in cols:
        q1, q3 = q[c]
        if q1 is None:
            continue
        bounds[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    items = list(bounds.items())
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))).alias(f"_c{i}")
                   for i, (c, (lo, hi)) in enumerate(items)])
    out = unpivot_row(row, {c: {"count": F.col(f"_c{i}"),
                                "pct": _r(F.try_divide(F.col(f"_c{i}") * 100.0, F.col("_n"))),
                                "lower": _r(F.lit(lo)), "upper": _r(F.lit(hi))}
                            for i, (c, (lo, hi)) in enumerate(items)})
    return out.filter(F.col("count") > 0)


def leakage_by_category(df: DataFrame, col: str, target: str = TARGET_COL) -> DataFrame:
    """AG12: category, churn_rate, is_pure (rate exactly 0 or 1)."""
    g = (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("category"))
         .agg(F.avg(F.col(target).cast("double")).alias("_rate")))
    return g.select("category", _r(F.col("_rate")).alias("churn_rate"),
                    F.col("_rate").isin(0.0, 1.0).alias("is_pure"))


def leakage_scan(df: DataFrame, cols: Sequence[str], target: str = TARGET_COL) -> DataFrame:
    """AG12 (general form): column, n_categories, leaks (every category pure).

    One pass: unpivot string columns to (column, value), average the target
    per pair with partial aggregation, then reduce per column."""
    long = df.select(F.col(target).cast("double").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("kv")
    ).select("kv.column", "kv.value", "_y").filter(F.col("value").isNotNull())
    per = long.groupBy("column", "value").agg(F.avg("_y").alias("_rate"))
    return per.groupBy("column").agg(F.count(F.lit(1)).alias("n_categories"),
                                     F.bool_and(F.col("_rate").isin(0.0, 1.0)).alias("leaks"))


def feature_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """AG18: feature, kind, n_categories (categorical) or mean (numeric)."""
    kinds = {f.name: ("categorical" if isinstance(f.dataType, StringType) else "numeric") for f in df.schema.fields}
    cat = [f for f in features if kinds[f] == "categorical"]
    num = [f for f in features if kinds[f] == "numeric"]
    row = df.agg(F.lit(0).alias("_z"), *[F.avg(F.col(f).cast("double")).alias(f"_m{i}") for i, f in enumerate(num)])
    means = unpivot_row(row, {f: {"kind": F.lit("numeric"), "n_categories": F.lit(None).cast("long"),
                                  "mean": _r(F.col(f"_m{i}"))} for i, f in enumerate(num)}, "feature") if num else None
    if cat:
        ncat = (_long_values(df, cat).filter(F.col("value").isNotNull()).distinct()
                .groupBy(F.col("column").alias("feature")).agg(F.count(F.lit(1)).alias("n_categories"))
                .select("feature", F.lit("categorical").alias("kind"), "n_categories",
                        F.lit(None).cast("double").alias("mean")))
        return ncat if means is None else means.unionByName(ncat)
    return means


def data_dictionary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """AG19: feature, dtype, min, max, mean, std (sample, ddof=1).

    Long form: (feature, value) pairs are aggregated per feature (partial
    aggregation; the shuffle holds partitions x features rows), which keeps
    the plan small for wide encoded tables."""
    types = {f.name: dtype_name(f.dataType) for f in df.schema.fields}
    dtypes = F.create_map(*[F.lit(x) for f in features for x in (f, types[f])])
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_x")) for f in features])).alias("_kv")
    ).select("_kv.feature", "_kv._x")
    x = F.col("_x")
    g = long.groupBy("feature").agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("_m"),
                                    F.stddev_samp(x).alias("_s"))
    return g.select("feature", dtypes[F.col("feature")].alias("dtype"), "min", "max", _r(F.col("_m")).alias("mean"),
                    _r(F.col("_s")).alias("std"))


def distinct_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG30: sorted distinct non-NULL values of each column, as (column,
    value): one pass, deduplicated with map-side partial aggregation."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_kv"))
    out = long.select("_kv.column", "_kv.value").filter(F.col("value").isNotNull()).distinct()
    return out.orderBy("column", "value")
