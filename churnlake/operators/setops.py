"""Set operations (SO1-SO5) and the unseen-category anti join (J3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.customers import ID_COL


def id_overlap(a: DataFrame, b: DataFrame, key: str = ID_COL) -> DataFrame:
    """SO1: number of distinct ids present in both tables."""
    shared = a.select(key).intersect(b.select(key))
    return shared.agg(F.count(F.lit(1)).alias("overlapping_ids"))


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").filter(F.col("value").isNotNull())


def unseen_categories(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """J3 / SO2: (column, value) pairs that occur in test but not in train;
    both sides are unpivoted and deduplicated, then one left-anti join."""
    tr = _long(train, cols).distinct()
    te = _long(test, cols).distinct()
    return te.join(tr, ["column", "value"], "left_anti")


def schema_alignment(train_cols: Sequence[str], test_cols: Sequence[str], spark) -> DataFrame:
    """SO3: columns missing from test (to add as 0) and extra in test (to
    drop). Pure metadata: computed from the two column lists."""
    tr, te = list(train_cols), list(test_cols)
    rows = [(c, "missing_in_test") for c in tr if c not in set(te)]
    rows += [(c, "extra_in_test") for c in te if c not in set(tr)]
    return spark.createDataFrame(rows, "column string, status string")


def population_total(*frames: DataFrame) -> DataFrame:
    """SO4: row count across several tables with the same key column."""
    u = None
    for f in frames:
        f1 = f.select(ID_COL)
        u = f1 if u is None else u.unionByName(f1)
    return u.agg(F.count(F.lit(1)).alias("total_customers"))


def union_rows(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """SO5: original plus synthetic rows (by name)."""
    return original.unionByName(synthetic, allowMissingColumns=False)
