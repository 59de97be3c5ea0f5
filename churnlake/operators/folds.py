"""Stratified folds (ML2) and holdout split (ML12) by hashing the id.

Hash mode: fold = (first 32 bits of md5(id ':' seed)) mod k. Stable under
re-execution (no RNG state, no dependence on partitioning), so a lost
executor recomputes exactly the same assignment.

Exact mode: classes are balanced to within one row per fold, as a
stratified splitter does: rows are ranked inside their class by the hash,
and the rank mod k is the fold. The rank is computed without a one-partition
window: rows go to 2^B hash buckets per class (uniform by construction, so
no bucket is hot even when one class holds most rows), bucket sizes get a
prefix sum over the small (class, bucket) table, and row_number runs per
(class, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.customers import ID_COL, TARGET_COL

RANK_BUCKET_BITS = 10


def id_hash32(key: str = ID_COL, seed: int = 42) -> Column:
    """32-bit unsigned hash of the id (as a long): md5 prefix, so DuckDB and
    Spark agree (T8)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def class_rank(df: DataFrame, key: str = ID_COL, label: str = TARGET_COL, seed: int = 42,
               out: str = "_class_rank", bits: int = RANK_BUCKET_BITS) -> DataFrame:
    """0-based rank of each row inside its class, ordered by (hash, id).

    ``bits``: a class is ranked in 2^bits buckets; raise it with the rows (a
    bucket holds rows / 2^bits; the bucket table stays small up to 2^20)."""
    h = id_hash32(key, seed)
    x = df.withColumn("_h", h).withColumn("_bk", F.shiftright(F.col("_h"), 32 - bits))
    sizes = x.groupBy(label, "_bk").agg(F.count(F.lit(1)).alias("_sz"))
    wo = Window.partitionBy(label).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_sz").over(wo), F.lit(0))).drop("_sz")
    wr = Window.partitionBy(label, "_bk").orderBy("_h", key)
    # (classes x 2^B) rows: bounded by construction, safe to broadcast
    x = x.join(F.broadcast(sizes), [label, "_bk"])
    return x.withColumn(out, F.col("_off") + F.row_number().over(wr) - 1).drop("_h", "_bk", "_off")


def stratified_folds(df: DataFrame, k: int = 5, key: str = ID_COL, label: str = TARGET_COL, seed: int = 42,
                     exact: bool = False, out: str = "fold") -> DataFrame:
    """ML2: fold id in [0, k)."""
    if not exact:
        return df.withColumn(out, (id_hash32(key, seed) % k).cast("int"))
    return class_rank(df, key, label, seed).withColumn(out, (F.col("_class_rank") % k).cast("int")).drop("_class_rank")


def holdout_split(df: DataFrame, test_size: float = 0.2, key: str = ID_COL, label: str = TARGET_COL,
                  seed: int = 42, exact: bool = False, out: str = "is_holdout") -> DataFrame:
    """ML12: stratified holdout flag. Hash mode: hash below the threshold.
    Exact mode: the first round(test_size * n_class) rows of each class in
    hash order."""
    if not exact:
        thr = int(round(test_size * (1 << 32)))
        return df.withColumn(out, id_hash32(key, seed) < F.lit(thr))
    ranked = class_rank(df, key, label, seed)
    n = ranked.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    return (ranked.join(n, label)
            .withColumn(out, F.col("_class_rank") < F.bround(F.col("_nc") * test_size, 0))
            .drop("_class_rank", "_nc"))
