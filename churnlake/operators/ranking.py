"""Window ranking (W1, W2) and sorts / top-k / paging (S1-S6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def average_rank(df: DataFrame, value: str, out: str, ascending: bool = False) -> DataFrame:
    """W1: pandas ``rank(method='average')``: ties share the mean of their
    positions; NULL values get a NULL rank.

    rank() gives the first position of a tie group; adding (size - 1) / 2
    gives the mean position. The ordering window has no partition key, so it
    is meant for per-feature / per-model tables (bounded by the feature
    count), not for row-level data.
    """
    v = F.col(value)
    order = v.asc_nulls_last() if ascending else v.desc_nulls_last()
    w = Window.orderBy(order)
    tie = Window.partitionBy(v)
    r = F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0
    return df.withColumn(out, F.when(v.isNull(), F.lit(None)).otherwise(r.cast("double")))


def top_n(df: DataFrame, order: Sequence[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """W2 + S4: the first ``n`` rows by ``order`` with a 1-based enumerated
    rank; Spark plans orderBy+limit as TakeOrderedAndProject (each partition
    keeps only its own top n)."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def _sorted(df: DataFrame, keys: Sequence[Column], position: str | None) -> DataFrame:
    """``df`` in order; with ``position`` a column of 1-based places.

    The places come without a one-partition window: the range-partitioned
    sort is cut into the checkpoint folder, the sizes of its partitions (one
    number per partition reaches the driver) give each partition's offset."""
    out = df.orderBy(*keys)
    if position is None:
        return out
    ensure_checkpoint_dir(df.sparkSession)
    out = out.checkpoint(eager=True)
    part = F.spark_partition_id()
    sizes = {r["p"]: r["n"] for r in out.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, before = [F.lit(-1), F.lit(0).cast("long")], 0
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(before).cast("long")]
        before += sizes[p]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(position, F.create_map(*offsets)[part] + inside + 1)


def sort_desc(df: DataFrame, col: str, tie_breaker: str | None = None, position: str | None = None) -> DataFrame:
    """S1: descending sort with a deterministic tie-breaker (global range-
    partitioned sort)."""
    keys = [F.col(col).desc()] + ([F.col(tie_breaker).asc()] if tie_breaker else [])
    return _sorted(df, keys, position)


def sort_abs(df: DataFrame, col: str, tie_breaker: str | None = None, position: str | None = None) -> DataFrame:
    """S2: sort by |col| descending."""
    keys = [F.abs(F.col(col)).desc()] + ([F.col(tie_breaker).asc()] if tie_breaker else [])
    return _sorted(df, keys, position)


def sort_custom(df: DataFrame, col: str, order: Sequence[str], position: str | None = None) -> DataFrame:
    """S3: sort by a custom label order (unknown labels last)."""
    pos = F.array_position(F.array(*map(F.lit, order)), F.col(col))
    return _sorted(df, [F.when(pos == 0, F.lit(len(order) + 1)).otherwise(pos), F.col(col)], position)


def arg_max(df: DataFrame, key: str, metric: str) -> DataFrame:
    """S5: the key with the highest metric (ties: smallest key); a top-1
    TakeOrderedAndProject, no global sort."""
    return df.orderBy(F.col(metric).desc(), F.col(key).asc()).limit(1).select(key, metric)


def keyset_page(df: DataFrame, score: str, key: str, after: tuple | None = None, size: int = 15) -> DataFrame:
    """S6: next page of ``size`` rows in (score desc, key asc) order after
    the last row ``after = (score, key)`` of the previous page. A predicate
    plus TakeOrderedAndProject: no offset scan, no global sort."""
    out = df
    if after is not None:
        s, k = after
        out = out.filter((F.col(score) < F.lit(s)) | ((F.col(score) == F.lit(s)) & (F.col(key) > F.lit(k))))
    return out.orderBy(F.col(score).desc(), F.col(key).asc()).limit(size)
