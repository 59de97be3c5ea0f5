"""Exact quantiles of large columns by distributed selection.

``percentile`` (exact) merges a value->count map of every distinct value in
one final task: fine for small integer domains, not for billions of distinct
doubles. Here the exact linear-interpolated quantile (pandas ``quantile``,
DuckDB ``quantile_cont``) is found by narrowing, the same way at every size:

1. the column(s) are unpivoted to (column, value) and reduced to distinct
   (column, value, count) rows with map-side partial aggregation (a value
   held by a third of all rows is one row after this step);
2. one job brackets every rank of all columns: values fall into parts of equal
   ratio (``PER_OCTAVE`` per power of two on either side of zero, infinities and
   zero apart), a fixed grid that needs neither least nor greatest value. A running
   count per column picks the parts that hold the wanted ranks. A part of one
   value is the answer; so small domains are settled here;
3. every other wanted rank has a value range. One job per round serves all
   open ranks of all columns: the ranges are a small table joined to the
   distinct values, each range is counted in ``buckets`` equal parts, a
   running count per range picks the part that holds the rank, and its least
   and greatest value are the next range. A range of one value is the answer.

The least value of a range falls in its first part and the greatest in its
last, so every round drops distinct values from every open range: the loop
ends, and stops with an error should a range ever fail to shrink. The driver
sees a few rows per rank and round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, PER_OCTAVE = 4096, 256


SEP = "\x1f"


def _distinct_counts(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    def key(c: str):
        return F.lit(c) if by is None else F.concat(F.lit(c + SEP), F.col(by).cast("string"))
    long = df.select(F.explode(F.array(*[
        F.struct(key(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols])).alias("_kv")
    ).select("_kv.c", "_kv.x").filter(F.col("x").isNotNull() & ~F.isnan(F.col("x")))
    return long.groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles_by(df: DataFrame, col: str, probs: Sequence[float], by: str,
                       **kw) -> dict[str, list[float | None]]:
    """{group value: [quantile at each prob]} of ``col`` per value of ``by``,
    all groups in the same selection rounds (one pass per round). Meant for
    a few groups: the result is a driver-side dictionary."""
    res = exact_quantiles(df, [col], probs, by=by, **kw)
    return {k.split(SEP, 1)[1]: v for k, v in res.items() if SEP in k}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], buckets: int = BUCKETS,
                    by: str | None = None) -> dict[str, list[float | None]]:
    """{column: [quantile at each prob]} (None for a column without values).
    With ``by``, keys are ``column + SEP + group value`` (see
    :func:`exact_quantiles_by`)."""
    d = _distinct_counts(df, cols, by).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total, found, open_ = _bracketed(d, probs)
        found |= _select(d, open_, buckets)
    finally:
        d.unpersist()
    keys = list(cols) if by is None else sorted(total)
    return {c: [_interpolated(c, total[c], p, found) if c in total else None for p in probs] for c in keys}


def _part(x):
    """Number of the part of equal ratio that holds ``x``; never falls as ``x`` grows."""
    size = F.floor((F.log2(F.abs(x)) + 1100) * PER_OCTAVE)
    size = F.when(x == 0, 0).when(F.abs(x) == math.inf, 1 << 40).otherwise(size)
    return F.when(x < 0, -size).otherwise(size)


def _bracketed(d: DataFrame, probs: Sequence[float]) -> tuple[dict, dict, dict]:
    """(rows of each column, ranks found, open ranks with their least and greatest value and the rank between): one job."""
    parts = d.groupBy("c", _part(F.col("x")).alias("part")).agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    column = Window.partitionBy("c")
    parts = parts.withColumn("upto", F.sum("n").over(column.orderBy("part"))).withColumn("all", F.sum("n").over(column))
    wanted = F.lit(False)
    for p in probs:
        r = F.floor((F.col("all") - 1) * F.lit(float(p)))
        for rank in (r, F.least(r + 1, F.col("all") - 1)):
            wanted = wanted | ((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")))
    held: dict[str, list] = {}
    for row in parts.where(wanted).collect():
        held.setdefault(row["c"], []).append(row)
    total = {c: rows[0]["all"] for c, rows in held.items()}
    found, open_ = {}, {}
    for c, n in total.items():
        for r in {r for p in probs for r in _around(n, p)[:2]}:
            row = next(x for x in held[c] if x["upto"] - x["n"] <= r < x["upto"])
            if row["lo"] == row["hi"]:
                found[c, r] = row["lo"]
            else:
                open_[c, r] = (row["lo"], row["hi"], r - (row["upto"] - row["n"]))
    return total, found, open_


def _around(n: int, p: float) -> tuple[int, int, float]:
    """The two 0-based ranks next to a quantile of n rows, and the share of the second."""
    h = (n - 1) * p
    return int(math.floor(h)), min(int(math.floor(h)) + 1, n - 1), h - math.floor(h)


def _interpolated(c: str, n: int, p: float, found: dict[tuple[str, int], float]) -> float:
    r0, r1, share = _around(n, p)
    v0, v1 = found[c, r0], found[c, r1]
    return v0 if share == 0 or v0 == v1 else v0 + (v1 - v0) * share


def _select(d: DataFrame, open_: dict[tuple[str, int], tuple[float, float, int]], buckets: int) -> dict[tuple[str, int], float]:
    """The value at each open (column, rank): least, greatest and rank among the values between."""
    found: dict[tuple[str, int], float] = {}
    while open_:
        for key in [k for k, (lo, hi, _) in open_.items() if lo == hi]:
            found[key] = open_.pop(key)[0]
        if not open_:
            break
        rows = [(c, r, lo, hi, k) for (c, r), (lo, hi, k) in open_.items()]
        ranges = F.broadcast(d.sparkSession.createDataFrame(rows, "c string, r long, lo double, hi double, k long"))
        inside = d.join(ranges, "c").filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        # halves keep a width finite that would overflow; tiny ones would vanish in halves
        part = F.when(F.col("hi") - F.col("lo") == math.inf,
                      (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
                      ).otherwise((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))) * buckets
        parts = inside.groupBy("c", "r", "k", F.least(F.floor(part), F.lit(buckets - 1)).alias("part")).agg(
            F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("c", "r").orderBy("part"))
        held = parts.withColumn("upto", upto).filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
        for row in held.collect():
            key = (row["c"], row["r"])
            lo, hi, k = open_[key]
            if (row["lo"], row["hi"]) == (lo, hi):
                raise RuntimeError(f"quantile selection: the range {lo}..{hi} of {key} does not shrink")
            open_[key] = (row["lo"], row["hi"], k - (row["upto"] - row["n"]))
    return found


def quantile_row(df: DataFrame, col: str, probs: Sequence[float], name: str = "q", **kw) -> DataFrame:
    """One-row DataFrame holding the exact quantiles of ``col`` as an array
    column (the shape the binning operators cross-join)."""
    q = exact_quantiles(df, [col], probs, **kw)[col]
    spark = df.sparkSession
    return spark.createDataFrame([(q,)], f"{name} array<double>")
