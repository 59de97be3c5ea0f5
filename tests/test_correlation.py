"""Pairwise-complete correlation against pandas."""

import math

import numpy as np
import pandas as pd
import pytest

from churnlake.operators import correlation as cor


def check(spark, data: pd.DataFrame, parts: int, dp: float = 1e-9):
    cols = list(data.columns)
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(parts)
    got = {(r.feature_a, r.feature_b): (r.n, r.r) for r in cor.pairwise_correlation(df, cols).collect()}
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            both = data[[a, b]].dropna()
            if both.empty:
                assert (a, b) not in got
                continue
            n, r = got[a, b]
            assert n == len(both)
            flat = len(both) < 2 or both[a].nunique() < 2 or both[b].nunique() < 2
            if flat:
                assert r is None, (a, b, r)
            else:
                x, y = both[a] - both[a].mean(), both[b] - both[b].mean()
                want = (x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum())
                assert abs(r - want) < dp, (a, b, r, want)
    return df


@pytest.mark.parametrize("parts", [1, 7])
def test_61_nullable_columns(spark, parts):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 6))
    x = base @ rng.normal(size=(6, 61)) + 0.3 * rng.normal(size=(600, 61))
    x[rng.random(x.shape) < rng.uniform(0, 0.6, size=61)] = np.nan
    data = pd.DataFrame(x, columns=[f"f{i}" for i in range(61)])
    df = check(spark, data, parts)
    got = [tuple(r) for r in cor.correlated_pairs(df, list(data.columns), 0.6, 12).collect()]
    r = data.corr().abs().to_numpy()
    want = sorted(((-round(r[i, j], 6), f"f{i}", f"f{j}") for i in range(61) for j in range(i + 1, 61) if r[i, j] > 0.6))[:12]
    assert got == [(a, b, -v) for v, a, b in want]


def test_odd_columns(spark):
    n = 500
    i = np.arange(n)
    data = pd.DataFrame({
        "offset": 1e9 + i % 7, "far": 1e10 + (i * 3) % 11, "constant": np.full(n, 0.1), "flat_where_b": np.where(i < 250, 0.3, i), "b": np.where(i < 250, i % 13, np.nan),
        "never": np.full(n, np.nan), "once": np.where(i == 3, 1.0, np.nan), "small": (i % 5) * 1e-9, "`odd name": i * 1.0})
    data = data.rename(columns={"`odd name": "odd name"})
    check(spark, data, 9, 1e-6)


def test_lazy_one_pass_and_empty(spark):
    spark.range(400).selectExpr("id a", "cast(id * 2 as double) b", "if(id % 3 = 0, null, id) c", "if(id = 7, double('inf'), id) d").createOrReplaceTempView("cor_in")
    sc = spark.sparkContext
    sc.setJobGroup("cor-build", "build")
    try:
        df = cor.correlated_pairs(spark.table("cor_in"), ["a", "b", "c", "d"])
        assert list(sc.statusTracker().getJobIdsForGroup("cor-build")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [(r.feature_a, r.feature_b, r.abs_r) for r in df.collect()] == [(a, b, 1.0) for a, b in ("ab", "ac", "ad", "bc", "bd", "cd")]
    assert df._jdf.queryExecution().executedPlan().toString().count("Range (0, 400") >= 1
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 400") == 1
    assert cor.correlated_pairs(spark.table("cor_in").limit(0), ["a", "b"]).collect() == []
