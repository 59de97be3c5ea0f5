import time

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from churnlake.functions.quantiles import exact_quantiles


def test_exact_quantiles_match_pandas_with_narrowing(spark):
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.exponential(size=500) * 1e-9])
    b = rng.integers(-100, 100, size=a.size).astype(float)
    b[::7] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.33, 0.5, 0.66, 0.75, 0.999, 1.0]
    # few buckets force several narrowing rounds
    got = exact_quantiles(df, ["a", "b"], probs, buckets=8)
    for c in ("a", "b"):
        want = [float(pdf[c].quantile(p)) for p in probs]
        assert np.allclose(got[c], want, rtol=0, atol=1e-12), (c, got[c], want)


def test_exact_quantiles_empty_and_constant(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 3.0)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.25, 0.5])
    assert got["a"] == [None, None] and got["b"] == [3.0, 3.0]


def test_exact_quantiles_by_group(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"x": rng.integers(-100, 100, size=2000).astype(float),
                        "g": np.where(rng.random(2000) < 0.3, "a", "b")})
    from churnlake.functions.quantiles import exact_quantiles_by
    got = exact_quantiles_by(spark.createDataFrame(pdf), "x", [0.33, 0.66], "g", buckets=4)
    for g in ("a", "b"):
        want = [float(pdf[pdf.g == g].x.quantile(p)) for p in (0.33, 0.66)]
        assert np.allclose(got[g], want, atol=1e-12)


def test_exact_quantiles_wide_default_parameters(spark):
    """200,000 distinct values in each of 20 columns, infinities among them, default parameters."""
    n, cols = 200_000, [f"c{i}" for i in range(20)]
    df = spark.range(n).select(*[F.when(F.col("id") % 50_000 == i, F.lit(float("inf") if i % 2 else float("-inf"))).otherwise(
        F.pmod(F.col("id") * (2 * i + 7_919), F.lit(n)) * (10.0 ** (i - 9)) - i).alias(c) for i, c in enumerate(cols)]).cache()
    df.count()
    t = time.time()
    got = exact_quantiles(df, cols, [0.0, 0.25, 0.75, 1.0])
    took = time.time() - t
    pdf = df.toPandas()
    for c in cols:
        x = np.sort(pdf[c].to_numpy())
        for p, v in zip([0.0, 0.25, 0.75, 1.0], got[c]):
            h = (n - 1) * p
            a, b = x[int(h)], x[min(int(h) + 1, n - 1)]
            assert v == (a if a == b or h == int(h) else a + (b - a) * (h - int(h))), (c, p)
    assert took < 60


def test_exact_quantiles_extreme_ranges(spark):
    x = [-1.7e308, -1.0, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.7e308, float("inf")]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in x], "x double"), ["x"], [i / 8 for i in range(9)], buckets=4)
    assert got["x"] == x
