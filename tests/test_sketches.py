"""Mergeable distinct-count sketches: merged loads against the whole table and against exact counts."""

import tempfile

import pytest
from pyspark.sql import functions as F

from churnlake.operators import profile as pr
from churnlake.operators import sketches as sk


def loads(spark, n, k):
    """k loads of n rows that share values, with missing and NaN values."""
    return [spark.range(i * n // 2, i * n // 2 + n).select(
        F.when(F.col("id") % 97 != 0, F.concat(F.lit("CUST"), F.col("id").cast("string"))).alias("customer_id"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("id") % 1000) / 8.0).alias("x"),
        (F.col("id") % 3).cast("int").alias("kind"), F.lit(None).cast("string").alias("never")) for i in range(k)]


@pytest.fixture(scope="module")
def kept(spark):
    path = tempfile.mkdtemp(prefix="churnlake-sk-")
    parts = loads(spark, 40_000, 4)
    for i, df in enumerate(parts):
        sk.add_load(df, path, f"day{i}")
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return path, parts, whole


def test_merged_equals_whole_within_the_error(spark, kept):
    path, _, whole = kept
    exact = {r["column"]: r["n_unique"] for r in pr.column_profile(whole).collect()}
    assert exact["customer_id"] > 90_000
    nulls = {r["column"]: r["missing"] for r in pr.missing_values(whole).collect()}
    got = {r["column"]: r for r in sk.merged_profile(sk.stored(spark, path)).collect()}
    assert set(got) == set(exact)
    for c, r in got.items():
        assert abs(r["n_unique"] - exact[c]) <= sk.ERROR * exact[c], (c, r)
        assert r["missing"] == nulls[c] and r["rows"] == 160_000
    # merged sketches are the sketch of the whole, up to the estimator
    one = {r["column"]: r["e"] for r in sk.load_sketches(whole).select("column", F.hll_sketch_estimate("sketch").alias("e")).collect()}
    assert all(abs(got[c]["n_unique"] - e) <= sk.ERROR * max(e, 1) for c, e in one.items())


def test_duplicate_ids(spark, kept):
    path, _, whole = kept
    exact = pr.duplicate_ids(whole).head()[0]
    ids = pr.column_profile(whole.select("customer_id")).head()["n_unique"]
    got = sk.merged_duplicates(sk.stored(spark, path), "customer_id").head()[0]
    assert abs(got - exact) <= sk.ERROR * ids


def test_retried_load_and_late_column(spark):
    path = tempfile.mkdtemp(prefix="churnlake-sk-")
    a, b = loads(spark, 1000, 2)
    sk.add_load(a, path, "a")
    before = sorted(map(tuple, sk.merged_profile(sk.stored(spark, path)).collect()))
    sk.add_load(a, path, "a")
    assert sorted(map(tuple, sk.merged_profile(sk.stored(spark, path)).collect())) == before
    sk.add_load(b.withColumn("extra", F.col("kind")), path, "b")
    got = {r["column"]: r for r in sk.merged_profile(sk.stored(spark, path)).collect()}
    assert (got["extra"]["rows"], got["extra"]["missing"], got["extra"]["n_unique"]) == (2000, 1000, 3)


def test_empty_loads(spark):
    path = tempfile.mkdtemp(prefix="churnlake-sk-")
    sk.add_load(loads(spark, 10, 1)[0].limit(0), path, "none")
    got = sk.merged_profile(sk.stored(spark, path)).collect()
    assert len(got) == 4 and all((r["rows"], r["missing"], r["n_unique"]) == (0, 0, 0) for r in got)
    assert sk.merged_duplicates(sk.stored(spark, path), "customer_id").head()[0] == 0


def test_a_later_profile_reads_sketches_only(spark, kept):
    path, _, _ = kept
    df = sk.merged_profile(sk.stored(spark, path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "sketch" in plan
