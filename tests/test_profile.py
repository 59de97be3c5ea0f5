import pytest
from pyspark.sql import functions as F

from churnlake.operators import correlation as cor
from churnlake.operators import profile as pr


@pytest.fixture()
def small(spark):
    rows = [("a", 1, 1.0, "x", 0), ("a", 1, 1.0, "x", 0), ("b", None, float("nan"), "y", 1),
            ("c", 3, 2.0, "y", 1), ("d", 100, 2.5, None, 0)]
    return spark.createDataFrame(rows, "customer_id string, n int, v double, s string, churned int")


def test_duplicates_and_missing(small):
    assert small.transform(pr.duplicate_rows).head()[0] == 1
    assert small.transform(pr.duplicate_ids).head()[0] == 1
    mv = {r["column"]: r["missing"] for r in pr.missing_values(small).collect()}
    assert mv == {"customer_id": 0, "n": 1, "v": 1, "s": 1, "churned": 0}


def test_column_profile_exact_and_approx(small):
    exact = {r["column"]: (r["dtype"], r["n_unique"]) for r in pr.column_profile(small).collect()}
    assert exact["customer_id"] == ("string", 4) and exact["n"] == ("int", 3) and exact["s"] == ("string", 2)
    approx = {r["column"]: r["n_unique"] for r in pr.column_profile(small, approx=True).collect()}
    assert approx["customer_id"] == 4


def test_iqr_strict_bounds(spark):
    import pandas as pd
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 9, 100, -50]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    r = pr.iqr_outliers(df, ["x"]).head()
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert r["count"] == int(((s < lo) | (s > hi)).sum()) and abs(r["lower"] - lo) < 1e-9


def test_leakage_and_scan(spark):
    df = spark.createDataFrame([("A", "p", 1), ("A", "q", 1), ("B", "p", 0), ("B", "q", 1)], "act string, g string, churned int")
    lk = {r["category"]: r["is_pure"] for r in pr.leakage_by_category(df, "act").collect()}
    assert lk == {"A": True, "B": False}
    sc = {r["column"]: r["leaks"] for r in pr.leakage_scan(df, ["act", "g"]).collect()}
    assert sc == {"act": False, "g": False}
    df2 = spark.createDataFrame([("A", 1), ("B", 0)], "act string, churned int")
    assert pr.leakage_scan(df2, ["act"]).head()["leaks"] is True


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, churned int")
    assert cor.target_correlation(df, "x").head()["r"] is None


def test_pairwise_complete_correlation(spark):
    import pandas as pd
    rows = [(1.0, 2.0, 0), (2.0, None, 1), (3.0, 7.0, 1), (4.0, 8.0, 0), (5.0, 11.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, churned int")
    pdf = pd.DataFrame(rows, columns=["a", "b", "churned"])
    r = df.agg(cor.pearson(F.col("a"), F.col("b"))).head()[0]
    assert abs(r - pdf["a"].corr(pdf["b"])) < 1e-12


def test_empty_table_shape(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert tuple(pr.shape(df).head()) == (0, 2)


def test_leakage_scan_flags_the_action_column_on_real_data(spark):
    import __spark_entry__ as E
    got = {r["column"]: r["leaks"] for r in E.queries()["ag12_leakage_scan"](spark, "/root/testdata/sf0.001").collect()}
    assert got["recommended_action"] is True
    assert not any(v for k, v in got.items() if k != "recommended_action")


def test_column_profile_nan_and_negative_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (1.5,), (None,)], "v double")
    assert {r["column"]: r["n_unique"] for r in pr.column_profile(df).collect()} == {"v": 2}
