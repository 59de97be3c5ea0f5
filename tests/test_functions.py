import math

import pytest
from pyspark.sql import functions as F

from churnlake.functions.binning import cut, qcut, quantile_cut
from churnlake.functions.scalar import banding, clip_lower, safe_div, soften, strip_ws
from churnlake.operators.features import RECENCY_EDGES, RECENCY_LABELS


def test_cut_right_closed_edges_null_and_parity(spark):
    df = spark.createDataFrame([(v,) for v in [None, 0, 1, 14, 15, 30, 90, 91, 10_000]], "d int")
    out = df.select("d", cut("d", RECENCY_EDGES, RECENCY_LABELS).alias("b"),
                    cut("d", RECENCY_EDGES, RECENCY_LABELS, parity_nan=True).alias("p")).collect()
    got = {r["d"]: (r["b"], r["p"]) for r in out}
    assert got[None] == (None, "nan")
    assert got[0] == (None, "nan")          # 0 is outside (0, 14]
    assert got[1][0] == "Very Recent" and got[14][0] == "Very Recent"
    assert got[15][0] == "Recent" and got[30][0] == "Recent"
    assert got[90][0] == "Distant" and got[91][0] == "Very Distant" and got[10_000][0] == "Very Distant"


def test_cut_left_closed(spark):
    df = spark.createDataFrame([(v,) for v in [0, 5, 6, 998, 999]], "t int")
    r = {x["t"]: x["b"] for x in df.select("t", cut("t", [0, 6, 999], ["a", "b"], right=False).alias("b")).collect()}
    assert r == {0: "a", 5: "a", 6: "b", 998: "b", 999: None}


def test_quantile_cut_matches_pandas(spark):
    import pandas as pd
    vals = [-59, -10, 0, 3, 3, 7, 20, 44, 60, 100, 100, 5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, nps int")
    out = {r["i"]: r["c"] for r in quantile_cut(df, "nps", [0.33, 0.66], ["D", "P", "Pr"], "c").collect()}
    s = pd.Series(vals)
    exp = pd.cut(s, [-math.inf, s.quantile(0.33), s.quantile(0.66), math.inf], labels=["D", "P", "Pr"]).astype(str)
    assert [out[i] for i in range(len(vals))] == list(exp)


def test_qcut_matches_pandas_and_raises_on_duplicate_edges(spark):
    import pandas as pd
    vals = list(range(1, 21)) + [7, 7, 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, e int")
    labels = ["VL", "L", "M", "H", "VH"]
    out = {r["i"]: r["b"] for r in qcut(df, "e", 5, labels, "b").collect()}
    exp = pd.qcut(pd.Series(vals), q=5, labels=labels, duplicates="drop").astype(str)
    assert [out[i] for i in range(len(vals))] == list(exp)
    const = spark.createDataFrame([(i, 4) for i in range(10)], "i int, e int")
    with pytest.raises(Exception):
        qcut(const, "e", 5, labels, "b").collect()
    merged = qcut(const, "e", 5, labels, "b", on_duplicate="merge").collect()
    assert {r["b"] for r in merged} == {"VL"}


def test_clip_lower_keeps_null_and_safe_div(spark):
    df = spark.createDataFrame([(None, 0), (0, 0), (5, 2)], "t int, d int")
    r = df.select(clip_lower("t", 1).alias("c"), safe_div(F.col("t"), F.col("d")).alias("q")).collect()
    assert [x["c"] for x in r] == [None, 1, 5]
    assert [x["q"] for x in r] == [None, None, 2.5]


def test_strip_ws_unicode(spark):
    df = spark.createDataFrame([(" \tMale\n ",), (" Female ",), ("Other",)], "s string")
    assert [r[0] for r in df.select(strip_ws("s")).collect()] == ["Male", "Female", "Other"]


def test_soften_and_banding(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.9869,)], "p double")
    r = [x[0] for x in df.select(soften("p")).collect()]

    def ref(p):
        p = max(min(p, 0.999), 0.001)
        return 100 / (1 + math.exp(-math.log(p / (1 - p)) / 2.5))
    for a, b in zip(r, [ref(0.0), ref(1.0), ref(0.5), ref(0.9869)]):
        assert abs(a - b) < 1e-9
    s = spark.createDataFrame([(70.0,), (70.1,), (35.0,), (35.5,)], "x double")
    assert [x[0] for x in s.select(banding("x", [(70, "A"), (35, "M")], "H")).collect()] == ["M", "A", "H", "M"]


def test_tune_for_scale_sizes_partitions(spark):
    from churnlake.session import input_bytes, tune_for_scale
    n = input_bytes(spark, ["/root/testdata/sf0.1/lineitem.parquet", "/root/testdata/sf0.1/missing.parquet"])
    assert n > 1_000_000
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        done = tune_for_scale(spark, 100 * (1 << 40))  # 100 TB
        assert done["spark.sql.shuffle.partitions"] == "200000"          # 409,601 wanted, capped
        assert tune_for_scale(spark, 10 * (1 << 30)) == {}                # now an explicit choice: kept
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(256 << 20)
        spark.conf.set("spark.sql.shuffle.partitions", "77")   # explicit user choice is kept
        assert "spark.sql.shuffle.partitions" not in tune_for_scale(spark, 1 << 40)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
