import random

from pyspark.sql import functions as F

from churnlake.operators import folds as fo
from churnlake.operators import metrics as me


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_roc_auc_matches_brute_force_with_ties(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(400)] + [(1, 1.0), (0, 0.0), (1, -0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = me.roc_auc(df, "label", "score").head()["roc_auc"]
    assert abs(got - round(_brute_auc(rows), 6)) < 1e-9


def test_roc_auc_grouped(spark):
    rows = [(g, y, s) for g in (0, 1) for y, s in [(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4 + g * 0.2)]]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    got = {r["g"]: r["roc_auc"] for r in me.roc_auc(df, "label", "score", ["g"]).collect()}
    for g in (0, 1):
        assert abs(got[g] - _brute_auc([(y, s) for gg, y, s in rows if gg == g])) < 1e-9


def test_classification_report_and_zero_division(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "label int, prediction int")
    rep = {r["class"]: r for r in me.classification_report(df).collect()}
    assert abs(rep["1"]["precision"] - 0.6) < 1e-9 and abs(rep["1"]["recall"] - 0.75) < 1e-9
    assert abs(rep["0"]["precision"] - 0.8) < 1e-9 and rep["0"]["support"] == 6
    assert abs(rep["accuracy"]["f1"] - 0.7) < 1e-9
    none_pos = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    m = me.binary_metrics(none_pos).head()
    assert m["precision"] == 0.0 and m["f1"] == 0.0


def test_exact_folds_are_class_balanced(spark):
    rows = [(f"C{i}", 1 if i % 7 < 2 else 0) for i in range(1003)]
    df = spark.createDataFrame(rows, "customer_id string, churned int")
    out = fo.stratified_folds(df, 5, exact=True)
    counts = out.groupBy("churned", "fold").count().collect()
    for c in (0, 1):
        sizes = [r["count"] for r in counts if r["churned"] == c]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert out.count() == 1003 and out.select("customer_id").distinct().count() == 1003


def test_exact_holdout_share(spark):
    rows = [(f"C{i}", 1 if i % 4 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "customer_id string, churned int")
    h = fo.holdout_split(df, 0.2, exact=True).filter("is_holdout").groupBy("churned").count().collect()
    assert {r["churned"]: r["count"] for r in h} == {0: 150, 1: 50}


def test_hash_folds_are_stable(spark):
    df = spark.createDataFrame([(f"C{i}", i % 2) for i in range(200)], "customer_id string, churned int")
    a = {r["customer_id"]: r["fold"] for r in fo.stratified_folds(df, 5).collect()}
    b = {r["customer_id"]: r["fold"] for r in fo.stratified_folds(df.repartition(7), 5).collect()}
    assert a == b and set(a.values()) == {0, 1, 2, 3, 4}


def test_soft_vote_within_members(spark):
    df = spark.createDataFrame([(0.1, 0.5, 0.9), (0.7, 0.8, 0.2)], "a double, b double, c double")
    for r in me.soft_vote(df, ["a", "b", "c"]).collect():
        assert min(r["a"], r["b"], r["c"]) <= r["vote_probability"] <= max(r["a"], r["b"], r["c"])
    assert [r["vote_prediction"] for r in me.soft_vote(df, ["a", "b", "c"]).collect()] == [1, 1]


def test_roc_auc_crowded_scores_and_empty(spark):
    rows = [(i % 3 == 0 and 1 or 0, 0.5 + i * 1e-12) for i in range(3000)] + [(1, 0.9), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert abs(me.roc_auc(df, "label", "score").head()["roc_auc"] - round(_brute_auc(rows), 6)) < 1e-9
    empty = spark.createDataFrame([], "label int, score double")
    assert me.roc_auc(empty, "label", "score").head()["roc_auc"] is None
