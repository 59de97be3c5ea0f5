import glob
import json
import tempfile

from churnlake import stages
from churnlake.operators import models as mo


def test_three_stages_end_to_end(spark):
    out = tempfile.mkdtemp(prefix="churnlake-stages-")
    meta = stages.clean(spark, "/root/testdata/sf0.001", out)
    assert meta["total_encoded_features"] == 61 and meta["train_shape"][1] == 63
    res = stages.train(spark, out, learners=["Logistic Regression", "Random Forest"], n_trials=2, k=3, kinds=["gbt_a", "rf"],
                       rounds={"Gradient Boosting": 10, "gbt_a": 10, "gbt_b": 10},
                       spaces={k: {**v, "rounds": ("int", 5, 10)} for k, v in mo.SPACES.items()})
    names = {r["model"] for r in spark.read.option("header", True).csv(f"{out}/model_results").collect()}
    assert names == {"Logistic Regression", "Random Forest", "gbt_a (tuned)", "rf (tuned)", "gbt_a (tuned) + SMOTE",
                     "rf (tuned) + SMOTE", "Ensemble (Soft Vote)", "Ensemble + SMOTE", "Stacking"}
    assert res["champion"] in names
    stages.extract(spark, out)
    doc = json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{out}/dashboard/part-*"))))
    assert doc["kpis"][0]["totalCustomers"] == 150
    assert [s["name"] for s in doc["riskSegments"]] == ["High Risk", "Medium Risk", "Low Risk"]
    summary = json.loads(spark.read.text(f"{out}/model_summary").head()[0])
    assert summary["champion_model"] == res["champion"] and 0 <= summary["holdout_auc"] <= 1
    d = spark.read.parquet(f"{out}/customer_directory/rows")
    assert [r["id"] for r in doc["customerDirectory"]] == [r["id"] for r in d.orderBy("row").collect()]
    assert d.count() == spark.read.parquet(f"{out}/test_cleaned").count()
    md = json.loads(spark.read.text(f"{out}/feature_metadata").head()[0])
    assert md["class_distribution"]["churned"] + md["class_distribution"]["not_churned"] == meta["train_shape"][0]
    totals = stages.submit(spark, out)
    assert totals["total"] == d.count() == spark.read.option("header", True).csv(f"{out}/submission").count()
    assert 0 < totals["predicted_churned"] < totals["total"]
    shape = spark.read.option("header", True).csv(f"{out}/quality/shape").head()
    assert int(shape["rows"]) == meta["train_shape"][0]
    assert spark.read.option("header", True).csv(f"{out}/quality/iqr_outliers").count() > 5


def test_tidy_strips_clamps_and_nulls(spark):
    df = spark.createDataFrame([(" a\t", 150, float("nan"), 1), (None, -300, 2.5, None)], "t string, nps_score int, x double, n int")
    assert [tuple(r) for r in stages.tidy(df).collect()] == [("a", 100, None, 1), (None, -100, 2.5, None)]
