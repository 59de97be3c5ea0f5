"""Model invariants: planted signal is found, probabilities are
probabilities, champion refit scores every test row."""

from pyspark.sql import functions as F

from churnlake.operators import models as mo
from churnlake.plans import catalog as cat

SF = "/root/testdata/sf0.01"


def test_planted_signal_auc_and_probabilities(spark):
    mm, mt, feats = cat._mm(spark, SF)
    res = {r["model"]: r for r in mo.compare_models(mm, ["Logistic Regression", "gbt_a"], k=3).collect()}
    assert res["Logistic Regression"]["roc_auc"] > 0.85
    assert res["gbt_a"]["roc_auc"] > 0.85
    model = mo.learners()["Logistic Regression"]().fit(mm)
    preds = mo.predictions_table(mo.score_frame(model, mt))
    stats = preds.agg(F.min("churn_probability"), F.max("churn_probability"), F.count(F.lit(1))).head()
    assert 0.0 <= stats[0] <= stats[1] <= 1.0
    assert stats[2] == mt.count()


def test_soft_vote_cv_between_members(spark):
    mm, _, _ = cat._mm(spark, SF)
    ls = mo.learners()
    members = {"lr": ls["Logistic Regression"], "rf": ls["Random Forest"]}
    vote = mo.soft_vote_cv(mm, members, k=3).head()
    assert 0.85 < vote["roc_auc"] <= 1.0


def test_holdout_split_up_front_is_disjoint_and_stratified(spark):
    mm, _, _ = cat._mm(spark, SF)
    tune, hold = mo.split_holdout(mm, 0.2)
    t_ids = {r[0] for r in tune.select("customer_id").collect()}
    h_ids = {r[0] for r in hold.select("customer_id").collect()}
    assert not (t_ids & h_ids) and len(t_ids) + len(h_ids) == mm.count()
    per = {r["label"]: r["count"] for r in hold.groupBy("label").count().collect()}
    tot = {r["label"]: r["count"] for r in mm.groupBy("label").count().collect()}
    for c in tot:
        assert per[c] == round(0.2 * tot[c])


def test_every_kind_of_champion_scores_every_row(spark):
    """Members, SMOTE variants, votes and stacking each refit and score; the vote lies between its members."""
    mm, mt, _ = cat._mm(spark, "/root/testdata/sf0.001")
    from pyspark.ml.classification import LogisticRegression
    members = {"lr": lambda: LogisticRegression(weightCol="weight", regParam=0.01, maxIter=20),
               "rf": mo.Params(5, depth=5, l2=0.0, cols="sqrt", weight="weight", forest=True)}
    race = mo.Race(mm, members, k=3)
    race.run()
    scores = {}
    for name in ("lr", "rf", "lr + SMOTE", "rf + SMOTE", mo.VOTE, mo.VOTE_SMOTE, mo.STACK):
        rows = race.scorer(name)(mt).collect()
        assert len(rows) == mt.count() and all(0 <= r["score"] <= 1 for r in rows)
        scores[name] = {r["customer_id"]: r["score"] for r in rows}
    for c, v in scores[mo.VOTE].items():
        lo, hi = sorted((scores["lr"][c], scores["rf"][c]))
        assert lo - 1e-12 <= v <= hi + 1e-12
