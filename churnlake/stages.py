"""The three stages a user of the reference runs, as Spark jobs.

``clean``   customer table -> quality report tables, cleaned train/test
            tables, ML-ready (encoded) tables, feature metadata document,
            data dictionary;
``train``   ML-ready tables -> model comparison, tuned search, champion refit,
            holdout metrics, test predictions, feature importance, model
            summary document;
``extract`` cleaned tables + predictions -> dashboard document and the scored
            customer directory.

Stages hand over through parquet tables in ``out`` (on a cluster: the
shared storage), so each stage starts from data already cut from the
previous stage's lineage. Tables are written one file per partition (never
coalesced to one task); only the documents are single JSON objects, built
from bounded aggregate tables.

    python -m churnlake.stages clean   --data /path/to/sf --out /path/to/out
    python -m churnlake.stages train   --out /path/to/out
    python -m churnlake.stages extract --out /path/to/out
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import clip, strip_ws
from .operators import directory as di
from .operators import features as fe
from .operators import importance as imp
from .operators import metrics as me
from .operators import models as mo
from .operators import profile as pr
from .operators import segments as seg
from .operators import serving as sv
from .operators.projections import is_member
from .session import ensure_checkpoint_dir, input_bytes, tune_for_scale
from .sources import sinks
from .sources.customers import CHURN_ACTIONS, ID_COL, LEAKAGE_COLS, TARGET_COL, build_customers, split_frames


def _p(out: str, name: str) -> str:
    return f"{out.rstrip('/')}/{name}"


NPS_RANGE = (-100, 100)


def tidy(df: DataFrame) -> DataFrame:
    """Strings stripped, NaN to NULL, the NPS clamped to its range."""
    def one(f):
        c = F.col(f.name)
        if f.dataType.simpleString() == "string":
            c = strip_ws(c)
        elif f.dataType.simpleString() in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        return (clip(c, *NPS_RANGE) if f.name == "nps_score" else c).cast(f.dataType).alias(f.name)
    return df.select(*[one(f) for f in df.schema.fields])


def quality_report(train: DataFrame, out: str) -> None:
    """AG1-AG12 on the train table, one CSV table each, under ``out``/quality."""
    numbers = [c for c in pr.columns_of_type(train, ["numeric"]) if c != TARGET_COL]
    texts = [c for c in pr.columns_of_type(train, ["string"]) if c not in (ID_COL, "split")]
    tables = {
        "shape": pr.shape(train), "column_profile": pr.column_profile(train),
        "target_distribution": pr.target_distribution(train), "imbalance_ratio": pr.imbalance_ratio(train),
        "missing_values": pr.missing_values(train), "duplicate_rows": pr.duplicate_rows(train),
        "duplicate_ids": pr.duplicate_ids(train), "negative_values": pr.negative_values(train, fe.NON_NEGATIVE),
        "range_check": pr.range_check(train, {"nps_score": NPS_RANGE, "email_open_rate": (0, 1), "discount_usage_rate": (0, 1)}),
        "int_ranges": pr.int_ranges(train), "iqr_outliers": pr.iqr_outliers(train, numbers),
        "leakage_scan": pr.leakage_scan(train, texts),
    }
    for name, t in tables.items():
        sinks.write_csv(t, _p(out, f"quality/{name}"))


def clean(spark: SparkSession, data_dir: str, out: str, stats_from: str = "self") -> dict:
    """Stage 1: quality report, cleaned + engineered tables, encoded tables, metadata."""
    sinks.write_table(build_customers(spark, data_dir), _p(out, "customers_raw"))
    raw = spark.read.parquet(_p(out, "customers_raw"))
    quality_report(split_frames(raw)[0], out)
    train, test = split_frames(tidy(raw))
    tr_f, te_f = fe.fit_transform_split(train, test, stats_from=stats_from)
    sinks.write_table(tr_f.drop(*LEAKAGE_COLS), _p(out, "train_cleaned"))
    sinks.write_table(te_f.drop(*LEAKAGE_COLS, TARGET_COL), _p(out, "test_cleaned"))
    tr_f = spark.read.parquet(_p(out, "train_cleaned"))
    te_f = spark.read.parquet(_p(out, "test_cleaned"))
    tr_e, te_e, feats = fe.encode_split(tr_f, te_f)
    sinks.write_table(tr_e, _p(out, "train_ml_ready"))
    sinks.write_table(te_e, _p(out, "test_ml_ready"))
    tr_e = spark.read.parquet(_p(out, "train_ml_ready"))
    sinks.write_csv(pr.data_dictionary(tr_e, feats), _p(out, "data_dictionary"))
    cd = pr.class_distribution(tr_e).head()
    meta = {
        "train_shape": [tr_e.count(), len(tr_e.columns)], "test_shape": [te_e.count(), len(te_e.columns)],
        "target_column": TARGET_COL, "id_column": ID_COL, "leakage_columns_removed": LEAKAGE_COLS,
        "original_categorical_features": fe.CATEGORICAL_FEATURES,
        "original_numerical_features": fe.NUMERICAL_FEATURES, "engineered_features": fe.NEW_FEATURES,
        "total_encoded_features": len(feats),
        "class_distribution": {"not_churned": cd["not_churned"], "churned": cd["churned"],
                               "churn_rate": cd["churn_rate"]},
    }
    from datetime import datetime, timezone
    meta = {"created_at": datetime.now(timezone.utc).isoformat(), "pipeline_version": "1.0", **meta}
    sinks.write_document(spark.createDataFrame([(json.dumps(meta),)], "json string"), _p(out, "feature_metadata"))
    return meta


def train(spark: SparkSession, out: str, learners: list[str] | None = None, n_trials: int = 10, k: int = 5,
          kinds: Sequence[str] = ("gbt_a", "gbt_b", "rf"), rounds: dict[str, int] | None = None, spaces: dict | None = None) -> dict:
    """Stage 2: compare the untuned learners; tune one learner of each of
    ``kinds``; race the tuned ones, their SMOTE variants, both soft votes
    and stacking; rank, refit the champion of whatever kind, score test.
    ``rounds`` and ``spaces`` replace the sizes of the untuned boosters and
    the search ranges, by default the reference's."""
    ls = mo.learners(rounds=rounds)
    ensure_checkpoint_dir(spark)
    tr_e = spark.read.parquet(_p(out, "train_ml_ready"))
    te_e = spark.read.parquet(_p(out, "test_ml_ready"))
    feats = fe.encoded_feature_names(tr_e.columns)
    mm = mo.model_matrix(tr_e, feats)
    sinks.write_table(mm, _p(out, "model_matrix_train"))
    mm = spark.read.parquet(_p(out, "model_matrix_train"))
    mt = mo.model_matrix(te_e, feats, stats_from=tr_e)
    # R11: the holdout is split off first and never enters comparison,
    # search or ranking; the champion is refitted on all rows afterwards
    tune, hold = mo.split_holdout(mm)
    names = learners or list(ls)
    results = mo.compare_models(tune, names, k=k, ls=ls).drop("seconds")
    contest = None
    tuned: dict = {}
    if n_trials:
        for kind in kinds:
            space = (spaces or mo.SPACES)[kind]
            search = mo.random_search(tune, kind, n_trials=n_trials, k=k, space=space).checkpoint(eager=True)  # one row per trial
            sinks.write_csv(search, _p(out, f"tuning_trials/{kind}"))
            tuned[f"{kind} (tuned)"] = mo.best_trial(search, kind)
        contest = mo.Race(tune, tuned, k, hold=hold, folder=_p(out, "fits"))
        results = results.unionByName(contest.run())
    ranked = me.rank_models(results).checkpoint(eager=True)  # one row per contender
    sinks.write_csv(ranked, _p(out, "model_results"))
    champ = ranked.filter("is_champion").head()["model"]
    # untuned learners and tuned ones whose importances are asked for, fitted without the holdout (fold 0) and on all rows
    marked = tune.withColumn("fold", F.lit(1)).unionByName(hold.withColumn("fold", F.lit(0)))
    plain = mo.FitStore(marked, {**ls, **tuned})
    scorer = (lambda left: plain.scorer(champ, (0,) if left else ())) if champ in ls else lambda left: contest.scorer(champ, contest.hold if left else ())
    holdout = me.evaluate(scorer(True)(hold), "label", "prediction", "score")
    preds = mo.predictions_table(scorer(False)(mt))
    sinks.write_table(preds, _p(out, "test_predictions"))
    preds = spark.read.parquet(_p(out, "test_predictions"))

    def of(kind: str, by: str, name: str) -> DataFrame:
        """Importances of the tuned model, where there is one."""
        member = f"{kind} (tuned)" if f"{kind} (tuned)" in tuned else kind
        store = contest.store if contest and member in tuned else plain
        model = store.fit([(member, (), False)]).models[member, (), False]
        return mo.split_importances(model, feats, spark, by).select("feature", F.col("importance").alias(name))

    a, b = of("gbt_a", "gain", "imp_a"), of("gbt_b", "splits", "imp_b")
    comb = imp.combined_importance(a.select("feature"), a, b)
    sinks.write_csv(comb, _p(out, "feature_importance"))
    top = imp.churn_drivers(spark.read.option("header", True).schema(comb.schema).csv(_p(out, "feature_importance")))
    summary = mo.model_summary(ranked, holdout, preds, top.select("feature"))
    sinks.write_document(summary, _p(out, "model_summary"))
    return {"champion": champ}


def extract(spark: SparkSession, out: str) -> None:
    """Stage 3: customer directory (stored with its pages and search index,
    riskiest first) + dashboard document, the directory's rows included, as
    ordered parts that joined by name are one JSON document."""
    tr_f = spark.read.parquet(_p(out, "train_cleaned"))
    te_f = spark.read.parquet(_p(out, "test_cleaned"))
    preds = spark.read.parquet(_p(out, "test_predictions"))
    fi = spark.read.option("header", True).schema(
        "feature string, imp_a double, imp_b double, rank_a double, rank_b double, avg_rank double"
    ).csv(_p(out, "feature_importance"))
    ranked = spark.read.option("header", True).schema(
        "model string, accuracy double, f1 double, precision double, recall double, roc_auc double, "
        "rank int, is_champion boolean").csv(_p(out, "model_results"))
    rows = di.store(sv.customer_directory(preds, te_f), _p(out, "customer_directory")).rows
    doc = sv.dashboard_document({
        "kpis": seg.kpis(tr_f, te_f, preds), "churnDrivers": imp.churn_drivers(fi),
        "riskSegments": seg.risk_segments(preds), "tenureImpact": seg.tenure_impact(tr_f),
        "engagementImpact": seg.engagement_impact(tr_f, on_duplicate="merge"),
        "clvSegments": seg.clv_segments(tr_f), "contractStats": seg.contract_stats(tr_f),
        "npsStats": seg.nps_stats(tr_f), "paymentStats": seg.payment_stats(tr_f),
        "modelPerformance": me.model_performance(ranked),
        "retentionLevers": sv.retention_levers(tr_f, tr_f), "campaigns": sv.campaign_sizing(tr_f, te_f, tr_f, preds),
        "insights": sv.insight_gaps(tr_f, tr_f),
        "customerDirectorySize": rows.agg(F.count(F.lit(1)).alias("rows")),
    })
    sinks.write_document_rows(doc, "customerDirectory", rows, "row", _p(out, "dashboard"))


def submit(spark: SparkSession, out: str) -> dict:
    """Rule-scored submission (ML18): a customer whose recommended action is
    one of the churn actions is predicted to churn."""
    test = split_frames(tidy(spark.read.parquet(_p(out, "customers_raw"))))[1]
    rows = test.select(ID_COL, is_member("recommended_action", CHURN_ACTIONS).alias("churn_prediction"))
    sinks.write_csv(rows, _p(out, "submission"))
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.sum("churn_prediction").cast("long").alias("predicted_churned")).head()
    return totals.asDict()


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="churnlake.stages")
    ap.add_argument("stage", choices=["clean", "train", "extract", "submit", "all"])
    ap.add_argument("--data", help="folder with the input parquet tables (clean)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--trials", type=int, default=10)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("churnlake-stages").getOrCreate()
    ensure_checkpoint_dir(spark)
    if args.data:
        from .sources.tables import table_path
        tune_for_scale(spark, input_bytes(spark, [table_path(args.data, t) for t in
                                                 ("orders", "lineitem", "part", "events", "customer")]))
    if args.stage in ("clean", "all"):
        clean(spark, args.data, args.out)
    if args.stage in ("train", "all"):
        train(spark, args.out, n_trials=args.trials)
    if args.stage in ("extract", "all"):
        extract(spark, args.out)
    if args.stage in ("submit", "all"):
        submit(spark, args.out)


if __name__ == "__main__":
    main()
