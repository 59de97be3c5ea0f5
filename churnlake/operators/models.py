"""Model operators (ML1, ML3-ML5, ML7-ML11, ML15, ML17, ML19).

Roles of the reference's learners (the boosting libraries are not available): logistic regression on standardised
features (Spark ML), random forest, gradient-boosted trees, and two further boosters: ``gbt_a`` (shallow, positive
class weighted) and ``gbt_b`` (deeper, capped leaves, row and column samples). The tree learners are settings
(``boosting.Params``); all fits of a call grow in lockstep (``boosting.Lockstep``). Any Spark ML estimator can be a
member, too. Class imbalance is handled by weights (AG28).

Evaluation is always "fit without fold i, score fold i" with folds from the hash-stratified splitter (ML2, exact mode), so
every metric is computed by the DataFrame metric operators over the union of the fold predictions. ``FitStore`` keeps the
scores by (member, left-out folds): cross-validation, votes and nested stacking read them, and no fit is made twice. Loops on
the driver run over folds, members and trials only (bounded).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields, replace
from itertools import combinations, count

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.customers import ID_COL, TARGET_COL
from . import metrics as me
from .boosting import Fit, Lockstep, Params, TreeModel, edges_of
from .folds import holdout_split, stratified_folds
from .segments import class_weights

SEED = 42
# Sizes of the reference's learners (trees, rounds)
RF_TREES, SCAN_TREES = 300, 200
ROUNDS = {"Gradient Boosting": 200, "gbt_a": 300, "gbt_b": 300}

Member = Params | Callable[[], Estimator]
Scorer = Callable[[DataFrame], DataFrame]


def model_matrix(enc: DataFrame, features: Sequence[str], stats_from: DataFrame | None = None,
                 label: str = TARGET_COL) -> DataFrame:
    """(customer_id, label, weight, pos_weight, features): NULL
    features are imputed with the train median (Imputer, distributed
    approximate quantiles), then assembled into one vector (FE19)."""
    fit_on = stats_from if stats_from is not None else enc
    imp_cols = [f"_i{i}" for i in range(len(features))]
    ren = {f: c for f, c in zip(features, imp_cols)}

    def prep(d: DataFrame) -> DataFrame:
        cols = [F.col(f).cast("double").alias(ren[f]) for f in features]
        lab = [F.col(label).cast("double").alias("label")] if label in d.columns else [F.lit(None).cast("double").alias("label")]
        return d.select(F.col(ID_COL), *lab, *cols)

    imputer = Imputer(inputCols=imp_cols, outputCols=imp_cols, strategy="median").fit(prep(fit_on))
    x = imputer.transform(prep(enc))
    x = VectorAssembler(inputCols=imp_cols, outputCol="features", handleInvalid="keep").transform(x)
    x = x.select(F.col(ID_COL), "label", "features")
    w = class_weights(fit_on.select(F.col(label)), label)
    x = x.crossJoin(F.broadcast(w))  # one row by construction
    return x.select(ID_COL, "label",
                    F.when(F.col("label") == 1, F.col("weight_1")).otherwise(F.col("weight_0")).alias("weight"),
                    F.when(F.col("label") == 1, F.col("pos_weight")).otherwise(F.lit(1.0)).alias("pos_weight"),
                    "features")


LR_REG = 1e-3


def learners(rf_trees: int = RF_TREES, rounds: dict[str, int] | None = None, lr_reg: float = LR_REG) -> dict[str, Member]:
    """Name -> member (features in 'features', label in 'label')."""
    n = ROUNDS | (rounds or {})

    def lr():
        # LogisticRegression standardises features internally (standardization=True),
        # which is the reference's "scaled features" without an extra scaler pass;
        # L2 penalty like the reference's default (C = 1): regParam ~ 1 / n
        return LogisticRegression(weightCol="weight", maxIter=100, regParam=lr_reg, standardization=True)
    return {
        "Logistic Regression": lr,
        "Random Forest": Params(rf_trees, depth=5, l2=0.0, cols="sqrt", weight="weight", forest=True),
        "Gradient Boosting": Params(n["Gradient Boosting"], depth=3, l2=0.0),
        "gbt_a": Params(n["gbt_a"], depth=3, weight="pos_weight"),
        "gbt_b": Params(n["gbt_b"], depth=5, leaves=31, rows=0.8, cols=0.8, weight="weight"),
    }


def score_frame(model, df: DataFrame) -> DataFrame:
    """ML17 core: customer_id, label, prediction (int), score (P(class 1))."""
    if isinstance(model, TreeModel):
        return model.score(df)
    p = model.transform(df)
    return p.select(ID_COL, "label", F.col("prediction").cast("int").alias("prediction"),
                    vector_to_array(F.col("probability"))[1].alias("score"))


def fold_matrix(mm: DataFrame, k: int = 5) -> DataFrame:
    """The model matrix with exact stratified fold ids, written once to the
    checkpoint folder so every learner and fold reads the same assignment
    and nothing stays cached."""
    # keep the partitioning of the model matrix (sized by its data) rather
    # than the shuffle-partition count the rank window leaves behind: every
    # optimiser iteration is one job over these partitions
    n = max(1, mm.rdd.getNumPartitions())
    ensure_checkpoint_dir(mm.sparkSession)
    return stratified_folds(mm, k, key=ID_COL, label="label", exact=True).coalesce(n).checkpoint(eager=True)


# ------------------------------------------------------------------ the store of fits

Key = tuple[str, tuple[int, ...], bool]


def _text(left: Iterable[int]) -> str:
    return ",".join(map(str, sorted(left)))


class FitStore:
    """Fits of ``members`` on ``rows`` (model matrix with ``fold``) by (member, left-out folds, SMOTE or not), each made once.

    A fit is trained on the rows whose fold is not left out and scores those that are. The scores are tables in ``folder``
    (by default one in the shared checkpoint folder): a driver restarted with the same folder makes the missing fits only, and the
    trees of fits under way go on from the last saved round. ``n_fits`` counts the fits made by this object."""

    def __init__(self, rows: DataFrame, members: dict[str, Member], folder: str | None = None):
        self.rows, self.members, self.spark = rows, members, rows.sparkSession
        self.folder = folder or f"{ensure_checkpoint_dir(self.spark)}/fits-{uuid.uuid4().hex}"
        self.models: dict[Key, object] = {}
        self.n_fits, self.staged = 0, []
        self._tables: list[DataFrame] = []
        self._done: set[Key] = set()
        self._edges, self._nth = None, count()

    # The store of trained rows --------------------------------------------------
    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self._exists(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _train_rows(self, left: tuple[int, ...]) -> DataFrame:
        return self.rows.where(~F.col("fold").isin(*left)) if left else self.rows

    def _synthetic(self, left: tuple[int, ...], made: int) -> DataFrame:
        """SMOTE rows for the training rows of one left-out set; they get weight 1 (ML7)."""
        from .resample import smote

        def make() -> DataFrame:
            new = smote(self._train_rows(left).drop("fold"), id_col=ID_COL).drop("is_synthetic")
            ones = {c: F.lit(1.0) for c in ("weight", "pos_weight")}
            return new.withColumns({**ones, "fold": F.lit(-1), "made": F.lit(made)})
        # a table of an earlier call may carry that call's number
        return self._table(f"synthetic-{_text(left) or 'all'}", make).withColumn("made", F.lit(made))

    def prepare(self, lefts: Iterable[tuple[int, ...]]) -> dict[tuple[int, ...], DataFrame]:
        """The SMOTE rows of some left-out sets, side by side."""
        sets = sorted(lefts)
        with ThreadPoolExecutor(4) as pool:
            return dict(zip(sets, pool.map(lambda left: self._synthetic(left, sets.index(left)), sets), strict=True))

    def edges(self) -> list:
        """Cut points of the features, made once."""
        if self._edges is None:
            self._edges = edges_of(self.rows)
        return self._edges

    # Fitting --------------------------------------------------------------------
    def fit(self, wanted: Iterable[Key]) -> FitStore:
        """Make the fits of ``wanted`` that are not in the store; trees in lockstep, estimators side by side."""
        wanted = [k for k in dict.fromkeys((m, tuple(sorted(left)), smote) for m, left, smote in wanted) if k not in self._done]
        if not wanted:
            return self
        synthetic = self.prepare({left for _, left, smote in wanted if smote})
        made = {left: i for i, left in enumerate(synthetic)}
        trees = [k for k in wanted if isinstance(self.members[k[0]], Params)]
        if trees:
            self._fit_trees(trees, made, synthetic)
        others = [k for k in wanted if k not in set(trees)]
        with ThreadPoolExecutor(5) as pool:
            self._tables += list(pool.map(lambda k: self._fit_estimator(k, synthetic), others))
        self._done |= set(wanted)
        return self

    def _fit_trees(self, keys: list[Key], made: dict, synthetic: dict[tuple[int, ...], DataFrame]) -> None:
        name = f"trees-{next(self._nth)}"
        data = self.rows.withColumn("made", F.lit(-1))
        for part in synthetic.values():
            data = data.unionByName(part)
        grown = Lockstep(data, [Fit(m, self.members[m], left, smote) for m, left, smote in keys], self.edges(), made, f"{self.folder}/{name}")
        grown.run()
        self.n_fits += len(keys)
        self._tables.append(self._table(f"scores-{name}", grown.scores))
        self.staged += grown.staged
        for m, left, smote in keys:
            self.models[m, left, smote] = grown.model(m, left, smote)
        grown.release()

    def _fit_estimator(self, key: Key, synthetic: dict[tuple[int, ...], DataFrame]) -> DataFrame:
        member, left, smote = key
        train = self._train_rows(left).select(ID_COL, "label", "weight", "pos_weight", "features")
        if smote:
            train = train.unionByName(synthetic[left].select(*train.columns))

        def model():
            if key not in self.models:
                self.models[key] = self.members[member]().fit(train)
                self.n_fits += 1
            return self.models[key]

        def scores() -> DataFrame:
            rows = self.rows.where(F.col("fold").isin(*left)) if left else self.rows.limit(0)
            scored = score_frame(model(), rows).join(rows.select(ID_COL, F.col("fold").cast("int").alias("fold")), ID_COL)
            return scored.select(F.lit(member).alias("member"), F.lit(smote).alias("smote"), F.lit(_text(left)).alias("left_out"),
                                 F.col(ID_COL).cast("string").alias(ID_COL), "fold", "label", "score")

        out = self._table(f"scores-{member}-{smote}-{_text(left) or 'none'}".replace(" ", "_"), scores)
        self.models.setdefault(key, None)
        if self.models[key] is None:
            del self.models[key]
        return out

    # Reading --------------------------------------------------------------------
    def scores(self) -> DataFrame:
        """(member, smote, left_out, customer_id, fold, label, score)."""
        out = self._tables[0]
        for t in self._tables[1:]:
            out = out.unionByName(t)
        return out

    def out_of_fold(self, k: int, beside: tuple[int, ...] = (), smote: bool = False) -> DataFrame:
        """Each row of folds 0 to k - 1 scored by the fits that left out its fold and ``beside``."""
        keys = [(i, _text({i, *beside})) for i in range(k)]
        match = F.lit(False)
        for i, left in keys:
            match = match | ((F.col("fold") == i) & (F.col("left_out") == left))
        return self.scores().where((F.col("smote") == smote) & match)

    def scorer(self, member: str, left: tuple[int, ...] = (), smote: bool = False) -> Scorer:
        """Scoring function of one fit."""
        key = (member, tuple(sorted(left)), smote)
        if key not in self.models:
            self._done.discard(key)
            self.fit([key])
        if key not in self.models:  # its scores were in the store, the estimator is fitted again
            synthetic = {key[1]: self._synthetic(key[1], 0)} if smote else {}
            train = self._train_rows(key[1]).select(ID_COL, "label", "weight", "pos_weight", "features")
            train = train.unionByName(synthetic[key[1]].select(*train.columns)) if smote else train
            self.models[key] = self.members[member]().fit(train)
        model = self.models[key]
        return lambda df: score_frame(model, df)


KEYS = [ID_COL, "fold", "label"]


def _decided(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def cross_val_predict(member: Member, folded: DataFrame, k: int = 5, smote: bool = False) -> DataFrame:
    """Out-of-fold predictions (customer_id, fold, label, score, prediction) on rows with ``fold``."""
    store = FitStore(folded, {"one": member}).fit([("one", (i,), smote) for i in range(k)])
    return _decided(store.out_of_fold(k, smote=smote).select(*KEYS, "score"))


METRICS = ("accuracy", "f1", "precision", "recall", "roc_auc")


def cv_metrics(oof: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per-fold metrics averaged over folds (per group): accuracy, f1,
    precision, recall, roc_auc."""
    g = list(group)
    per_fold = me.evaluate(oof, "label", "prediction", "score", [*g, "fold"])
    return per_fold.groupBy(*g).agg(*[F.bround(F.avg(c), 6).alias(c) for c in METRICS])


def compare_models(mm: DataFrame, names: Sequence[str] | None = None, k: int = 5, smote: bool = False, suffix: str = "",
                   ls: dict[str, Member] | None = None) -> DataFrame:
    """ML3: model, accuracy, f1, precision, recall, roc_auc, seconds.

    Folds, bins and SMOTE rows are made once; then a learner's k fold fits run together and its out-of-fold predictions are written
    (``seconds`` is that wall time), the learners side by side, as one alone leaves cores idle; the metrics of all learners come from
    one grouped evaluation."""
    ls = ls or learners()
    store = FitStore(fold_matrix(mm, k), ls)
    lefts = [(i,) for i in range(k)]
    if smote:
        store.prepare(lefts)
    names = list(names or ls)
    if any(isinstance(ls[name], Params) for name in names):
        store.edges()

    def fitted(name: str) -> float:
        t0 = time.time()
        store.fit([(name, left, smote) for left in lefts])
        return round(time.time() - t0, 3)

    with ThreadPoolExecutor(max(1, len(names))) as pool:
        took = dict(zip(dict.fromkeys(names), pool.map(fitted, dict.fromkeys(names)), strict=True))
    secs = [(name + suffix, took[name]) for name in names]
    oofs = [_decided(store.out_of_fold(k, smote=smote).where(F.col("member") == name).select(*KEYS, "score")).withColumn("model", F.lit(name + suffix)) for name in names]
    allo = oofs[0]
    for o in oofs[1:]:
        allo = allo.unionByName(o)
    m = cv_metrics(allo, ["model"])
    t = mm.sparkSession.createDataFrame(secs, "model string, seconds double")
    return m.join(F.broadcast(t), "model").select("model", *METRICS, "seconds")


# The reference's search ranges (kind, low, high / choices)
SPACES = {
    "gbt_a": {
        "rounds": ("int", 100, 800), "depth": ("int", 3, 10), "rate": ("logfloat", 0.01, 0.3), "rows": ("float", 0.6, 1.0), "cols": ("float", 0.6, 1.0),
        "min_weight": ("int", 1, 10), "gain": ("float", 0, 5), "l1": ("logfloat", 1e-8, 10), "l2": ("logfloat", 1e-8, 10)},
    "gbt_b": {
        "rounds": ("int", 100, 800), "depth": ("int", 3, 12), "rate": ("logfloat", 0.01, 0.3), "leaves": ("int", 20, 150), "rows": ("float", 0.6, 1.0),
        "cols": ("float", 0.6, 1.0), "min_rows": ("int", 5, 50), "l1": ("logfloat", 1e-8, 10), "l2": ("logfloat", 1e-8, 10)},
    "rf": {
        "rounds": ("int", 100, 800), "depth": ("int", 5, 30), "split_rows": ("int", 2, 20), "min_rows": ("int", 1, 10), "cols": ("cat", ["sqrt", "log2", "all"])},
}
TUNED_FROM = {"gbt_a": "gbt_a", "gbt_b": "gbt_b", "rf": "Random Forest"}


def sample_params(space: dict, n_trials: int, seed: int = SEED) -> list[dict]:
    """Random search (re-aimed from TPE): int, float, log-float and
    categorical axes, drawn with a seeded generator."""
    import numpy as np
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_trials):
        p = {}
        for name, spec in space.items():
            kind = spec[0]
            if kind == "int":
                p[name] = int(rng.integers(spec[1], spec[2] + 1))
            elif kind == "float":
                p[name] = float(rng.uniform(spec[1], spec[2]))
            elif kind == "logfloat":
                p[name] = float(np.exp(rng.uniform(np.log(spec[1]), np.log(spec[2]))))
            else:
                p[name] = spec[1][int(rng.integers(0, len(spec[1])))]
        out.append(p)
    return out


def tuned(kind: str, params: dict | str) -> Params:
    """Settings of ``kind`` with the searched ones (a dict, or its JSON) in their place."""
    p = json.loads(params) if isinstance(params, str) else params
    return replace(learners()[TUNED_FROM[kind]], **{f.name: p[f.name] for f in fields(Params) if f.name in p})


def random_search(mm: DataFrame, kind: str = "gbt_a", n_trials: int = 10, k: int = 5, seed: int = SEED, space: dict | None = None,
                  folder: str | None = None) -> DataFrame:
    """ML5: learner, trial, params (JSON), f1 (mean over folds, positive class), and from the same fits staged_rounds and
    staged_f1: the best of the smaller numbers of rounds, scored from the running sum of the trees (pooled over the folds).

    All trials and folds grow in lockstep; ``n_trials`` is honoured (R8). ``folder`` keeps the scores of all trials."""
    trials = sample_params(space or SPACES[kind], n_trials, seed)
    members: dict[str, Member] = {f"{kind} {i}": tuned(kind, t) for i, t in enumerate(trials)}
    store = FitStore(fold_matrix(mm, k), members, folder).fit([(m, (i,), False) for m in members for i in range(k)])
    f1 = cv_metrics(_decided(store.out_of_fold(k)), ["member"]).select("member", "f1")
    best: dict[str, tuple[float, int]] = {}
    for member in members:
        sums: dict[int, list[int]] = {}
        for name, rounds, tp, fp, fn in store.staged:
            if name == member:
                sums.setdefault(rounds, []).append((tp, fp, fn))
        for rounds, counts in sums.items():
            tp, fp, fn = (sum(c) for c in zip(*counts, strict=True))
            best[member] = max(best.get(member, (-1.0, 0)), (2 * tp / max(1, 2 * tp + fp + fn), -rounds))
    rows = [(f"{kind} {i}", kind, i, json.dumps(t, sort_keys=True), -best[f"{kind} {i}"][1], round(best[f"{kind} {i}"][0], 6)) for i, t in enumerate(trials)]
    said = mm.sparkSession.createDataFrame(rows, "member string, learner string, trial int, params string, staged_rounds int, staged_f1 double")
    return f1.join(F.broadcast(said), "member").select("learner", "trial", "params", "f1", "staged_rounds", "staged_f1")


def best_trial(trials: DataFrame, kind: str) -> Params:
    """The member of the best trial of ``kind`` (a bounded table)."""
    return tuned(kind, trials.where(F.col("learner") == kind).orderBy(F.desc("f1"), "trial").head()["params"])


def split_holdout(mm: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """ML12 up front (R11): (tuning rows, holdout rows), exact stratified by
    hash rank. The holdout never enters comparison, search or ranking."""
    n = max(1, mm.rdd.getNumPartitions())
    ensure_checkpoint_dir(mm.sparkSession)
    split = holdout_split(mm, test_size, key=ID_COL, label="label", exact=True).coalesce(n).checkpoint(eager=True)
    return split.filter(~F.col("is_holdout")).drop("is_holdout"), split.filter(F.col("is_holdout")).drop("is_holdout")


def holdout_evaluate(mm: DataFrame, fit_score: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
                     test_size: float = 0.2, split: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """ML12 + ML13/14: fit on the stratified 80 %, evaluate on the 20 %
    (pass ``split`` to reuse the up-front split the tuning used)."""
    tune, hold = split if split is not None else split_holdout(mm, test_size)
    scorer = fit_score(tune)
    return me.evaluate(scorer(hold), "label", "prediction", "score")


def split_importances(model: TreeModel, features: Sequence[str], spark: SparkSession, by: str = "splits") -> DataFrame:
    """ML15: feature, splits, gain, importance of every feature from the table of the trees' nodes. ``by`` splits (how often a
    feature splits) or gain (mean gain of its splits); the importances sum to 1."""
    used = model.nodes(spark).where("feature is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))
    names = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "i int, name string")
    rows = names.join(used, names["i"] == used["feature"], "left").select(
        F.col("name").alias("feature"), F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
    value = F.col("splits").cast("double") if by == "splits" else F.col("gain") / F.greatest("splits", F.lit(1))
    total = rows.agg(F.sum(value).alias("total"))  # one row
    return rows.crossJoin(F.broadcast(total)).select("feature", "splits", "gain", F.coalesce(F.try_divide(value, F.col("total")), F.lit(0.0)).alias("importance"))


def forest_importances(model, features: Sequence[str]) -> DataFrame:
    """feature, importance of a Spark ML tree model (share-normalised: sums to 1)."""
    vals = model.featureImportances.toArray()
    tot = float(vals.sum()) or 1.0
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(v) / tot) for f, v in zip(features, vals)], "feature string, importance double")


def importance_scan(mm: DataFrame, features: Sequence[str], trees: int = SCAN_TREES, near_zero: float = 0.005) -> DataFrame:
    """ML1: quick forest importances, ranked, with the near-zero flag."""
    from pyspark.sql import Window
    rf = RandomForestClassifier(numTrees=trees, seed=SEED).fit(mm)
    imp = forest_importances(rf, features)
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))  # one row per feature: bounded
    return imp.select(F.row_number().over(w).alias("rank"), "feature", F.bround("importance", 6).alias("importance"),
                      (F.col("importance") < near_zero).alias("near_zero"))


def predictions_table(scored: DataFrame) -> DataFrame:
    """ML17: customer_id, churn_prediction (int), churn_probability (4 dp)."""
    return scored.select(ID_COL, F.col("prediction").cast("int").alias("churn_prediction"),
                         F.bround(F.col("score"), 4).alias("churn_probability"))


def model_summary(ranked: DataFrame, holdout: DataFrame, predictions: DataFrame, top_features: DataFrame) -> DataFrame:
    """ML19: one-row document: champion, cv_results, holdout_auc,
    all_model_results, test_predictions, top_features, created_at."""
    ch = ranked.filter(F.col("is_champion")).select(
        F.col("model").alias("champion_model"),
        F.struct("accuracy", "f1", "precision", "recall", "roc_auc").alias("cv_results"))
    allm = ranked.agg(F.collect_list(F.struct("model", "accuracy", "f1", "precision", "recall", "roc_auc"))
                      .alias("all_model_results"))
    ho = holdout.select(F.col("roc_auc").alias("holdout_auc"))
    tp = predictions.agg(F.struct(F.count(F.lit(1)).alias("total"),
                                  F.sum("churn_prediction").cast("long").alias("predicted_churned"),
                                  F.avg(F.col("churn_prediction").cast("double")).alias("predicted_churn_rate"))
                         .alias("test_predictions"))
    tf = top_features.agg(F.collect_list("feature").alias("top_features"))
    return ch.crossJoin(ho).crossJoin(allm).crossJoin(tp).crossJoin(tf).withColumn("created_at", F.current_timestamp())


# ------------------------------------------------------------------ votes, stacking, the race

VOTE, STACK, SMOTE = "Ensemble (Soft Vote)", "Stacking", " + SMOTE"
VOTE_SMOTE = "Ensemble" + SMOTE


def _voted(scores: DataFrame) -> DataFrame:
    """ML8: mean of the members' scores of each row, met on the customer id."""
    return _decided(scores.groupBy(*KEYS).agg(F.avg("score").alias("score")))


def _wide(scores: DataFrame, members: Sequence[str]) -> DataFrame:
    """J4: one column of scores per member, met on the customer id (never by position), as a vector."""
    wide = scores.groupBy(*KEYS).pivot("member", list(members)).agg(F.first("score"))
    wide = wide.select(*KEYS, *[F.col(f"`{m}`").alias(f"_p{i}") for i, m in enumerate(members)])
    return VectorAssembler(inputCols=[f"_p{i}" for i in range(len(members))], outputCol="features").transform(wide)


def _meta(scores: DataFrame, store: FitStore, members: Sequence[str]):
    """ML9: a class-balanced logistic regression over the members' out-of-fold scores."""
    weight = store.rows.select(F.col(ID_COL).cast("string").alias(ID_COL), "weight")
    return LogisticRegression(weightCol="weight", maxIter=100).fit(_wide(scores, members).join(weight, ID_COL))


def stacking_alignment(mm: DataFrame, members: dict[str, Member], k: int = 5) -> DataFrame:
    """J4: customer_id, fold and one out-of-fold score column per member."""
    store = FitStore(fold_matrix(mm, k), members).fit([(m, (i,), False) for m in members for i in range(k)])
    wide = store.out_of_fold(k).groupBy(ID_COL, "fold").pivot("member", list(members)).agg(F.first("score"))
    return wide.select(ID_COL, "fold", *[F.col(f"`{m}`").alias(f"p_{m}") for m in members])


def soft_vote_cv(mm: DataFrame, members: dict[str, Member], k: int = 5, smote: bool = False) -> DataFrame:
    """ML8 on fitted models: cross-validated metrics of the vote. The vote's fold-i model is its members' fold-i models."""
    store = FitStore(fold_matrix(mm, k), members).fit([(m, (i,), smote) for m in members for i in range(k)])
    return cv_metrics(_voted(store.out_of_fold(k, smote=smote)))


class Race:
    """All contenders on one store of fits: members, their SMOTE variants, both soft votes, stacking.

    Stacking is cross-validated honestly: in outer fold i the meta learner sees members fitted without i and j on fold j. The inner
    folds of an outer fold are the other outer folds, so the fit without i and j serves both of them, and the fits without i that
    cross-validate the members are the base models of stacking in fold i: with k folds and m members k + k (k - 1) / 2 fits a
    member, and k more for its SMOTE variant. ``hold``: rows that no contender sees before the end (fold k)."""

    def __init__(self, mm: DataFrame, members: dict[str, Member], k: int = 5, hold: DataFrame | None = None, folder: str | None = None):
        if k < 3:
            raise ValueError("nested stacking leaves out two folds at a time: k must be 3 or more")
        self.members, self.k = list(members), k
        rows = fold_matrix(mm, k)
        if hold is not None:
            rows = rows.unionByName(hold.withColumn("fold", F.lit(k).cast(rows.schema["fold"].dataType)))
        self.hold = (k,) if hold is not None else ()
        self.store = FitStore(rows, members, folder)

    def wanted(self) -> list[Key]:
        """The fits of the race."""
        lefts = [(i,) for i in range(self.k)]
        keys = [(m, left + self.hold, s) for m in self.members for left in lefts for s in (False, True)]
        return keys + [(m, pair + self.hold, False) for m in self.members for pair in combinations(range(self.k), 2)]

    def needs(self, name: str, left: tuple[int, ...] = ()) -> list[Key]:
        """The fits of the contender ``name`` trained on all rows but those of the folds ``left``."""
        members = self.members if name in (VOTE, VOTE_SMOTE, STACK) else [name.removesuffix(SMOTE)]
        keys = [(m, left, name.endswith(SMOTE)) for m in members]
        folds = {*range(self.k), *self.hold} - set(left)
        return keys + [(m, tuple(sorted({i, *left})), False) for m in members for i in folds if name == STACK]

    def _stacked(self, i: int) -> DataFrame:
        rest = [j for j in range(self.k) if j != i]
        match = F.lit(False)
        for j in rest:
            match = match | ((F.col("fold") == j) & (F.col("left_out") == _text({i, j, *self.hold})))
        scores = self.store.scores().where(~F.col("smote"))
        meta = _meta(scores.where(match), self.store, self.members)
        outer = scores.where((F.col("fold") == i) & (F.col("left_out") == _text({i, *self.hold})))
        out = meta.transform(_wide(outer, self.members))
        return _decided(out.select(*KEYS, vector_to_array("probability")[1].alias("score")))

    def run(self) -> DataFrame:
        """ML3 + ML7-ML10: model and cross-validated metrics of every contender."""
        self.store.fit(self.wanted())
        plain, smoted = (self.store.out_of_fold(self.k, self.hold, s) for s in (False, True))
        parts = [_decided(p).select(*KEYS, "score", "prediction", F.concat("member", F.lit(tail)).alias("model")) for p, tail in ((plain, ""), (smoted, SMOTE))]
        parts += [_voted(p).withColumn("model", F.lit(name)) for p, name in ((plain, VOTE), (smoted, VOTE_SMOTE))]
        with ThreadPoolExecutor(self.k) as pool:
            parts += [p.withColumn("model", F.lit(STACK)) for p in pool.map(self._stacked, range(self.k))]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return cv_metrics(every, ["model"]).select("model", *METRICS)

    def scorer(self, name: str, left: tuple[int, ...] = ()) -> Scorer:
        """ML11: the contender ``name`` trained on all rows but those of ``left`` (nothing, or the holdout): rows -> scored rows."""
        self.store.fit(self.needs(name, left))
        smote = name.endswith(SMOTE)
        members = self.members if name in (VOTE, VOTE_SMOTE, STACK) else [name.removesuffix(SMOTE)]
        one = {m: self.store.scorer(m, left, smote) for m in members}
        if len(members) == 1 and name != STACK and name not in (VOTE, VOTE_SMOTE):
            return one[members[0]]

        def gathered(df: DataFrame) -> DataFrame:
            parts = [s(df).select(F.col(ID_COL).cast("string").alias(ID_COL), F.lit(0).alias("fold"), "label", "score", F.lit(m).alias("member")) for m, s in one.items()]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out

        if name != STACK:
            return lambda df: _voted(gathered(df)).select(ID_COL, "label", "prediction", "score")
        scores = self.store.scores().where(~F.col("smote"))
        match = F.lit(False)
        for i in {*range(self.k), *self.hold} - set(left):
            match = match | ((F.col("fold") == i) & (F.col("left_out") == _text({i, *left})))
        meta = _meta(scores.where(match), self.store, self.members)

        def stacked(df: DataFrame) -> DataFrame:
            out = meta.transform(_wide(gathered(df), self.members))
            return _decided(out.select(ID_COL, "label", vector_to_array("probability")[1].alias("score")))
        return stacked


def race(mm: DataFrame, members: dict[str, Member], k: int = 5) -> DataFrame:
    """ML3 + ML7-ML10: model and cross-validated metrics of every contender."""
    return Race(mm, members, k).run()


def stacking_fit(mm: DataFrame, members: dict[str, Member], k: int = 5) -> Scorer:
    """ML9: stacking trained on ``mm``; rows -> scored rows."""
    r = Race(mm, members, k)
    r.store.fit([(m, (i,), False) for m in members for i in range(k)] + [(m, (), False) for m in members])
    return r.scorer(STACK)
