"""Fits in lockstep: splits against exhaustive search, blocks against one block, restart, counts of fits."""

import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from churnlake.operators import boosting as bo
from churnlake.operators import models as mo

SMALL = bo.Params(7, depth=3, weight="weight")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 2, 400), rng.random(400), rng.integers(0, 5, 400)])
    y = (x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(0, 0.4, 400) > 0.4).astype(float)
    data = [(f"C{i:03d}", float(y[i]), 1.0 + i % 2, 2.0, i % 3, x[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(data, "customer_id string, label double, weight double, pos_weight double, fold int, a array<double>")
    return df.withColumn("features", array_to_vector("a")).drop("a").repartition(3).checkpoint()


def test_first_split_is_the_best_of_all(spark, rows):
    model = mo.FitStore(rows, {"one": bo.Params(1, depth=1)}).fit([("one", (0,), False)]).models["one", (0,), False]
    got = rows.where("fold <> 0").collect()
    x, y = np.array([r.features.toArray() for r in got]), np.array([r.label for r in got])
    grad, curve = 0.5 - y, np.full(len(y), 0.25)
    score = lambda m: grad[m].sum() ** 2 / (curve[m].sum() + 1)
    best = max(score(x[:, f] <= c) + score(x[:, f] > c) for f, edges in enumerate(model.edges) for c in edges)
    node = model.nodes(spark).where("node = 0").first()
    low = x[:, node.feature] <= node.threshold
    assert score(low) + score(~low) == pytest.approx(best) and node.gain == pytest.approx((best - score(np.ones(len(y), bool))) / 2)
    leaf = {r.node: r.value for r in model.nodes(spark).where("feature is null").collect()}
    assert leaf[node.left] == pytest.approx(-0.1 * grad[low].sum() / (curve[low].sum() + 1))


@pytest.mark.parametrize("params", [SMALL, bo.Params(5, depth=4, l2=0, cols="sqrt", forest=True), bo.Params(6, depth=6, leaves=7, rows=0.7, cols=0.6, min_rows=9, l1=0.1, gain=0.01)])
def test_blocks_and_one_block_grow_the_same_trees(spark, rows, params):
    fits = [bo.Fit("m", params, (i,)) for i in range(3)]
    data, edges = rows.withColumn("made", F.lit(-1)), bo.edges_of(rows)
    one, many = bo.Lockstep(data, fits, edges).run(), bo.Lockstep(data, fits, edges, block_rows=60).run()
    assert one.one_block and not many.one_block and one.passes < many.passes
    a, b = ({(r.left_out, r.customer_id): r.score for r in s.scores().collect()} for s in (one, many))
    assert len(a) == 400 and a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    for t in many.trees[0]:
        assert sum(f < 0 for f in t.feature) <= params.leaves


def test_scores_are_those_of_the_trees(spark, rows):
    store = mo.FitStore(rows, {"m": SMALL}).fit([("m", (1,), False)])
    held = {r.customer_id: r.score for r in store.scores().collect()}
    again = {r.customer_id: r.score for r in store.scorer("m", (1,))(rows.where("fold = 1")).collect()}
    assert held.keys() == again.keys() and all(held[k] == pytest.approx(again[k]) for k in held)


def test_a_restarted_driver_goes_on_from_the_saved_round(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(bo, "SAVE_EVERY", 3)
    data, edges, fits = rows.withColumn("made", F.lit(-1)), bo.edges_of(rows), [bo.Fit("m", SMALL, (i,)) for i in range(3)]
    bo.Lockstep(data, fits, edges, store=f"{tmp_path}/a").run(rounds=4)  # saved after 3 and, on leaving, 4 rounds
    again, whole = bo.Lockstep(data, fits, edges, store=f"{tmp_path}/a").run(), bo.Lockstep(data, fits, edges).run()
    assert again.rounds_run < SMALL.rounds == whole.rounds_run
    a, b = ({(r.left_out, r.customer_id): r.score for r in s.scores().collect()} for s in (again, whole))
    assert all(a[k] == pytest.approx(b[k]) for k in b)


def test_the_race_makes_each_fit_once_and_finds_them_again(spark, rows, tmp_path):
    members = {"a": SMALL, "b": bo.Params(4, depth=2)}
    mm = rows.drop("fold")
    race = mo.Race(mm, members, k=4, folder=f"{tmp_path}/race")
    out = {r.model for r in race.run().collect()}
    assert out == {"a", "b", "a + SMOTE", "b + SMOTE", mo.VOTE, mo.VOTE_SMOTE, mo.STACK}
    # per member: 4 folds, 4 with SMOTE, 6 pairs; fitting stacking's inner folds apart would take 4 * 3 more instead of 6
    assert race.store.n_fits == 2 * (4 + 4 + 6) == len(race.wanted())
    before = race.store.n_fits
    race.run()
    assert race.store.n_fits == before
    assert race.scorer(mo.STACK)(mm).count() == 400 and race.store.n_fits == before + 2  # the members on all rows


def test_nested_stacking_sees_neither_fold(spark, rows):
    race = mo.Race(rows.drop("fold"), {"a": SMALL}, k=3)
    race.store.fit(race.wanted())
    got = Counter((r.left_out, r.fold) for r in race.store.scores().where("not smote").select("left_out", "fold").distinct().collect())
    assert set(got) == {(str(i), i) for i in range(3)} | {(f"{i},{j}", k) for i in range(3) for j in range(i + 1, 3) for k in (i, j)}


def test_split_counts_equal_a_count_over_the_trees(spark, rows):
    model = mo.FitStore(rows, {"m": bo.Params(9, depth=4, leaves=6)}).fit([("m", (), False)]).models["m", (), False]
    count = Counter(f for t in model.trees for f in t.feature if f >= 0)
    names = ["w", "x", "y", "z"]
    got = {r.feature: r for r in mo.split_importances(model, names, spark).collect()}
    assert {n: got[n].splits for n in names} == {n: count.get(i, 0) for i, n in enumerate(names)}
    assert all(got[n].importance == pytest.approx(count.get(i, 0) / sum(count.values())) for i, n in enumerate(names))
    gains = {r.feature: r.importance for r in mo.split_importances(model, names, spark, by="gain").collect()}
    assert sum(gains.values()) == pytest.approx(1)


def test_search_scores_smaller_round_counts_from_the_same_fits(spark, rows, monkeypatch):
    monkeypatch.setattr(bo, "SAVE_EVERY", 4)
    space = {"rounds": ("int", 10, 12), "depth": ("int", 2, 3), "rate": ("logfloat", 0.1, 0.3)}
    trials = mo.random_search(rows.drop("fold"), "gbt_a", n_trials=2, k=3, space=space).collect()
    assert [r.trial for r in sorted(trials, key=lambda r: r.trial)] == [0, 1]
    for r in trials:
        p = mo.tuned("gbt_a", r.params)
        assert p.weight == "pos_weight" and 1 <= r.staged_rounds <= p.rounds and 0 <= r.f1 <= 1
        # the staged score is that of a fit with so many rounds
        shorter = bo.replace(p, rounds=r.staged_rounds)
        oof = mo.cross_val_predict(bo.replace(shorter), mo.fold_matrix(rows.drop("fold"), 3), 3)
        n = oof.agg(F.count_if((F.col("prediction") == 1) & (F.col("label") == 1)).alias("tp"), F.count_if(F.col("prediction") != F.col("label")).alias("wrong")).first()
        assert r.staged_f1 == pytest.approx(2 * n.tp / (2 * n.tp + n.wrong), abs=2e-6)


def test_without_rows_or_with_one_class(spark, rows):
    one = rows.where("label = 1")
    out = mo.cross_val_predict(SMALL, one, 3).collect()
    assert len(out) == one.count() and all(r.score > 0.5 for r in out)
    assert mo.cross_val_predict(SMALL, rows.limit(0), 3).count() == 0


def test_trees_of_a_forest_take_a_level_together(spark, rows):
    forest = bo.Params(12, depth=4, l2=0, cols="sqrt", forest=True)
    data, edges = rows.withColumn("made", F.lit(-1)), bo.edges_of(rows)
    fits = [bo.Fit("m", forest, (i,)) for i in range(2)]
    one, many = bo.Lockstep(data, fits, edges).run(), bo.Lockstep(data, fits, edges, block_rows=60).run()
    assert many.passes <= forest.depth  # a job a level, not one a tree and level
    assert [[(t.feature, t.cut) for t in f] for f in one.trees] == [[(t.feature, t.cut) for t in f] for f in many.trees]


@pytest.mark.parametrize("params", [bo.Params(3, depth=7, l2=0.0), bo.Params(3, depth=7, l2=0.0, forest=True, cols="all"), bo.Params(3, depth=7, l2=0.0, forest=True, cols="sqrt", weight="weight")])
def test_sums_of_some_nodes_at_a_time_and_by_difference_give_the_same_tree(params, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, n, 500) for n in (7, 2, 12, 2, 9)]).astype(np.uint8)
    block = {"x": x, "y": (x[0] + rng.normal(0, 2, 500) > 3).astype(float), "weight": 1 + rng.random(500), "fold": rng.integers(0, 3, 500), "made": np.full(500, -1), "hash": rng.integers(0, 1 << 62, 500).astype(np.uint64)}
    starts, fit = np.array([0, 7, 9, 21, 23, 32]), bo.Fit("m", params, (0,))

    def grown():
        margin = np.zeros(500)
        return [len(t.feature) for t in bo._grow_here(block, margin, fit, -2, 0, 3, starts)], margin

    sizes, whole = grown()
    monkeypatch.setattr(bo, "CELLS", 100)  # three nodes at a time, no differences
    again, parts = grown()
    assert again == sizes and min(sizes) > 20 and parts == pytest.approx(whole, abs=1e-9)


@pytest.mark.parametrize("packs", [(1024, 64), (40, 8)])
def test_features_met_in_one_code_give_the_sums_of_each(packs, monkeypatch):
    monkeypatch.setattr(bo, "PACKS", packs)
    rng, sizes = np.random.default_rng(5), [2] * 20 + [32, 5, 31, 1, 9, 32]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    x = np.stack([rng.integers(0, n, 3000) for n in sizes]).astype(np.uint8)
    use, grad, curve = np.sort(rng.choice(3000, 2500, False)), rng.normal(size=2500), rng.random(2500)
    for n_open in (1, 2, 300):  # many and few rows a node
        packed, slot = bo.Packed(x, starts), rng.integers(0, n_open, 2500)
        got = bo._sums(packed, use, grad, curve, slot, n_open)
        want = np.zeros_like(got)
        for f in range(len(sizes)):
            for k, v in enumerate((grad, curve, np.ones(2500))):
                np.add.at(want[k], (slot, starts[f] + x[f, use]), v)
        assert got == pytest.approx(want, abs=1e-9) and (got[2] == want[2]).all()
    assert len(bo.Packed(x, starts).codes(packs[0])) < len(sizes) / 3  # not a count a feature


def test_a_fit_is_one_block_with_its_own_smote_rows(spark, rows):
    data = rows.withColumn("made", F.lit(-1))
    for i in range(3):
        data = data.unionByName(rows.where("label = 1").limit(90).withColumns({"customer_id": F.lit(None).cast("string"), "fold": F.lit(-1), "made": F.lit(i)}))
    data, edges = data.checkpoint(), bo.edges_of(rows)
    fits, made = [bo.Fit("m", SMALL, (i,), s) for i in range(3) for s in (False, True)], {(i,): i for i in range(3)}
    one, many = (bo.Lockstep(data, fits, edges, made, block_rows=n).run() for n in (500, 60))
    assert data.count() == 670 and one.one_block and one.passes == 1 and not many.one_block  # 490 rows a fit, not 670
    a, b = ({(r.left_out, r.smote, r.customer_id): r.score for r in s.scores().collect()} for s in (one, many))
    assert len(a) == 800 and a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    assert sum(a[k] != a[k[0], False, k[2]] for k in a if k[1]) > 200  # the sets are seen


def test_trees_are_saved_by_their_tasks_and_once(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(bo, "SAVE_EVERY", 3)
    data, edges, fits = rows.withColumn("made", F.lit(-1)), bo.edges_of(rows), [bo.Fit("m", SMALL, (i,)) for i in range(2)]
    kept, stored = bo.Lockstep(data, fits, edges).run(), bo.Lockstep(data, fits, edges, store=f"{tmp_path}/a").run()
    assert stored.trees == [[], []]  # nothing at the driver
    sizes = [[len(bo.pickle.loads(r.trees)) for r in spark.read.parquet(f"{tmp_path}/a/trees-{n:05d}").collect()] for n in (3, 6, 7)]
    assert sizes == [[3, 3], [3, 3], [1, 1]]  # each round in one folder
    assert stored.model("m", (1,)).trees == kept.model("m", (1,)).trees and len(kept.trees[1]) == 7
    again = bo.Lockstep(data, fits, edges, store=f"{tmp_path}/a").run()
    assert again.rounds_run == 0
    a, b = ({(r.left_out, r.customer_id): r.score for r in s.scores().collect()} for s in (again, kept))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in b)


@pytest.mark.parametrize("params", [bo.Params(1, depth=6, leaves=8, rate=0.5), bo.Params(1, depth=6, rate=0.5)])
def test_no_sums_are_asked_for_when_no_leaves_are_left(params):
    growth, asked = bo.grow(params), 0
    step = next(growth)
    while True:
        n_open, asked = int(step[2].max()) + 1, asked + 1
        try:  # every open node has a split
            step = growth.send(np.tile([0.0, 3, 1, 2, 40, 512, 1, 80, 1024], (n_open, 1)))
        except StopIteration as done:
            tree = done.value
            break
    leaves = sum(f < 0 for f in tree.feature)
    assert (asked, leaves) == ((3, 8) if params.leaves == 8 else (6, 64))


def test_columns_derived_from_one_another_share_a_group_of_codes():
    rng, sizes = np.random.default_rng(6), [32, 2, 2, 2, 2, 32, 5, 2]
    a, b = rng.integers(0, 32, 6000), rng.integers(0, 32, 6000)
    x = np.stack([a, *[a // 8 == k for k in range(4)], b, b % 5, rng.integers(0, 2, 6000)]).astype(np.uint8)
    x[:, 5999] = [0, 1, 1, 1, 1, 0, 4, 1]  # codes of one row only
    starts = np.concatenate([[0], np.cumsum(sizes)])
    packed, use, slot = bo.Packed(x, starts), np.arange(6000), rng.integers(0, 2, 6000)
    assert sorted(len(has) for _, has in packed.groups)[-2:] <= [bo.GROUP] * 2 and len(packed.groups) == 3 and len(packed.codes(2048)) == 2
    got, want = bo._sums(packed, use, a * 0.5, b * 0.25, slot, 2), np.zeros((3, 2, starts[-1]))
    for f in range(len(sizes)):
        for k, v in enumerate((a * 0.5, b * 0.25, np.ones(6000))):
            np.add.at(want[k], (slot, starts[f] + x[f]), v)
    assert got == pytest.approx(want)


def test_a_fit_of_a_million_rows_is_one_block(spark):
    n = 1_155_040  # the train rows at 1 GB and the SMOTE rows of four of five folds
    row = [F.lit(1.0).alias(c) for c in ("label", "weight", "pos_weight")]
    data = spark.range(n).select(F.col("id").cast("string").alias("customer_id"), *row, array_to_vector(F.array(F.lit(0.0))).alias("features"), F.lit(0).alias("fold"), F.lit(-1).alias("made"))
    assert bo.Lockstep(data, [bo.Fit("m", SMALL, (0,))], []).one_block  # not a job a tree level


@pytest.mark.parametrize("weights, alike", [([1.0, 2.0], True), (np.linspace(1, 2, 500), False)])
def test_large_nodes_are_summed_in_pieces(weights, alike, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, n, 3000) for n in (32, 2, 12, 5)]).astype(np.uint8)
    y, w = rng.integers(0, 2, 3000).astype(float), rng.choice(weights, 3000)
    starts, use = np.array([0, 32, 34, 46, 51]), np.concatenate([np.arange(2000), np.arange(2000, 3000, 2)])
    sizes, columns = np.array([2000, 3, 450, 47]), np.array([[0, 2], [1, 3], [0, 1], [2, 3]])
    copies = bo._copies(rng.integers(0, 1 << 62, 3000).astype(np.uint64), 5, 1)
    known = bo._kinds(w, y)
    assert (known is not None) == alike
    kinds = (known[0] + copies * np.int64(bo.BINS), known[1]) if alike else None
    both, node, got = bo._both(-w * copies * y, w * copies), np.repeat(np.arange(4), sizes), []
    for rows in (1 << 20, 64):
        monkeypatch.setattr(bo, "ROWS", rows)
        made = []
        monkeypatch.setattr(bo.np, "bincount", lambda place, *a, real=np.bincount, **k: made.append(len(place)) or real(place, *a, **k))
        got.append((bo._node_sums(bo.Packed(x, starts), use, both, sizes), bo._drawn_sums(x, use, both, sizes, columns, kinds)))
        monkeypatch.undo()
    assert max(made[-50:]) <= 64
    for every, drawn in got:
        for k, v in enumerate((both.real, both.imag, np.ones(3000))):
            want = np.zeros((4, 51))
            for f in range(4):
                np.add.at(want, (node, starts[f] + x[f, use]), v[use])
            assert every[k] == pytest.approx(want)
            for n in range(4):
                for j, f in enumerate(columns[n]):
                    assert drawn[k, n, j * bo.BINS:j * bo.BINS + starts[f + 1] - starts[f]] == pytest.approx(want[n, starts[f]:starts[f + 1]])


def test_compared_learners_run_side_by_side(spark, rows, monkeypatch):
    both, run = threading.Barrier(2, timeout=60), bo.Lockstep.run

    def waits(self):
        both.wait()
        return run(self)

    monkeypatch.setattr(bo.Lockstep, "run", waits)
    got = mo.compare_models(rows.drop("fold"), k=3, ls={"a": SMALL, "b": bo.Params(4, depth=2)}).collect()
    assert sorted(r.model for r in got) == ["a", "b"] and all(r.seconds > 0 for r in got)
    monkeypatch.undo()
    alone = {r.model: r for name in "ab" for r in mo.compare_models(rows.drop("fold"), [name], k=3, ls={"a": SMALL, "b": bo.Params(4, depth=2)}).collect()}
    assert all(r[c] == alone[r.model][c] for r in got for c in mo.METRICS)


@pytest.mark.parametrize("few", [False, True])
def test_rows_fall_to_the_leaves_they_walk_to(few):
    rng = np.random.default_rng(8)
    x, tree = rng.integers(0, 9, (3, 900)).astype(np.uint8), bo.Tree([0, 1, -1, -1, -1], [4, 2, 0, 0, 0], [1, 3, 0, 0, 0], [0.0] * 5, [0.0] * 5).arrays()
    some, leaf = np.arange(0, 100 if few else 900, 2), np.full(900, -1)
    bo._fall(x, tree, 2, some, leaf)
    assert (leaf[some] == bo.walk(x, tree, 2)[some]).all() and (leaf[some] > 1).all() and (leaf[1::2] == -1).all()


def test_a_fit_keeps_what_it_needs_of_its_rows(spark, rows):
    data, edges, fit = rows.withColumn("made", F.lit(-1)), bo.edges_of(rows), bo.Fit("m", SMALL, (1,))
    grown = bo.Lockstep(data, [fit], edges)
    (_, kept), = grown.rows.collect()
    block = bo._joined(bo._blocks(data, edges, 1000).collect())
    assert "x" not in kept and "pos_weight" not in kept and (kept["weight"] == block["weight"]).all()
    assert (bo.ungrouped(*kept["groups"], grown.starts) == block["x"]).all()
    assert kept["id"].to_pylist() == [i if f == 1 else None for i, f in zip(block["id"].to_pylist(), block["fold"], strict=True)]
