"""Spherical-cap filters against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from churnlake.llm import capfilter

SCHEMA = "vec_id long, embedding array<float>, label int"


def truth(x, ids):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = dict(zip(ids, ids))
    for _ in ids:
        new = {a: min([comp[a], *(comp[ids[j]] for j in np.flatnonzero(near[i]))]) for i, a in enumerate(ids)}
        if new == comp:
            break
        comp = new
    return dict(zip(ids, near.sum(1).tolist())), comp


def rows(spark, x, more=()):
    return spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + list(more), SCHEMA).repartition(5)


def test_links_and_classes(spark, monkeypatch):
    monkeypatch.setattr(capfilter, "BLOCK", 32)  # several blocks a direction
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24)).astype(np.float32)
    x[100:220] = x[0] + 0.12 * rng.normal(size=(120, 24))
    x[300] = x[301] = x[302]
    x[303] = 2 * x[302]
    odd = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 24, 0), (9004, [float("nan")] + [1.0] * 23, 0), (9005, [None] + [1.0] * 23, 0), (9006, [float("inf")] * 24, 0), (9007, [1.0, 2.0], 0), (9008, [2.0, 4.0], 0)]
    got = {r.vec_id: r for r in capfilter.near_duplicates(rows(spark, x, odd)).collect()}
    n, comp = truth(x.astype(np.float64), list(range(len(x))))
    found, true = sum(got[i].n_links for i in n), sum(n.values())
    assert all(got[i].n_links <= n[i] for i in n) and found >= 0.99 * true
    assert np.mean([got[i].component_id == comp[i] for i in n]) > 0.995
    assert got[303].n_links == 3 and got[9007].n_links == got[9008].n_links == 1 and got[9008].component_id == 9007 and not got[9008].kept
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(9001, 9007))


def test_empty(spark):
    assert capfilter.near_duplicates(spark.createDataFrame([], SCHEMA).withColumn("links", F.lit(1))).count() == 0


def test_anisotropic_pairs_at_the_threshold(spark):
    """Pairs just over the threshold are found, also where half of the components is zero or the components decay."""
    rng = np.random.default_rng(8)
    for scale in (np.repeat([1.0, 0.0], 32), 0.85 ** np.arange(64)):
        u = rng.normal(size=(3000, 64)) * scale
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w = rng.normal(size=(300, 64)) * scale
        w -= (w * u[:300]).sum(1, keepdims=True) * u[:300]
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        x = np.concatenate([u, 0.952 * u[:300] + np.sqrt(1 - 0.952**2) * w]).astype(np.float32)
        n, comp = truth(x.astype(np.float64), list(range(len(x))))
        got = {r.vec_id: r for r in capfilter.near_duplicates(rows(spark, x)).collect()}
        assert all(got[i].n_links <= n[i] for i in n) and sum(got[i].n_links for i in n) >= 0.995 * sum(n.values())
        assert np.mean([got[i].component_id == comp[i] for i in n]) >= 0.995


def test_huge_and_tiny_components(spark):
    """Finite components whose squares overflow or vanish link like any others."""
    a = [1.0, 2.0, 3.0, 0.0]
    made = [(i, [v * s for v in a], 0) for i, s in enumerate([1.0, 1e200, 1e300, 1e-200, 1e-310])] + [(9, [3e200, -2e200, 0.0, 1e200], 0)]
    got = {r.vec_id: r for r in capfilter.near_duplicates(spark.createDataFrame(made, SCHEMA.replace("float", "double"))).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(5)] == [(4, 0)] * 5 and (got[9].n_links, got[9].kept) == (0, True)
