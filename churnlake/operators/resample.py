"""SMOTE oversampling (ML6) and the in-fold resampling helper (ML7).

Neighbour search is exact k-nearest-neighbours among minority rows, by
pivots and distance bounds instead of an all-pairs join:

* at most ``MAX_PIVOTS`` rows, drawn by hash, are pivots; every row belongs
  to the cell of its nearest pivot, a cell over ``block_rows`` rows is dealt
  into several blocks by hash (so equal rows cannot crowd one task);
* the k nearest inside a row's own block bound its search radius;
* by the triangle inequality only cells whose pivot is nearer than the
  radius plus the cell's extent can hold a closer row: the row is sent to
  those blocks only, and the k best of all blocks are kept;
* the rows sent to a block are counted first and dealt by hash into query
  blocks of about ``block_rows``; each meets its own copy of the reference
  block, so both sides of a comparison stay bounded when nothing is pruned.

No candidate is dropped by count, the result equals brute force. Rows are
copied only to the blocks that the bounds cannot rule out.

Synthesis is deterministic and distributed: each minority row (ranked
inside the class by hash, see folds.class_rank) creates either
floor(need / m) or that plus one synthetic rows; neighbour choice and the
interpolation gap come from hashes of (seed, row, copy), so a recomputed
task reproduces exactly the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, IntegralType, StructField, StructType

from ..session import ensure_checkpoint_dir
from .folds import class_rank

DEFAULT_BLOCK_ROWS = 2048
MAX_PIVOTS = 4096
BROADCAST_BLOCKS = 500_000
#: Distances of a Python worker at once (rows by pivots), and rows of a frame it hands out.
DISTANCES, SENT_ROWS = 1 << 20, 4096


def _to_pivots(v, pivots) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all pivots) of some rows of the column ``v`` at a time: a worker's memory depends neither on the
    number of pivots nor on the rows of a batch."""
    step = max(1, DISTANCES // max(1, len(pivots)))
    norm = (pivots * pivots).sum(1)[None, :]
    for lo in range(0, len(v), step):
        a = np.stack(v[lo:lo + step]).astype(float)
        d2 = (a * a).sum(1)[:, None] + norm - 2.0 * a @ pivots.T
        yield lo, np.sqrt(np.maximum(d2, 0.0, out=d2), out=d2)


def _targets(f, pivots, extent, blocks) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, cell, part) of the blocks that may hold a closer row than the radius, the own block left out; some rows at a time."""
    reach = f["radius"].to_numpy() * (1 + 1e-9) + 1e-9
    cell, own = f["cell"].to_numpy(), f["part"].to_numpy()
    for lo, d in _to_pivots(f["v"].to_numpy(), pivots):
        i, c = np.nonzero(d - extent[None, :] * (1 + 1e-9) <= reach[lo:lo + len(d), None])
        n = blocks[c]
        i, c = np.repeat(i, n) + lo, np.repeat(c, n)
        part = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        keep = (c != cell[i]) | (part != own[i])
        yield i[keep], c[keep], part[keep]


def _sent(f, pivots, extent, blocks) -> Iterator[pd.DataFrame]:
    """The rows copied to other blocks, at most ``SENT_ROWS`` copies a frame."""
    reach = f["radius"].to_numpy() * (1 + 1e-9) + 1e-9
    for rows, cells, parts in _targets(f, pivots, extent, blocks):
        for lo in range(0, len(rows), SENT_ROWS):
            i, c, part = rows[lo:lo + SENT_ROWS], cells[lo:lo + SENT_ROWS], parts[lo:lo + SENT_ROWS]
            yield pd.DataFrame({"id": f["id"].to_numpy()[i], "v": f["v"].to_numpy()[i], "cell": c.astype("int32"),
                                "part": part.astype("int32"), "radius": reach[i]})


def _nearest(qid, qa, rid, ra, k: int):
    """(row of q, row of r, distance) of the k rows of r nearest to each row
    of q, itself excluded; r sorted by id, so ties go to the smaller id."""
    rows_q, rows_r, dist = [], [], []
    norm = (ra * ra).sum(1)
    for lo in range(0, len(qa), 512):
        part = qa[lo:lo + 512]
        d2 = np.maximum((part * part).sum(1)[:, None] + norm[None, :] - 2.0 * part @ ra.T, 0.0)
        d2[qid[lo:lo + 512][:, None] == rid[None, :]] = np.inf
        near = np.argsort(d2, axis=1, kind="stable")[:, :k]
        i = np.repeat(np.arange(len(part)), near.shape[1])
        j = near.ravel()
        keep = np.isfinite(d2[i, j])
        i, j = i[keep], j[keep]
        rows_q.append(i + lo)
        rows_r.append(j)
        dist.append(np.sqrt(((part[i] - ra[j]) ** 2).sum(1)))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(rows_q, int), cat(rows_r, int), cat(dist, float)


def knn_within(df: DataFrame, id_col: str, vec_col: str, k: int = 5, block_rows: int = DEFAULT_BLOCK_ROWS,
               n_rows: int | None = None) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, self excluded) of every row of
    ``df`` among the rows of ``df``: (id, nb_id, dist, nb_rank)."""
    ensure_checkpoint_dir(df.sparkSession)
    id_type = df.schema[id_col].dataType
    if not isinstance(id_type, IntegralType):
        # numbers in id order stand for the ids: ties still go to the smaller id, and no two rows share a number
        named = df.select(F.col(id_col).alias("_name"), F.col(vec_col).alias("_vec")).orderBy("_name").checkpoint(eager=True)
        named = named.withColumn("_n", F.monotonically_increasing_id()).checkpoint(eager=True)
        near = knn_within(named, "_n", "_vec", k, block_rows, n_rows)
        name = lambda c: named.select(F.col("_n").alias(c), F.col("_name").alias(f"{c}_name"))
        near = near.join(name("id"), "id").join(name("nb_id"), "nb_id")
        return near.select(F.col("id_name").alias("id"), F.col("nb_id_name").alias("nb_id"), "dist", "nb_rank")
    x = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    m = n_rows if n_rows is not None else x.count()
    n_pivots = max(1, min(MAX_PIVOTS, math.ceil(4 * m / block_rows)))
    picked = x.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()  # at most MAX_PIVOTS rows
    pivots = np.array([r["v"] for r in picked], float).reshape(len(picked), -1)
    row = [StructField("id", id_type), StructField("v", ArrayType(DoubleType())), StructField("cell", IntegerType())]

    def assign(frames):
        for f in frames:
            if len(f):
                near = [(d.argmin(1), d.min(1)) for _, d in _to_pivots(f["v"].to_numpy(), pivots)]
                f["cell"] = np.concatenate([c for c, _ in near]).astype("int32")
                f["away"] = np.concatenate([a for _, a in near])
                yield f[["id", "v", "cell", "away"]]

    rows = x.mapInPandas(assign, StructType([*row, StructField("away", DoubleType())])).checkpoint(eager=True)
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("extent")).collect()  # one per pivot
    extent = np.full(len(pivots), -np.inf)
    blocks = np.ones(len(pivots), int)
    for c in cells:
        extent[c["cell"]], blocks[c["cell"]] = c["extent"], math.ceil(c["n"] / block_rows)
    parts = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1) if len(blocks) <= 512 else \
        F.create_map(*[F.lit(int(v)) for i, b in enumerate(blocks) for v in (i, b)])[F.col("cell")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    found = StructType([StructField("id", id_type), StructField("nb_id", id_type), StructField("dist", DoubleType())])

    def search(q: pd.DataFrame, r: pd.DataFrame, radius=None) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"id": [], "nb_id": [], "dist": []})
        r = r.sort_values("id", ignore_index=True)
        qid, rid = q["id"].to_numpy(), r["id"].to_numpy()
        i, j, d = _nearest(qid, np.stack(q["v"].to_numpy()).astype(float), rid, np.stack(r["v"].to_numpy()).astype(float), k)
        if radius is not None:
            keep = d <= q["radius"].to_numpy()[i]
            i, j, d = i[keep], j[keep], d[keep]
        return pd.DataFrame({"id": qid[i], "nb_id": rid[j], "dist": d})

    own = rows.groupBy("cell", "part").applyInPandas(lambda g: search(g, g), found).checkpoint(eager=True)
    bound = own.groupBy("id").agg(F.count(F.lit(1)).alias("got"), F.max("dist").alias("kth"))
    bound = bound.select("id", F.when(F.col("got") >= k, F.col("kth")).otherwise(F.lit(float("inf"))).alias("radius"))
    asked = rows.join(bound, "id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))

    def send(frames):
        for f in frames:
            if len(f):
                yield from _sent(f, pivots, extent, blocks)

    before = np.cumsum(blocks) - blocks

    def count_sent(frames):
        n = np.zeros(int(blocks.sum()), np.int64)
        for f in frames:
            if len(f):
                for _, c, part in _targets(f, pivots, extent, blocks):
                    n += np.bincount(before[c] + part, minlength=len(n))
        at = np.flatnonzero(n)
        cell = np.searchsorted(before, at, "right") - 1
        yield pd.DataFrame({"cell": cell.astype("int32"), "part": (at - before[cell]).astype("int32"), "n": n[at]})

    asked = asked.select("id", "v", "cell", "part", "radius").checkpoint(eager=True)
    sent = asked.mapInPandas(count_sent, "cell int, part int, n long").groupBy("cell", "part") \
        .agg(F.ceil(F.sum("n") / block_rows).cast("int").alias("q_blocks")).checkpoint(eager=True)  # one row per block
    sent = F.broadcast(sent) if sent.count() <= BROADCAST_BLOCKS else sent
    queries = asked.mapInPandas(
        send, StructType([*row, StructField("part", IntegerType()), StructField("radius", DoubleType())]))
    queries = queries.join(sent, ["cell", "part"]) \
        .withColumn("q", F.pmod(F.xxhash64(F.lit("query"), "id"), F.col("q_blocks")).cast("int")).drop("q_blocks")
    blocks_of = rows.select("id", "v", "cell", "part").join(sent, ["cell", "part"]) \
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).drop("q_blocks")
    key = ["cell", "part", "q"]
    more = queries.groupBy(*key).cogroup(blocks_of.groupBy(*key)) \
        .applyInPandas(lambda q, r: search(q, r, "radius"), found)
    w = Window.partitionBy("id").orderBy("dist", "nb_id")
    return own.unionByName(more).withColumn("nb_rank", F.row_number().over(w)).filter(F.col("nb_rank") <= k)


def _u01(*cols) -> F.Column:
    """Deterministic uniform [0, 1) from a hash of the given columns."""
    h = F.xxhash64(*cols)
    return (F.abs(h % F.lit(1 << 30)).cast("double")) / float(1 << 30)


def smote(df: DataFrame, features_col: str = "features", label_col: str = "label", id_col: str = "row_id",
          k: int = 5, seed: int = 42, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """ML6: synthetic minority rows until both classes have the majority
    count: base + u * (neighbour - base), neighbour one of the k nearest
    minority rows. Returns only the synthetic rows (id NULL, is_synthetic
    true); union them with the input (SO5) to train.

    ``df`` needs a unique ``id_col``, a vector ``features_col`` and a 0/1
    ``label_col``. Class counts are one small aggregate (collected: two
    numbers)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    counts = {r[label_col]: r["n"] for r in df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df.limit(0).withColumn("is_synthetic", F.lit(True))
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    m, need = counts[minority], counts[majority] - counts[minority]
    schema_cols = df.columns
    if need <= 0 or m < 2:
        return df.limit(0).withColumn("is_synthetic", F.lit(True))
    mino = df.filter(F.col(label_col) == minority).select(
        F.col(id_col).alias("_id"), vector_to_array(F.col(features_col)).alias("_a"))
    nn = knn_within(mino, "_id", "_a", k, block_rows, n_rows=m)
    ranked = class_rank(mino.withColumn("_c", F.lit(0)), key="_id", label="_c", seed=seed, out="_r").drop("_c")
    per, extra = need // m, need % m
    base = ranked.withColumn("_n", F.lit(per) + F.when(F.col("_r") < extra, 1).otherwise(0)) \
        .filter(F.col("_n") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    kk = min(k, m - 1)
    base = base.withColumn("_pick", (F.floor(_u01(F.lit(seed), F.col("_id"), F.col("_copy"), F.lit(1)) * kk) + 1)
                           .cast("int"))
    base = base.withColumn("_gap", _u01(F.lit(seed), F.col("_id"), F.col("_copy"), F.lit(2)))
    pick = nn.select(F.col("id").alias("_id"), F.col("nb_rank").alias("_pick"), F.col("nb_id").alias("_nb"))
    nbv = mino.select(F.col("_id").alias("_nb"), F.col("_a").alias("_b"))
    syn = base.join(pick, ["_id", "_pick"]).join(nbv, "_nb")
    vec = F.zip_with("_a", "_b", lambda a, b: a + F.col("_gap") * (b - a))
    out = syn.select(array_to_vector(vec).alias(features_col))
    cols = []
    for c in schema_cols:
        if c == features_col:
            cols.append(F.col(features_col))
        elif c == label_col:
            cols.append(F.lit(minority).cast(df.schema[label_col].dataType).alias(label_col))
        else:
            cols.append(F.lit(None).cast(df.schema[c].dataType).alias(c))
    return out.select(*cols, F.lit(True).alias("is_synthetic"))


def oversample(df: DataFrame, **kw) -> DataFrame:
    """SO5: the input rows plus their SMOTE rows (``is_synthetic`` flag)."""
    syn = smote(df, **kw)
    return df.withColumn("is_synthetic", F.lit(False)).unionByName(syn)
