"""Operator 8: embedding near-dedup with spherical-cap filters.

Vectors are turned by a fixed random rotation, so that no pair of them is special, however the components are distributed.
Filter directions are a structured random product code: the turned coordinates are cut into two blocks, each with its own random
unit codewords, and every pair of codewords is a direction. A vector is list-decoded to its ``take`` best directions, always as
many: with the codewords of both blocks sorted by score, the k best pairs lie under a hyperbola. Vectors that share a
direction are compared exactly, in double precision.

The code grows with the number of vectors n of a length. ``take`` is found from ``MISS``, the rate at which pairs just at the threshold
may share no direction: the rule is tried on ``PROBES`` random pairs with the code in use, which stand for any pair because of
the rotation; it is never under ``LISTS`` and grows with n. Nothing is capped. A length that the code cannot part (two or
three components), or with at most ``BUCKET`` vectors, has one direction, all its pairs are compared. A direction with more than ``BLOCK``
vectors is compared block by block, each pair of blocks being a task's group.

No pair leaves a group: a pair is counted at its smallest common direction, as a sum per vector, and a group sends a
spanning forest of its links. Equal vectors are one node with a weight.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length do not link; equal vectors link; repeated rows are vectors of their own, with one id they
share their results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, grouped, hash128, memo, small

THRESHOLD = 0.95
LISTS, BUCKET, BLOCK, LEAST_CODE, SEED = 32, 128, 2048, 24, 31
MISS, PROBES = 1e-4, 20_000


def code_size(n: int) -> int:
    """Codewords of each block for n vectors."""
    return max(LEAST_CODE, math.ceil(math.sqrt(n * LISTS / BUCKET)))


def _unit(rng: np.random.Generator, n: int, dim: int) -> np.ndarray:
    x = rng.normal(size=(n, max(dim, 1)))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@memo
def code(dim: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of both blocks as columns, turned back by the rotation (one block of a single coordinate shares its sign)."""
    rng = np.random.default_rng([SEED, dim, size])
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    cut_at = dim - dim // 2
    a, b = _unit(rng, size, cut_at), _unit(rng, size, dim // 2)
    return turn[:, :cut_at] @ a.T, turn[:, cut_at:] @ b.T if dim > 1 else np.zeros((dim, size))


def decode(x: np.ndarray, size: int, take: int) -> np.ndarray:
    """The ``take`` best directions of each unit vector, best first."""
    a, b = code(x.shape[1], size)
    left, right = x @ a, x @ b
    m = min(take, size)
    by_left, by_right = (np.argsort(-s, axis=1, kind="stable")[:, :m] for s in (left, right))
    left, right = np.take_along_axis(left, by_left, 1), np.take_along_axis(right, by_right, 1)
    # The pair of ranks (i, j) has (i + 1) (j + 1) - 1 pairs that score at least as much.
    i, j = np.nonzero(np.outer(np.arange(1, m + 1), np.arange(1, m + 1)) <= take)
    best = np.argsort(-(left[:, i] + right[:, j]), axis=1, kind="stable")[:, :take]
    return np.take_along_axis(by_left, i[best], 1) * size + np.take_along_axis(by_right, j[best], 1)


def needed(dim: int, size: int, threshold: float, most: int) -> int | None:
    """Directions a vector needs so that pairs at the threshold share none at a rate of ``MISS``; None if over ``most``."""
    rng = np.random.default_rng([SEED, dim, size, 1])
    need = []
    for _ in range(0, PROBES, 250):
        u, w = _unit(rng, 250, dim), rng.normal(size=(250, dim))
        w -= (w * u).sum(1, keepdims=True) * u
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
        v = threshold * u + math.sqrt(max(0.0, 1 - threshold**2)) * w
        for p, q in zip(decode(u, size, most), decode(v, size, most), strict=True):
            _, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
            need.append(np.maximum(i, j).min() + 1 if len(i) else most + 1)
    take = int(np.quantile(need, 1 - MISS, method="higher"))
    return take if take <= most else None


@memo
def plan(dim: int, n: int, threshold: float) -> tuple[int, int]:
    """(codewords of each block, directions of a vector) for n vectors of one length."""
    size, most = code_size(n), 2 * LISTS
    if n <= BUCKET or dim < 2:
        return 1, 1
    while most <= size**2 // 4:
        take = needed(dim, size, threshold, most)
        if take:
            return size, max(LISTS, take)
        most *= 2
    return 1, 1


def _unit_of(v: np.ndarray) -> np.ndarray:
    """``v`` at length 1, brought near 1 by a power of two first: exact, and squares neither overflow nor vanish."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max())[1])
    return v / np.linalg.norm(v)


def _rows(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of an array."""
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(lists: pa.ListArray) -> list[np.ndarray]:
    return [_unit_of(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)) for x in lists]


def _decoded(batches: Iterator[pa.RecordBatch], plans: dict[int, tuple[int, int]]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            units = _units(part["x"])
            dims = np.array([len(u) for u in units])
            found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(units)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i, f in zip(at, decode(np.stack([units[k] for k in at]), *plans[int(dim)]), strict=True):
                    found[i] = np.sort(f) + (int(dim) << 40)
            yield part, found


def _link_group(f: int, inner: bool, block: np.ndarray, low: int, node: np.ndarray, weight: np.ndarray, x: np.ndarray, lists: np.ndarray, threshold: float):
    """(nodes, links counted here, root in this group) of one group: all pairs of a block, or pairs across two blocks."""
    n = len(node)
    counted, parent = np.zeros(n, np.int64), np.arange(n)
    left = np.arange(n) if inner else np.flatnonzero(block == low)
    right = np.arange(n) if inner else np.flatnonzero(block != low)
    pairs = []
    for lo in range(0, len(left), 512):
        i, j = np.nonzero(x[left[lo:lo + 512]] @ x[right].T >= threshold)
        i, j = left[lo + i], right[j]
        keep = (i < j) if inner else np.ones(len(i), bool)
        keep &= node[i] != node[j]
        pairs.append((i[keep], j[keep]))
    i, j = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    if not len(i):
        return None
    # A pair counts here unless both have a smaller direction in common.
    rows = np.unique(np.concatenate([i, j]))
    smaller = lists[rows] < f
    names, inverse = np.unique(lists[rows][smaller], return_inverse=True)
    place = np.zeros(n, np.int64)
    place[rows] = np.arange(len(rows))
    seen = np.zeros((len(rows), max(1, len(names))), np.float32)
    seen[np.nonzero(smaller)[0], inverse] = 1
    for lo in range(0, len(i), 200_000):
        a, b = i[lo:lo + 200_000], j[lo:lo + 200_000]
        if len(a) > len(rows):
            before = (seen @ seen.T)[place[a], place[b]] > 0
        else:
            before = (seen[place[a]] * seen[place[b]]).any(1)
        np.add.at(counted, a[~before], weight[b[~before]])
        np.add.at(counted, b[~before], weight[a[~before]])
    while True:  # roots: the least row reached, by doubling
        old = parent.copy()
        np.minimum.at(parent, i, parent[j])
        np.minimum.at(parent, j, parent[i])
        parent = parent[parent]
        if (parent == old).all():
            break
    return node[rows], counted[rows], node[parent[rows]]


FOUND = "node long, links long, root long"


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, links, root): summed per node, the links of all groups; rows of a group's forest. ``nodes``: node, w, x."""
    lengths = nodes.groupBy(F.size("x").alias("dim")).count().collect()  # one row per length
    plans = {r["dim"]: plan(r["dim"], r["count"], threshold) for r in lengths}
    kind = nodes.schema["x"].dataType.simpleString()

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _decoded(batches, plans):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64))], ["f"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _decoded(batches, plans):
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            lists = pa.array([f.tolist() for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), part["node"].take(at), part["w"].take(at), part["x"].take(at), lists.take(at)], ["f", "node", "w", "x", "fs"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ("f", "lo", "hi")):
            if group.num_rows < 2:
                continue
            f, lo, hi = (group[c][0].as_py() for c in ("f", "lo", "hi"))
            # one direction has vectors of one length, each with as many directions
            x = _unit_rows(_rows(group["x"]).astype(np.float64))
            got = _link_group(f, lo == hi, group["block"].to_numpy(), lo, group["node"].to_numpy(), group["w"].to_numpy(), x, _rows(group["fs"]), threshold)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["node", "links", "root"])

    counts = nodes.mapInArrow(directions, "f long").groupBy("f").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK)
    big = cut(counts.select("f", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")))
    rows = nodes.mapInArrow(spread, f"f long, node long, w long, x {kind}, fs array<long>").join(small(big), "f", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
    rows = rows.select("f", "node", "w", "x", "fs", "block", F.explode(cells).alias("c")).select("f", "c.lo", "c.hi", "node", "w", "x", "fs", "block")
    return cut(rows.repartition("f", "lo", "hi").sortWithinPartitions("f", "lo", "hi").mapInArrow(compare, FOUND))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    e = F.col("embedding")
    number = F.filter(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce((F.size(e) > 0) & (F.size(number) == 0) & F.exists(e, lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("x"), good.alias("good"))
    rows = rows.withColumns({f"e{i}": F.when(F.col("good"), c) for i, c in enumerate(hash128(F.col("x")), 1)})
    nodes = rows.where("good").groupBy("e1", "e2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("w"), F.first("x").alias("x"))
    nodes = cut(nodes)
    found = links(nodes.select("node", "w", "x"), threshold)
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.selectExpr("node a", "root b"))
    per = nodes.select("e1", "e2", "node", "w").join(total, "node", "left").join(comp.withColumnsRenamed({"id": "node"}), "node", "left")
    per = cut(per.select("e1", "e2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("comp", "node").alias("component_id")))
    out = rows.select("vec_id", "e1", "e2").join(per, ["e1", "e2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
