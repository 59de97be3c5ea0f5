"""Tree learners of many fits grown in lockstep (ML3, ML5, ML7-ML11, ML15).

Cross-validation, a parameter search, SMOTE variants and stacking fit the same
rows again and again, each time without other folds. Fitting them one by one
costs one pass over the rows per fit, round and tree level. Here all fits take
their next level in one Spark job: a pass over the binned rows adds up the
histograms of every open node of every fit, the histograms meet by node group
in a shuffle, the best splits (a few numbers a node) return to the driver, and
the next pass walks one level deeper. The job count is that of the slowest
single fit.

Where a fit sees at most ``BLOCK_ROWS`` rows (a byte a feature: 128 MB at 61 features), its rows and those of its own SMOTE set are one block. Its
sums are whole where they arise, so the same growth runs inside the tasks, one task per fit and one job per ``SAVE_EVERY`` rounds, with
the same trees. There a split's larger child is the parent's sums less the smaller child's.

A forest's trees do not wait for each other: over several blocks, as many of them as ``TREE_CELLS`` sums hold take a level
together, and where its nodes split on drawn columns only, only those are summed. The jobs of a call are then those of
its boosters' levels.

A fit leaves out some folds; it is trained on the other rows and scores the
left-out ones. A fit without folds i and j serves the outer folds i and j of
nested cross-validation alike. Synthetic rows (SMOTE) carry the number of the
fold set they were made for and are seen by the fits that leave out that set.

Boosting is second order on the logistic loss (histogram splits, shrinkage,
L1 / L2 / minimum gain, row and column samples, a cap on leaves). A forest's
tree is a regression tree on the weighted label, whose squared-error gain is
the Gini gain for two classes; its rows are Poisson draws, its columns are
drawn per node. Draws hash the row, the learner and the round, so they do not
depend on partitions or on the folds left out.

State between jobs: binned rows and one margin per row and fit, persisted, with
a reliable checkpoint every ``SAVE_EVERY`` rounds (of the margins alone, in
blocks of one fit). The trees of these rounds are then written to the store, a
folder, by the tasks that grew them; a restarted driver goes on from there.
"""

from __future__ import annotations

import io
import pickle
import zlib
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.customers import ID_COL

BINS, SAVE_EVERY, BLOCK_ROWS = 32, 50, 1 << 21
#: Sums of a level held at once (nodes by bins), and trees of a forest grown at once, in numbers.
CELLS, TREE_CELLS = 1 << 19, 1 << 22
#: Codes of a pack of features for nodes of many rows and of few rows (of 65,536 a code can hold), and of a group of features in a pack.
PACKS, GROUP = (2048, 64), 45
#: Rows worked off at once: what is made for them stays in a core's cache.
ROWS = 1 << 13
_U = np.uint64


@dataclass(frozen=True)
class Params:
    """Settings of a learner; ``forest``: independent trees instead of boosting."""
    rounds: int = 300
    depth: int = 3
    rate: float = 0.1
    l2: float = 1.0
    l1: float = 0.0
    gain: float = 0.0
    leaves: int = 1 << 30
    min_rows: int = 1
    min_weight: float = 0.0
    rows: float = 1.0
    cols: float | str = 1.0  # share, or sqrt / log2 / all
    weight: str | None = None
    forest: bool = False
    split_rows: int = 2


@dataclass(frozen=True)
class Fit:
    """One learner trained without the folds ``left`` (rows of other fold numbers than -1 stay out of SMOTE sets)."""
    member: str
    params: Params
    left: tuple[int, ...] = ()
    smote: bool = False

    @property
    def name(self) -> str:
        return f"{self.member}{'+smote' if self.smote else ''}|{','.join(map(str, self.left))}"

    @property
    def seed(self) -> int:
        return zlib.crc32(self.member.encode())


@dataclass
class Tree:
    """Nodes in order of growth; children of a split are neighbours. ``feature`` -1 is a leaf."""
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, value), (self.gain, 0.0)):
            column.append(v)
        return len(self.feature) - 1

    def __getstate__(self) -> tuple[np.ndarray, ...]:
        return *self.arrays(), np.array(self.gain)

    def __setstate__(self, saved: tuple[np.ndarray, ...]) -> None:
        self.feature, self.cut, self.left, self.value, self.gain = (a.tolist() for a in saved)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int32), np.array(self.cut, np.int32), np.array(self.left, np.int32), np.array(self.value)


def walk(x: np.ndarray, tree: tuple[np.ndarray, ...], depth: int, some: np.ndarray | None = None) -> np.ndarray:
    """Node of every row (or of the rows ``some``) after at most ``depth`` steps; ``x``: features by rows."""
    feature, cut, left, _ = tree
    n, flat = x.shape[1], x.reshape(-1)
    places = np.arange(n) if some is None else some
    out, rows, at, offset = np.zeros(len(places), np.int64), places, np.arange(len(places)), feature.astype(np.int64) * n
    node = out
    for _ in range(depth):
        going = np.flatnonzero(feature.take(node) >= 0)  # rows in a leaf are let go
        if not len(going):
            break
        if len(going) < len(rows):
            rows, at, node = rows.take(going), at.take(going), node.take(going)
        node = left.take(node) + (flat.take(offset.take(node) + rows) > cut.take(node))
        out[at] = node
    return out


def _fall(x: np.ndarray, tree: tuple[np.ndarray, ...], depth: int, some: np.ndarray, leaf: np.ndarray) -> None:
    """Writes the leaf of the rows ``some`` into ``leaf``: many rows node by node, few by ``walk``."""
    feature, cut, left = (a.tolist() for a in tree[:3])
    if len(some) < 64 * len(feature):
        for lo in range(0, len(some), ROWS):
            leaf[some[lo:lo + ROWS]] = walk(x, tree, depth, some[lo:lo + ROWS])
        return
    todo = [(0, some)]
    while todo:
        node, rows = todo.pop()
        if feature[node] < 0:
            leaf[rows] = node
        else:
            right = x[feature[node]].take(rows) > cut[node]
            todo += [(left[node], rows.compress(~right)), (left[node] + 1, rows.compress(right))]


# ------------------------------------------------------------------ rows

def edges_of(mm: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of every feature: quantiles below the maximum (one aggregate)."""
    width = mm.select(F.size(vector_to_array("features")).alias("n")).head()
    if width is None:
        return []
    x = mm.select(vector_to_array("features").alias("x"))
    share = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = x.agg(*[F.percentile_approx(F.col("x")[i], share, F.lit(10_000)).alias(f"q{i}") for i in range(width["n"])],
                *[F.max(F.col("x")[i]).alias(f"m{i}") for i in range(width["n"])]).head()
    return [np.array(sorted({q for q in row[f"q{i}"] or [] if q < row[f"m{i}"]})) for i in range(width["n"])]


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], "left").astype(np.uint8) for i, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(data: DataFrame, edges: list[np.ndarray], block_rows: int) -> RDD:
    """Blocks of about ``block_rows`` rows as dicts of arrays. ``data``: id, label, weight, pos_weight, features, fold, made."""
    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(parts).combine_chunks()
        column = lambda i: b[i].to_numpy()
        ids = b[0].chunk(0)
        block = {"id": ids, "y": column(1), "weight": column(2), "pos_weight": column(3), "fold": column(4), "made": column(5), "hash": column(6).view(_U),
                 "x": np.ascontiguousarray(binned(_matrix(b[7].chunk(0), len(edges)), edges).T)}
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, block_rows - n)
                parts, n, b = [*parts, b.slice(0, take)], n + take, b.slice(take)
                if n == block_rows:
                    yield block(parts)
                    parts, n = [], 0
        if n:
            yield block(parts)

    x = vector_to_array("features")
    rows = data.select(F.col(ID_COL).cast("string"), *[F.col(c).cast("double") for c in ("label", "weight", "pos_weight")],
                       F.col("fold").cast("int"), F.col("made").cast("int"), F.xxhash64(ID_COL, "made", x), x)
    return rows.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


# ------------------------------------------------------------------ one level

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _draws(hashes: np.ndarray, seed: int, nth: int) -> np.ndarray:
    """A uniform number per row, learner and round."""
    return (_mix(hashes ^ _mix(np.array([seed * 1_000_003 + nth + 1], _U))) >> _U(11)) / float(1 << 53)


#: Chances of at most 0, 1, 2 ... for a Poisson draw of mean one (a bootstrap sample, row by row).
_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


def _own_weight(b: dict, fit: Fit, made: int) -> np.ndarray:
    """Weights of the rows that ``fit`` is trained on, 0 elsewhere."""
    p = fit.params
    w = b[p.weight].copy() if p.weight else np.ones(len(b["y"]))
    own = (b["made"] < 0) & ~np.isin(b["fold"], fit.left)
    w[~(own | ((b["made"] == made) & fit.smote))] = 0
    return w


def _copies(hashes: np.ndarray, seed: int, nth: int) -> np.ndarray:
    """How often a tree's sample takes each row."""
    out = np.zeros(len(hashes), np.uint8)
    for lo in range(0, len(hashes), ROWS):
        drawn = _draws(hashes[lo:lo + ROWS], seed, nth)
        for chance in _POISSON:
            out[lo:lo + ROWS] += drawn > chance
    return out


def _drawn_weight(b: dict, fit: Fit, w: np.ndarray, nth: int) -> np.ndarray:
    """The weights ``w`` in one round."""
    p = fit.params
    if p.forest:
        return w * _copies(b["hash"], fit.seed, nth)
    return w * (_draws(b["hash"], fit.seed, nth) < p.rows) if p.rows < 1 else w


def _slopes(b: dict, margin: np.ndarray, fit: Fit, w: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the rows ``use``."""
    w, y = w[use], b["y"][use]
    if fit.params.forest:
        return -w * y, w
    prob = 1 / (1 + np.exp(-margin[use]))
    return w * (prob - y), w * prob * (1 - prob)


Groups = tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]


def grouped(x: np.ndarray, starts: np.ndarray) -> Groups:
    """Features (``x``: features by rows) in groups of at most ``GROUP`` codes (one feature may have more), of the codes that occur: the bins
    of one column, or columns derived from each other, add few. (Groups by rows: codes; per group the places of its bins, and codes by
    bins: 1 where a code has the bin)."""
    sizes, groups, some = np.diff(starts).tolist(), [], slice(None, None, 1 + x.shape[1] // 4096)
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        likely = []
        for i, (_, code, bins) in enumerate(groups):  # the group that grows least, by some of the rows
            n = np.count_nonzero(np.bincount(code[some] * sizes[f] + x[f, some]))
            if n <= GROUP:
                likely.append((n / max(1, len(bins)), -len(bins), i))
        for *_, i in sorted(likely):
            features, code, bins = groups[i]
            both = code * sizes[f] + x[f]
            found = np.flatnonzero(np.bincount(both))  # by all rows
            if len(found) <= GROUP:
                to = np.zeros(len(bins) * sizes[f], np.int64)
                to[found] = np.arange(len(found))
                groups[i] = [*features, f], to.take(both), np.column_stack([bins[found // sizes[f]], found % sizes[f]])
                break
        else:
            groups.append(([f], x[f].astype(np.int64), np.arange(sizes[f])[:, None]))
    codes = np.array([code for _, code, _ in groups], np.uint8).reshape(len(groups), x.shape[1])
    return codes, [(np.concatenate([np.arange(starts[f], starts[f + 1]) for f in features]),
                    np.concatenate([bins[:, [k]] == np.arange(sizes[f]) for k, f in enumerate(features)], 1).astype(float)) for features, _, bins in groups]


def ungrouped(codes: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], starts: np.ndarray) -> np.ndarray:
    """The features (features by rows) that ``grouped`` met in codes."""
    x = np.empty((len(starts) - 1, codes.shape[1]), np.uint8)
    for code, (bins, has) in zip(codes, groups, strict=True):
        of = np.searchsorted(starts, bins, "right") - 1
        for f in np.unique(of):
            x[f] = has[:, of == f].argmax(1).astype(np.uint8).take(code)
    return x


class Packed:
    """``x`` (features by rows) with several features met in one code, up to ``PACKS`` codes: rows are counted once a code instead of once
    a feature, and a feature's sums are those of the code added up over its other features. A pack is one group of features, or two
    crossed: a table, whose sums are added up along its other side."""

    def __init__(self, x: np.ndarray, starts: np.ndarray, groups: Groups | None = None):
        self.x, self.n_rows, self.starts = x, x.shape[1], starts
        self.met, self.groups = groups if groups is not None else grouped(x, starts)
        self._made: dict[int, list] = {}
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def codes(self, cells: int) -> list[tuple[int, ...]]:
        """The one or two groups of every pack: at most ``cells`` codes, unless a group has more."""
        if cells not in self._made:
            size = [len(has) for _, has in self.groups]
            groups, made = sorted(range(len(size)), key=lambda i: -size[i]), []
            while groups:
                one = groups.pop(0)
                two = next((i for i in groups if size[i] * size[one] <= cells), None)
                if two is not None:
                    groups.remove(two)
                made.append((one,) if two is None else (one, two))
            self._made[cells] = made
        return self._made[cells]

    def sizes(self, cells: int) -> list[tuple[int, int]]:
        """The codes of either side of every pack."""
        return [(len(self.groups[pack[0]][1]), len(self.groups[pack[1]][1]) if len(pack) > 1 else 1) for pack in self.codes(cells)]

    def table(self, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all packs (rows by packs), and where the bins of all features lie among those of the packs, one after the other."""
        if cells not in self._tables:
            packs, sizes = self.codes(cells), self.sizes(cells)
            codes = np.empty((self.n_rows, len(packs)), np.min_scalar_type(max([a * b for a, b in sizes], default=1)))
            for lo in range(0, self.n_rows, ROWS):
                for k, pack in enumerate(packs):
                    code = self.met[pack[0], lo:lo + ROWS]
                    codes[lo:lo + ROWS, k] = code if len(pack) == 1 else code.astype(codes.dtype) * codes.dtype.type(sizes[k][1]) + self.met[pack[1], lo:lo + ROWS]
            order = np.empty(int(self.starts[-1]), np.int64)
            if packs:
                order[np.concatenate([self.groups[i][0] for pack in packs for i in pack])] = np.arange(len(order))
            self._tables[cells] = codes, order
        return self._tables[cells]


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first node, last, first row, last) of pieces of at most ``ROWS`` rows that lie by node: a part of a large node, or some small ones."""
    ends, node = np.cumsum(sizes), 0
    while node < len(sizes):
        first, end = int(ends[node] - sizes[node]), int(ends[node])
        if end - first > ROWS:
            yield from ((node, node + 1, lo, min(lo + ROWS, end)) for lo in range(first, end, ROWS))
            node += 1
        else:
            last = int(np.searchsorted(ends, first + ROWS, "right"))
            yield node, last, first, int(ends[last - 1])
            node = last


def _by_node(slot: np.ndarray, n_open: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which rows lie by node, and the rows of each node."""
    return np.argsort(slot.astype(np.min_scalar_type(n_open)), kind="stable"), np.bincount(slot, minlength=n_open)


def _both(grad: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Gradient and curvature as one number, so that both are added up at once."""
    out = np.empty(len(grad), complex)
    out.real, out.imag = grad, curve
    return out


def _sums(x: Packed, use: np.ndarray, grad: np.ndarray, curve: np.ndarray, slot: np.ndarray, n_open: int) -> np.ndarray:
    """([gradient, curvature, rows], open nodes, bins of all features) of the rows ``use`` of ``x`` in nodes ``slot``."""
    both = np.zeros(x.n_rows, complex)
    both[use] = _both(grad, curve)
    order, sizes = _by_node(slot, n_open)
    return _node_sums(x, use[order], both, sizes)


def _node_sums(x: Packed, use: np.ndarray, both: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same of the rows ``use``, which lie by node: ``sizes`` of each. ``both``: gradient and curvature of all rows of ``x``."""
    out = np.zeros((3, len(sizes), int(x.starts[-1])))
    ends, (wide, narrow), tables = np.cumsum(sizes), PACKS, []
    for first, last, lo, hi in _pieces(sizes):
        n, rows = last - first, use[lo:hi]
        cells = wide if int(sizes[first:last].sum()) >= n * wide else narrow  # few rows a node: fewer codes to add up
        codes, order = x.table(cells)
        if not tables:
            tables = [(np.zeros(n * a * b, complex), np.zeros(n * a * b, np.int64)) for a, b in x.sizes(cells)]
        whole = hi > lo and rows[-1] - rows[0] == hi - lo - 1  # rows of a node ascend
        if n == 1 and whole:
            met, values = codes[rows[0]:rows[-1] + 1], both[rows[0]:rows[-1] + 1]
        else:
            met, values = codes.take(rows, 0), both.take(rows)
        node = np.repeat(np.arange(n), sizes[first:last]) if n > 1 else None
        for k, (added, counted) in enumerate(tables):
            place = met[:, k].astype(np.int64)
            if node is not None:
                place += node * (len(counted) // n)
            np.add.at(added, place, values)
            counted += np.bincount(place, minlength=len(counted))
        if hi == ends[last - 1]:
            found = []
            for pack, (a, b), (added, counted) in zip(x.codes(cells), x.sizes(cells), tables, strict=True):
                table = np.concatenate([added.real, added.imag, counted]).reshape(3 * n, a, b)
                sides = [table @ np.ones(b), (np.ones((1, a)) @ table)[:, 0]] if len(pack) > 1 else [table[:, :, 0]]
                found += [side @ x.groups[i][1] for i, side in zip(pack, sides, strict=True)]
            if found:
                out[:, first:last] = np.concatenate(found, 1).take(order, 1).reshape(3, n, -1)
            tables = []
    return out


#: Kinds of rows of a tree's sample: kind times ``BINS`` of every row, and gradient, curvature and 1 of every kind.
Kinds = tuple[np.ndarray, np.ndarray]


def _drawn_sums(x: np.ndarray, use: np.ndarray, both: np.ndarray, sizes: np.ndarray, columns: np.ndarray, kinds: Kinds | None = None) -> np.ndarray:
    """The same of the columns drawn for each node (nodes, columns) only: each in ``BINS`` bins. Rows of few kinds are counted by kind."""
    n_open, take = columns.shape
    out, flat, ends, counts = np.zeros((3, n_open, take * BINS)), x.reshape(-1), np.cumsum(sizes), None
    for first, last, lo, hi in _pieces(sizes):
        n, rows = last - first, use[lo:hi]
        node = np.repeat(np.arange(n), sizes[first:last]) if n > 1 else None
        alike = kinds is not None and kinds[1].shape[1] * BINS * n <= max(hi - lo, sizes[first])
        if alike:
            base, n_kinds = kinds[0].take(rows), kinds[1].shape[1]
            if counts is None:
                counts = np.zeros((take, n * n_kinds * BINS), np.int64)
        else:
            base, values = np.zeros(hi - lo, np.int64), both.take(rows)
        if node is not None:
            base += node * (BINS * (n_kinds if alike else 1))
        for j in range(take):
            if node is None:
                place = base + x[columns[first, j]].take(rows)
            else:
                place = base + flat.take((columns[first:last, j] * x.shape[1]).take(node) + rows)
            at = slice(j * BINS, (j + 1) * BINS)
            if alike:
                counts[j] += np.bincount(place, minlength=counts.shape[1])
            elif node is None:
                out[0, first, at] += np.bincount(place, values.real, BINS)
                out[1, first, at] += np.bincount(place, values.imag, BINS)
                out[2, first, at] += np.bincount(place, None, BINS)
            else:
                for k, v in enumerate((values.real, values.imag, None)):
                    out[k, first:last, at] = np.bincount(place, v, n * BINS).reshape(n, BINS)
        if alike and hi == ends[last - 1]:
            found = kinds[1] @ counts.reshape(take, n, n_kinds, BINS)  # (columns, nodes, 3, bins)
            out[:, first:last] = found.transpose(2, 1, 0, 3).reshape(3, n, -1)
            counts = None
    return out


def _histogram(b: dict, x: Packed, margin: np.ndarray, fit: Fit, w: np.ndarray, nth: int, tree: tuple, depth: int, slots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first node, sums) of the open nodes of one fit over one block, some nodes at a time."""
    n_open = int(slots.max()) + 1
    use = np.flatnonzero(w > 0)
    slot = slots[walk(b["x"], tree, depth, use)] if depth else np.zeros(len(use), np.int32)
    use, slot = use[slot >= 0], slot[slot >= 0]
    both = np.zeros(len(w), complex)
    both[use] = _both(*_slopes(b, margin, fit, w, use))
    order, sizes = _by_node(slot, n_open)
    yield from _by_nodes(x, use[order], both, sizes, _drawn(fit, nth, n_open, len(x.starts) - 1))


def _by_nodes(x: Packed, use: np.ndarray, both: np.ndarray, sizes: np.ndarray, drawn: np.ndarray | None, kinds: Kinds | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first node, sums) of rows that lie by node, as many nodes at a time as ``CELLS`` sums hold."""
    some, ends = max(1, CELLS // max(1, int(x.starts[-1]) if drawn is None else drawn.shape[1] * BINS)), np.cumsum(sizes)
    for lo in range(0, len(sizes), some):
        hi = min(len(sizes), lo + some)
        own = use[ends[lo] - sizes[lo]:ends[hi - 1]], both, sizes[lo:hi]
        yield lo, _node_sums(x, *own) if drawn is None else _drawn_sums(x.x, *own, drawn[lo:hi], kinds)


def _shrunk(g: np.ndarray, p: Params) -> np.ndarray:
    return g - np.minimum(np.maximum(g, -p.l1), p.l1) if p.l1 else g


def _score(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    return _shrunk(g, p) ** 2 / np.maximum(h + p.l2, 1e-12)


def leaf_value(g: float, h: float, p: Params) -> float:
    value = -(g - min(max(g, -p.l1), p.l1)) / max(h + p.l2, 1e-12)
    return min(max(value, 0.0), 1.0) if p.forest else value * p.rate  # a share: sums by differences may stray by rounding


def _columns(fit: Fit, nth: int, n_open: int, width: int) -> np.ndarray:
    """(open nodes, features): the features a node may split on."""
    cols = fit.params.cols
    take = {"sqrt": int(np.sqrt(width)), "log2": int(np.log2(max(width, 2))), "all": width}[cols] if isinstance(cols, str) else int(np.ceil(cols * width))
    take = max(1, take)
    if take >= width:
        return np.ones((n_open, width), bool)
    rng = np.random.default_rng([fit.seed, nth, n_open])
    keys = rng.random((n_open if fit.params.forest else 1, width))
    return np.broadcast_to(keys.argsort(1).argsort(1) < take, (n_open, width))


def _drawn(fit: Fit, nth: int, n_open: int, width: int) -> np.ndarray | None:
    """(open nodes, columns) of a forest whose nodes may split on some columns only, ascending; None: all columns are summed."""
    if not fit.params.forest or fit.params.cols in ("all", 1.0):
        return None
    may = _columns(fit, nth, n_open, width)
    return np.nonzero(may)[1].reshape(n_open, -1) if not may.all() else None


def _best(hist: np.ndarray, fit: Fit, may: np.ndarray, starts: np.ndarray, drawn: np.ndarray | None = None) -> np.ndarray:
    """Per open node: feature, cut, gain, left (gradient, curvature, rows), all (the same three); feature -1: no split. ``may``: (nodes,
    features) the node may split on; of the columns ``drawn``, where only those were summed."""
    p, some = fit.params, max(1, 2 * ROWS // max(1, hist.shape[2]))
    if hist.shape[1] > some:
        parts = [slice(lo, lo + some) for lo in range(0, hist.shape[1], some)]
        return np.concatenate([_best(hist[:, at], fit, may[at], starts, None if drawn is None else drawn[at]) for at in parts])
    if drawn is not None:
        starts = np.arange(drawn.shape[1] + 1) * BINS
    width = len(starts) - 1
    every = hist[:, :, :starts[1]].sum(2)
    sums = np.cumsum(hist, 2)
    before = np.concatenate([np.zeros((3, hist.shape[1], 1)), sums[:, :, starts[1:-1] - 1]], 2)
    of = np.repeat(np.arange(width), np.diff(starts))
    low = sums - before[:, :, of]
    high = every[:, :, None] - low
    gain = _score(low[0], low[1], p) + _score(high[0], high[1], p) - _score(every[0], every[1], p)[:, None]
    gain = gain / 2 - p.gain
    rows, weight = np.minimum(low[2], high[2]), np.minimum(low[1], high[1])
    fits = (rows >= max(1, p.min_rows)) & (weight >= p.min_weight) & (every[2] >= p.split_rows)[:, None]
    if drawn is None:
        fits &= may[:, of]
    gain = np.where(fits, gain, -np.inf)
    at = gain.astype(np.float32).argmax(1)  # gains that differ by rounding only are equal: the first feature wins
    node = np.arange(hist.shape[1])
    best, column = gain[node, at], of[at]
    feature = np.where(best > 1e-9, column if drawn is None else drawn[node, column], -1)
    return np.column_stack([feature, at - starts[column], best, low[:, node, at].T, every.T])


# ------------------------------------------------------------------ training

def grow(p: Params) -> Generator[tuple, np.ndarray | None, Tree]:
    """One tree: asks for the best splits of the open nodes, (arrays, depth, slot of each node), until none is left."""
    tree, nodes, leaves, depth = Tree(), [0], 1, 0
    tree.add(0.0)
    while nodes:
        slots = np.full(len(tree.feature), -1, np.int32)
        slots[nodes] = np.arange(len(nodes))
        best = yield tree.arrays(), depth, slots
        depth += 1
        if best is None:  # no training rows
            break
        if depth == 1:
            tree.value[0] = leaf_value(float(best[0, 6]), float(best[0, 7]), p)
        children, order = [], np.argsort(-best[:, 2], kind="stable").tolist()
        best = best.tolist()
        for s in order:  # the best splits first, while leaves are left
            feature, cut, gain, lg, lh, lc, g, h, c = best[s]
            if feature < 0 or leaves >= p.leaves:
                continue
            node = nodes[s]
            tree.feature[node], tree.cut[node], tree.gain[node] = int(feature), int(cut), float(gain)
            tree.left[node] = tree.add(leaf_value(lg, lh, p))
            tree.add(leaf_value(g - lg, h - lh, p))
            leaves += 1
            children += [(tree.left[node], lc), (tree.left[node] + 1, c - lc)]
        least = max(p.split_rows, 2 * p.min_rows, 2)
        # without leaves left no split is taken: their sums are not asked for
        nodes = sorted(n for n, rows in children if rows >= least) if depth < p.depth and leaves < p.leaves else []
    return tree


def _grow_here(b: dict, margin: np.ndarray, fit: Fit, made: int, first: int, last: int, starts: np.ndarray) -> list[Tree]:
    """The trees of rounds ``first`` to ``last`` of one fit over its only block; ``margin`` is moved on. Only the fit's own rows are
    looked at: those it trains on first, then those it scores. A forest's margins are needed where it scores only."""
    last = min(last, fit.params.rounds)
    if first >= last:
        return []
    w = _own_weight(b, fit, made)
    train, held = np.flatnonzero(w > 0), np.flatnonzero((b["made"] < 0) & np.isin(b["fold"], fit.left))
    rows = np.concatenate([train, held[w[held] <= 0]])
    codes, groups = b["groups"] if "groups" in b else grouped(b["x"], starts)
    codes = codes.take(rows, 1)
    own = {"x": ungrouped(codes, groups, starts), **{c: b[c].take(rows) for c in ("y", "hash")}}
    x, w, moved = Packed(own["x"], starts, (codes, groups)), w.take(train), margin.take(rows)
    forest, n = fit.params.forest, len(train)
    mine = {**own, "hash": own["hash"][:n]}
    known = _kinds(w, own["y"][:n]) if forest else None
    out = []
    for nth in range(first, last):
        copies, kinds = _copies(mine["hash"], fit.seed, nth) if forest else None, None
        if known is not None:
            kinds = known[0] + copies * np.int64(BINS), known[1]
        tree, leaf = _tree_here(mine, x, moved, fit, nth, w * copies if forest else _drawn_weight(mine, fit, w, nth), kinds)
        out.append(tree)
        arrays = tree.arrays()
        left = np.arange(n, len(rows)) if forest else np.flatnonzero(leaf < 0)  # not met by the growth
        _fall(own["x"], arrays, fit.params.depth, left, leaf)
        if forest:
            moved[n:] += arrays[3].take(leaf[n:])
        else:
            moved += arrays[3].take(leaf)
    margin[rows] = moved
    return out


def _kinds(w: np.ndarray, y: np.ndarray) -> Kinds | None:
    """Kinds of rows by weight, label and copies in a sample, as of no copies; None if they are many."""
    weights, labels, copies = np.unique(w), np.unique(y), np.arange(len(_POISSON) + 1)
    if len(weights) * len(labels) > 8:
        return None
    of = np.searchsorted(weights, w) * len(labels) + np.searchsorted(labels, y)
    weight, label = np.multiply.outer(np.repeat(weights, len(labels)), copies), np.tile(labels, len(weights))
    return of * (len(copies) * BINS), np.stack([-weight * label[:, None], weight, np.ones(weight.shape)]).reshape(3, -1)


def _tree_here(b: dict, packed: Packed, margin: np.ndarray, fit: Fit, nth: int, w: np.ndarray, kinds: Kinds | None = None) -> tuple[Tree, np.ndarray]:
    """One tree, and the leaf of the rows that it was grown on (-1: other rows). The rows lie by node (``ids``, ``sizes``), so what holds for
    a node is not looked up row by row; those of finished nodes are let go level by level."""
    width, total = len(packed.starts) - 1, int(packed.starts[-1])
    use = np.flatnonzero(w > 0)
    both = np.zeros(len(w), complex)
    for lo in range(0, len(use), ROWS):
        some = use[lo:lo + ROWS]
        both[some] = _both(*_slopes(b, margin, fit, w, some))
    ids, sizes, empty = np.zeros(1, np.int64), np.array([len(use)]), not len(use)
    x, leaf, mark = packed.x.reshape(-1), np.full(packed.n_rows, -1, np.int64), not fit.params.forest
    growth, held, best = grow(fit.params), None, None  # held: slots and sums of the level above

    def rows(some: np.ndarray) -> np.ndarray:
        if some.all():
            return use
        if len(ids) * ROWS > 8 * len(use):
            return use.compress(np.repeat(some, sizes))
        ends = np.cumsum(sizes)
        return np.concatenate([use[:0], *[use[ends[i] - sizes[i]:ends[i]] for i in np.flatnonzero(some)]])

    def done(some: np.ndarray) -> None:
        """The nodes ``some`` are left to their rows."""
        nonlocal use, ids, sizes
        if some.any():
            if mark:
                leaf[rows(some)] = np.repeat(ids[some], sizes[some])
            use, ids, sizes = rows(~some), ids[~some], sizes[~some]

    def split(feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The rows go to the nodes' children, all left ones first; returns the nodes."""
        nonlocal use, ids, sizes
        done(feature[ids] < 0)
        sides, n = ([use[:0]], [use[:0]]), np.zeros(len(ids), np.int64)
        offset, cuts = feature[ids].astype(np.int64) * packed.n_rows, cut[ids].astype(np.uint8)
        for first, last, lo, hi in _pieces(sizes):
            some = use[lo:hi]
            if last - first == 1:
                right = packed.x[feature[ids[first]]].take(some) > cuts[first]
                n[first] += np.count_nonzero(right)
            else:
                right = x.take(np.repeat(offset[first:last], sizes[first:last]) + some) > np.repeat(cuts[first:last], sizes[first:last])
                n[first:last] = np.diff(np.concatenate([[0], np.cumsum(right)])[np.concatenate([[0], np.cumsum(sizes[first:last])])])
            sides[0].append(some.compress(~right))
            sides[1].append(some.compress(right))
        use = np.concatenate([*sides[0], *sides[1]])
        of, ids, sizes = ids, np.concatenate([left[ids], left[ids] + 1]).astype(np.int64), np.concatenate([sizes - n, n])
        return of

    try:
        step = next(growth)
        while True:
            (feature, cut, left, _), depth, slots = step
            n_open = int(slots.max()) + 1
            if depth:
                near = split(feature, cut, left)
                n = np.zeros(len(slots), np.int64)
                n[ids] = sizes
                # a closed node's rows are needed where they are the smaller part of a split
                near = near[(slots[left[near]] >= 0) | (slots[left[near] + 1] >= 0)]
                wanted = np.zeros(len(slots), bool)
                wanted[left[near]] = wanted[left[near] + 1] = True
                done(~wanted[ids])
            drawn = _drawn(fit, nth, n_open, width)
            if empty:
                best = None
            elif held is not None and drawn is None and n_open * total <= CELLS:
                above, sums = held
                less = np.where(n[left[near]] <= n[left[near] + 1], left[near], left[near] + 1)
                more = 2 * left[near] + 1 - less
                at = np.full(len(slots), -1, np.int64)
                at[less] = np.arange(len(less))
                some = at[ids] >= 0
                small = np.zeros((3, len(less), total))
                small[:, at[ids[some]]] = _node_sums(packed, rows(some), both, sizes[some])
                large = sums[:, above[near]] - small
                sums = np.empty((3, n_open, total))
                for of, s in ((less, small), (more, large)):
                    sums[:, slots[of][slots[of] >= 0]] = s[:, slots[of] >= 0]
                best = _best(sums, fit, _columns(fit, nth, n_open, width), packed.starts)
                held = slots, sums
            else:
                may, some, parts = _columns(fit, nth, n_open, width), slots[ids] >= 0, 0
                place, best = slots[ids[some]], np.zeros((n_open, 9))
                for lo, found in _by_nodes(packed, rows(some), both, sizes[some], None if drawn is None else drawn[place], kinds):
                    at, parts = place[lo:lo + found.shape[1]], parts + 1
                    best[at] = _best(found, fit, may[at], packed.starts, None if drawn is None else drawn[at])
                held = None
                if drawn is None and parts == 1:
                    sums = np.zeros((3, n_open, total))
                    sums[:, place] = found
                    held = slots, sums
            step = growth.send(best)
    except StopIteration as end:
        tree = end.value
    if mark:  # the rows of the last splits take one more step
        split(*tree.arrays()[:3])
        done(np.ones(len(ids), bool))
    return tree, leaf


def _spread(key: tuple[int, int, int]) -> int:
    return zlib.crc32(np.array(key, np.int64).tobytes())


def _part(b: dict, rows: np.ndarray) -> dict:
    return {c: v.take(pa.array(rows)) if c == "id" else v.take(rows, -1) for c, v in b.items()}


def _joined(pieces: list[dict]) -> dict:
    """One block of several; their order does not depend on how they came."""
    pieces = sorted(pieces, key=lambda b: (b["made"][0], b["hash"][0]))
    return {c: pa.concat_arrays([b[c] for b in pieces]) if c == "id" else np.concatenate([b[c] for b in pieces], -1) for c in pieces[0]}


def _lean(b: dict, fit: Fit, starts: np.ndarray) -> dict:
    """What ``fit`` needs of a block: features as groups of codes, its own weight, the ids of the rows it scores."""
    scored = pa.array((b["made"] < 0) & np.isin(b["fold"], fit.left))
    return {"id": pc.if_else(scored, b["id"], pa.scalar(None, b["id"].type)), "groups": grouped(b["x"], starts),
            **{c: b[c] for c in ("y", "fold", "made", "hash", fit.params.weight) if c}}


def _here(i: int) -> int:
    return i


class Lockstep:
    """The growth of ``fits`` on ``data`` (model matrix with fold and made); ``passes`` counts the jobs over the rows."""

    def __init__(self, data: DataFrame, fits: Sequence[Fit], edges: list[np.ndarray], made: dict[tuple[int, ...], int] | None = None, store: str | None = None, block_rows: int = BLOCK_ROWS):
        self.spark, self.fits, self.edges, self.store = data.sparkSession, list(fits), edges, store
        ensure_checkpoint_dir(self.spark)
        self.made = [(made or {}).get(f.left, -2) if f.smote else -2 for f in self.fits]
        self.starts = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])]).astype(np.int64)
        self.trees: list[list[Tree]] = [[] for _ in self.fits]
        self.passes, self.rounds_run, self.stale = 0, 0, None
        self.staged: list[tuple[str, int, int, int, int]] = []
        counts = dict(data.groupBy("made").count().collect())  # one row a SMOTE set
        real = sum(n for m, n in counts.items() if m < 0)
        self.n_rows = sum(counts.values())
        self.one_block = real + max((counts.get(m, 0) for m in self.made), default=0) <= block_rows
        if self.one_block:
            self._one_block_a_fit(_blocks(data, edges, block_rows))
            return
        blocks = _blocks(data, edges, block_rows)
        parts = max(1, blocks.getNumPartitions())
        # few partitions: the fits are dealt into groups as well, so that all cores work
        self.groups = groups = max(1, min(len(self.fits), -(-self.spark.sparkContext.defaultParallelism // parts)))
        self.members = members = [list(range(g, len(self.fits), groups)) for g in range(groups)]
        self.parts = n = parts * groups
        state = blocks.flatMap(lambda b: [(g, {**b, "margin": np.zeros((len(m), len(b["y"])))}) for g, m in enumerate(members)])
        if groups > 1:
            state = state.map(lambda r: (int(r[1]["hash"][0] >> _U(20)) * groups + r[0], r)).partitionBy(n, lambda k: k % n).values()
        self.state = state.persist(StorageLevel.MEMORY_AND_DISK)

    def _one_block_a_fit(self, blocks: RDD) -> None:
        """A partition a fit, the longest fits first: all real rows and the fit's own SMOTE set, joined to one block."""
        self.parts = n = max(1, len(self.fits))
        cost = [f.params.rounds * min(f.params.depth, 16) * (1 + (m >= 0)) for f, m in zip(self.fits, self.made, strict=True)]
        self.members = [[i] for i in sorted(range(len(self.fits)), key=lambda i: -cost[i])]
        wanted, starts, fits = [{self.made[i] for i in m} for m in self.members], self.starts, [self.fits[i] for i, in self.members]

        def dealt(b: dict) -> Iterator[tuple[int, dict]]:
            for m in np.unique(b["made"]):
                piece = _part(b, np.flatnonzero(b["made"] == m))
                yield from ((g, piece) for g, sets in enumerate(wanted) if m < 0 or m in sets)

        def joined(g: int, pieces: Iterator[tuple[int, dict]]) -> Iterator[tuple[int, dict]]:
            pieces = [b for _, b in pieces]
            if pieces:
                yield g, _lean(_joined(pieces), fits[g], starts)

        self.rows = blocks.flatMap(dealt).partitionBy(n, _here).mapPartitionsWithIndex(joined).persist(StorageLevel.MEMORY_AND_DISK)
        self._with_margins(self.rows.map(lambda r: np.zeros((1, len(r[1]["y"])))))

    def _with_margins(self, margins: RDD) -> None:
        self.margins = margins.persist(StorageLevel.MEMORY_AND_DISK)
        self.state = self.rows.zip(self.margins).map(lambda r: (r[0][0], {**r[0][1], "margin": r[1]}))

    def _next(self, state: RDD) -> None:
        """Two generations of margins are held: the older ones are let go when the next pass has used them."""
        if self.stale is not None:
            self.stale.unpersist()
        self.stale, self.state = self.state, state.persist(StorageLevel.MEMORY_AND_DISK)

    def _advance(self, trees: list[list[Tree]]) -> None:
        """Margins after ``trees`` of each fit."""
        arrays = [[[t.arrays() for t in trees[i]] for i in m] for m in self.members]

        def one(record):
            g, b = record
            margin = b["margin"].copy()
            for k, ts in enumerate(arrays[g]):
                for t in ts:
                    margin[k] += t[3][walk(b["x"], t, len(t[0]))]
            return g, {**b, "margin": margin}

        self._next(self.state.map(one))

    def _level(self, steps: dict[tuple[int, int], tuple]) -> dict[tuple[int, int], np.ndarray]:
        """Best splits of the open nodes of every tree in ``steps`` (fit, round): one job."""
        members, starts, fits, made = self.members, self.starts, self.fits, self.made
        wide = len(starts) - 1
        asked = [sorted(nth for i, nth in steps if i == m) for m in range(len(fits))]

        def sums(record):
            g, b = record
            x = Packed(b["x"], starts)
            for k, i in enumerate(members[g]):
                own = _own_weight(b, fits[i], made[i]) if asked[i] else None
                for nth in asked[i]:
                    w = _drawn_weight(b, fits[i], own, nth)
                    for lo, part in _histogram(b, x, b["margin"][k], fits[i], w, nth, *steps[i, nth]):
                        yield (i, nth, lo), part

        def split(record):
            (i, nth, lo), part = record
            n_open, hi = int(steps[i, nth][2].max()) + 1, lo + part.shape[1]
            drawn = _drawn(fits[i], nth, n_open, wide)
            may = _columns(fits[i], nth, n_open, wide)[lo:hi]
            return (i, nth), lo, _best(part, fits[i], may, starts, None if drawn is None else drawn[lo:hi])

        self.passes += 1
        found: dict[tuple[int, int], list] = {}
        for key, lo, best in self.state.flatMap(sums).reduceByKey(np.add, self.parts, _spread).map(split).collect():
            found.setdefault(key, []).append((lo, best))
        return {key: np.concatenate([best for _, best in sorted(parts, key=lambda p: p[0])]) for key, parts in found.items()}

    def _rounds_here(self, first: int, last: int) -> None:
        """The rounds of every fit in its task, which also writes the trees and counts the stage; the margins are checkpointed."""
        members, starts, fits, made, count = self.members, self.starts, self.fits, self.made, self._counts(last)

        def run(record):
            g, b = record
            i, margin = members[g][0], b["margin"].copy()
            trees = _grow_here(b, margin[0], fits[i], made[i], first, last, starts)
            return margin, (fits[i].name, last, pickle.dumps(trees)), list(count((g, {**b, "margin": margin})))

        before, grown = self.margins, self.state.map(run).persist(StorageLevel.MEMORY_AND_DISK)
        if self.store:
            self._write(grown.map(lambda r: r[1]), last)
        else:
            new = {name: pickle.loads(trees) for name, _, trees in grown.map(lambda r: r[1]).collect()}
            self.trees = [trees + new.get(f.name, []) for f, trees in zip(fits, self.trees, strict=True)]
        self.passes += 1
        self._staged(last, grown.flatMap(lambda r: r[2]).collect())
        self._with_margins(grown.map(lambda r: r[0]))
        self.margins.checkpoint()
        self.margins.count()
        before.unpersist()
        grown.unpersist()

    def _grow_all(self, wanted: Sequence[tuple[int, int]]) -> None:
        """The trees of some (fit, round) level by level together."""
        growth = {key: grow(self.fits[key[0]].params) for key in wanted}
        steps, done = {key: next(g) for key, g in growth.items()}, {}
        while steps:
            best, open_steps = self._level(steps), {}
            for key in steps:
                try:
                    open_steps[key] = growth[key].send(best.get(key))
                except StopIteration as end:
                    done[key] = end.value
            steps = open_steps
        new = [[done[key] for key in sorted(done) if key[0] == i] for i in range(len(self.fits))]
        self._advance(new)
        for trees, more in zip(self.trees, new, strict=True):
            trees += more

    def _rounds_of_all(self, first: int, last: int) -> None:
        """Boosters round by round; the trees of forests as many together as their sums may take."""
        boosters = [i for i, f in enumerate(self.fits) if not f.params.forest]
        for nth in range(first, last):
            live = [(i, nth) for i in boosters if nth < self.fits[i].params.rounds]
            if live:
                self._grow_all(live)
        some, cells = [], 0
        for nth in range(first, last):
            for i, f in enumerate(self.fits):
                if f.params.forest and nth < f.params.rounds:
                    size = self._tree_cells(f)
                    if some and cells + size > TREE_CELLS * self.groups:
                        self._grow_all(some)
                        some, cells = [], 0
                    some.append((i, nth))
                    cells += size
        if some:
            self._grow_all(some)

    def _tree_cells(self, fit: Fit) -> int:
        """Sums of the widest level of a forest's tree, at most."""
        p, drawn = fit.params, _drawn(fit, 0, 1, len(self.starts) - 1)
        nodes = min(1 << min(p.depth - 1, 40), p.leaves, max(1, self.n_rows // max(p.split_rows, 2 * p.min_rows, 2)))
        return 3 * nodes * (int(self.starts[-1]) if drawn is None else drawn.shape[1] * BINS)

    def run(self, rounds: int | None = None) -> Lockstep:
        """Grow until every fit has its rounds (or up to ``rounds``)."""
        nth = self._resume()
        every = max((f.params.rounds for f in self.fits), default=0)
        last = min(every, rounds if rounds is not None else every)
        while nth < last:
            stop = min(last, nth - nth % SAVE_EVERY + SAVE_EVERY)
            if self.one_block:
                self._rounds_here(nth, stop)
            else:
                self._rounds_of_all(nth, stop)
            self.rounds_run += stop - nth
            if not self.one_block:
                self._save(nth, stop)
                self._staged(stop, self.state.flatMap(self._counts(stop)).reduceByKey(np.add).collect())
            nth = stop
        return self

    def _done(self, nth: int) -> list[int]:
        return [min(nth, f.params.rounds) for f in self.fits]

    def _counts(self, nth: int):
        """Per fit: true positives, false positives, false negatives on the left-out rows after so many rounds, from the running
        sums of the trees: a fit of many rounds scores every smaller number on its way."""
        fits, members, done = self.fits, self.members, self._done(nth)

        def count(record):
            g, b = record
            for k, i in enumerate(members[g]):
                rows = np.flatnonzero((b["made"] < 0) & np.isin(b["fold"], fits[i].left))
                said = b["margin"][k, rows] >= (done[i] / 2 if fits[i].params.forest else 0)
                y = b["y"][rows] == 1
                yield i, np.array([(said & y).sum(), (said & ~y).sum(), (~said & y).sum()])

        return count

    def _staged(self, nth: int, counts: list[tuple[int, np.ndarray]]) -> None:
        """(member, rounds, the counts) of the fits that grew up to round ``nth``."""
        done = self._done(nth)
        for i, n in counts:
            if nth - SAVE_EVERY < self.fits[i].params.rounds:
                self.staged.append((self.fits[i].member, done[i], *map(int, n)))

    def _write(self, trees: RDD, nth: int) -> None:
        """(fit, rounds, trees since the last save)."""
        self.spark.createDataFrame(trees, "fit string, rounds int, trees binary").write.mode("overwrite").parquet(f"{self.store}/trees-{nth:05d}")

    def _save(self, first: int, last: int) -> None:
        self.state.checkpoint()
        self.state.count()
        if self.store:
            rows = [(f.name, last, pickle.dumps(self.trees[i][first:last])) for i, f in enumerate(self.fits)]
            self._write(self.spark.sparkContext.parallelize(rows, 1), last)

    def _saved(self) -> list[int]:
        """Rounds after which trees are in the store, without a gap."""
        last, out = max((f.params.rounds for f in self.fits), default=0), []
        for nth in [*range(SAVE_EVERY, last, SAVE_EVERY), last] if self.store else []:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.store}/trees-{nth:05d}/_SUCCESS")
            if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                break
            out.append(nth)
        return out

    def _read(self, saved: list[int]) -> DataFrame:
        return self.spark.read.schema("fit string, rounds int, trees binary").parquet(*[f"{self.store}/trees-{nth:05d}" for nth in saved])

    def _resume(self) -> int:
        """Rounds already in the store; their trees are applied to the margins."""
        saved = self._saved()
        if not saved or not self.n_rows:
            return 0
        stored = self._read(saved)
        if {r["fit"] for r in stored.select("fit").distinct().collect()} != {f.name for f in self.fits}:
            raise ValueError(f"{self.store} holds other fits")
        if self.one_block:
            place = {self.fits[m[0]].name: g for g, m in enumerate(self.members)}
            trees, starts = stored.rdd.map(lambda r: (place[r["fit"]], (r["rounds"], r["trees"]))).groupByKey(self.parts, _here), self.starts

            def moved(record):
                (_, b), (_, parts) = record
                margin, x = np.zeros((1, len(b["y"]))), ungrouped(*b["groups"], starts)
                for _, part in sorted(parts):
                    for t in pickle.loads(part):
                        margin[0] += t.arrays()[3][walk(x, t.arrays(), len(t.feature))]
                return margin

            self._with_margins(self.rows.zip(trees).map(moved))
        else:
            self.trees = [self._trees_of(f) for f in self.fits]
            self._advance(self.trees)
        return saved[-1]

    def _trees_of(self, fit: Fit) -> list[Tree]:
        saved = self._saved()
        parts = self._read(saved).where(F.col("fit") == fit.name).orderBy("rounds").collect() if saved else []
        return [t for r in parts for t in pickle.loads(r["trees"])]

    def scores(self) -> DataFrame:
        """(member, smote, left_out, customer_id, fold, label, score) of the rows each fit left out: its real rows outside training."""
        fits, members = self.fits, self.members

        def emit(record):
            g, b = record
            for k, i in enumerate(members[g]):
                fit = fits[i]
                rows = np.flatnonzero((b["made"] < 0) & np.isin(b["fold"], fit.left))
                if not len(rows):
                    continue
                margin = b["margin"][k, rows]
                score = margin / max(1, fit.params.rounds) if fit.params.forest else 1 / (1 + np.exp(-margin))
                table = pa.table({"member": [fit.member] * len(rows), "smote": [fit.smote] * len(rows), "left_out": [",".join(map(str, fit.left))] * len(rows),
                                  ID_COL: b["id"].take(pa.array(rows)), "fold": pa.array(b["fold"][rows], pa.int32()), "label": b["y"][rows], "score": score})
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, table.schema) as w:
                    w.write_table(table)
                yield (bytearray(sink.getvalue()),)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload in batch[0]:
                    yield from pa.ipc.open_stream(payload.as_buffer()).read_all().to_batches()

        schema = f"member string, smote boolean, left_out string, {ID_COL} string, fold int, label double, score double"
        return self.spark.createDataFrame(self.state.flatMap(emit), "payload binary").mapInArrow(read, schema)

    def model(self, member: str, left: tuple[int, ...] = (), smote: bool = False) -> TreeModel:
        i = [f.name for f in self.fits].index(replace(self.fits[0], member=member, left=left, smote=smote).name)
        fit, trees = self.fits[i], self.trees[i]
        return TreeModel(fit, (lambda: self._trees_of(fit)) if self.store and self.one_block else lambda: trees, self.edges)

    def release(self) -> None:
        for rdd in (self.rows, self.margins) if self.one_block else (self.state, self.stale):
            if rdd is not None:
                rdd.unpersist()


@dataclass
class TreeModel:
    """The trees of one fit with the cut points of the features. ``load`` reads the trees, when they are first asked for."""
    fit: Fit
    load: Callable[[], list[Tree]]
    edges: list[np.ndarray]

    @cached_property
    def trees(self) -> list[Tree]:
        return self.load()

    def score(self, df: DataFrame) -> DataFrame:
        """customer_id, label, prediction, score of model-matrix rows."""
        trees, edges, p = [t.arrays() for t in self.trees], self.edges, self.fit.params

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = binned(_matrix(b[2], len(edges)), edges).T
                margin = np.zeros(x.shape[1])
                for t in trees:
                    margin += t[3][walk(x, t, len(t[0]))]
                score = margin / max(1, len(trees)) if p.forest else 1 / (1 + np.exp(-margin))
                yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array((score >= 0.5).astype(np.int32)), pa.array(score)], [ID_COL, "label", "prediction", "score"])

        rows = df.select(F.col(ID_COL).cast("string").alias(ID_COL), F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
        return rows.mapInArrow(run, f"{ID_COL} string, label double, prediction int, score double")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as a table: tree, node, feature (null in leaves), threshold, left, right, value, gain. Bounded by the model's size."""
        rows = [(k, n, None if f < 0 else int(f), None if f < 0 else float(self.edges[f][t.cut[n]]), None if f < 0 else t.left[n], None if f < 0 else t.left[n] + 1, float(t.value[n]), float(t.gain[n]))
                for k, t in enumerate(self.trees) for n, f in enumerate(t.feature)]
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, value double, gain double")
