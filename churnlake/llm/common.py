"""Helpers shared by the training-data operators.

Words are runs of bytes outside white space (0x20, 0x09-0x0D). UTF-8 bytes
above 0x7F are word bytes, so byte and code point views give the same words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Words of a text, as a Java / Python / RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handled in pieces of whole documents of about so many bytes.
CHUNK_BYTES = 1 << 20
#: A side with at most this many rows of a few numbers may be broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows written as a Parquet table in the shared checkpoint folder: lost executors cost no recomputation, the
    table is compressed, and later plans know its size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, cells: str | None = None) -> bool:
    """Does ``df`` (already cut, narrow) have at most ``rows`` rows, or elements of its array column ``cells``?"""
    return (df.agg(F.sum(F.size(cells) + 1)).first()[0] or 0 if cells else df.count()) <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS, cells: str | None = None) -> DataFrame:
    """``df``, marked for broadcast if a count proves it small. A join that is not broadcast falls to Spark's shuffled joins
    with skew splitting."""
    return F.broadcast(df) if fits(df, rows, cells) else df


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that ``df`` has."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)]


# numpy side -----------------------------------------------------------------

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15 | 1), _U(0xC2B2AE3D27D4EB4F | 1))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (shift, multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, base: np.uint64):
        inverse = pow(int(base), -1, 1 << 64)
        self._bases, self._tables = (base, _U(inverse)), [np.ones(1, _U), np.ones(1, _U)]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables[0]) < n:
            size = max(n, 2 * len(self._tables[0]), 1 << 16)
            for k, base in enumerate(self._bases):
                steps = np.full(size, base, _U)
                steps[0] = 1
                self._tables[k] = np.cumprod(steps, dtype=_U)
        return self._tables[0][:n], self._tables[1][:n]


POWERS = [Powers(b) for b in _BASES]


class Prefix:
    """Prefix sums of v[i] * base**i: the hash of any slice in constant time."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self._down = POWERS[which].get(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * up[:-1], dtype=_U, out=self._sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self._sums[hi] - self._sums[lo]) * self._down[lo] + (hi - lo).astype(_U))


def _byte_table(lower: bool) -> np.ndarray:
    code = np.arange(256)
    if lower:
        code = np.where((code >= 65) & (code <= 90), code + 32, code)
    return mix64(mix64(code.astype(_U) + _U(12345)))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES = {low: _byte_table(low) for low in (False, True)}


class Words:
    """Words of a piece: ``hash`` and byte range of each, ``first[k]`` is the first word of text k."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data, n = data, len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = Prefix(_VALUES[lower][data]).of(self.start, self.end)


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets within them) of a string column, whole texts of about ``limit`` bytes together."""
    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def as_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys in a stream sorted by them, one at a time."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        of = [batch[c].to_numpy(zero_copy_only=False) for c in keys]
        ends = [*(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in of])) + 1).tolist(), batch.num_rows]
        if parts and any(parts[-1][c][-1].as_py() != batch[c][0].as_py() for c in keys):
            yield pa.Table.from_batches(parts)
            parts = []
        start = 0
        for end in ends:
            parts.append(batch.slice(start, end - start))
            start = end
            if end < batch.num_rows:
                yield pa.Table.from_batches(parts)
                parts = []
    if parts:
        yield pa.Table.from_batches(parts)


def memo(fn):
    """``fn`` with its results kept; unlike functools' caches it can be shipped to workers by value."""
    known: dict = {}

    def get(*args):
        if args not in known:
            if len(known) > 10_000:
                known.clear()
            known[args] = fn(*args)
        return known[args]

    get.__doc__ = fn.__doc__
    return get


# graph ----------------------------------------------------------------------


def components(edges: DataFrame, jumps: int = 60) -> DataFrame:
    """(id, comp): for every node of the undirected ``edges`` (a, b) the smallest node it reaches.

    Each round takes the least label among the neighbours and then the label of that label, so long chains
    shrink by doubling; every round is written to the checkpoint folder. A hub's neighbours are reduced by partial
    aggregation. Rounds end when no label changes; running out of ``jumps`` is an error, not a cut result."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.where("a <> b").distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    for _ in range(jumps):
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = label.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = label.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        step = cut(step.join(up, "comp").select("id", "old", F.least("comp", "up").alias("comp")))
        label = step.select("id", "comp")
        if step.where("comp <> old").isEmpty():
            return label
    raise RuntimeError("components: labels still change")
