"""Operator 13: runs of repeated word sequences by descending-LCP Kruskal (Arrow batches, no shuffle).

A run is a stretch of words with smallest period q, at least ``POWER`` * q and at least ``SHORTEST`` words long, that no
neighbouring word extends. Texts are handled whole, in pieces of about 1 MB together:

1. Prefix doubling ranks the suffixes of every text; only positions whose rank is shared go on to the next round, so text that
   does not repeat is settled in the first rounds. The ranks of all rounds give the longest common prefix (LCP) of suffixes
   that are neighbours in sorted order, in logarithmically many array steps.
2. Kruskal: these neighbours are united by descending LCP. Each class keeps its positions in order, the smaller set goes into
   the larger.
3. When positions p < p + d become neighbours in a class at LCP l, d is the smallest period of the words p to p + d + l if
   d <= l; the stretch cannot grow to the right, and if the words before p and p + d differ, not to the left either: it is a run.
   Every run is met exactly once, at its start. Neighbours whose LCP is too short for any run of the wanted size are left out.

Words are compared by 64-bit hashes within one text. Memory: a few integers per word of a piece (a text longer than a piece is
a piece of its own) for each doubling round.

Defined results: null and blank texts have no words and no runs; texts of any length are read whole; all words of a text equal
is one run of period 1; repeated rows are handled one by one; an empty table gives an empty result; other columns are passed
on, columns called n_words, runs or collapsed are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, pieces
from .decontam import let

SHORTEST, POWER = 6, 4
ADDED = ("n_words", "runs", "collapsed")
RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _regroup(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Index, in sorted order, of the first member of each element's group; groups are equal in all ``keys``."""
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _shared(rank: np.ndarray) -> np.ndarray:
    """Sorted ranks that have an equal one beside."""
    same = rank[1:] == rank[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same])


def neighbours(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, LCP) of the suffixes of one text that are neighbours in sorted order and share ``least`` words or more.
    ``first`` has the first word of every text and the end of the last."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    order = np.lexsort((words, text))
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    group = _regroup(order, words, text)
    rank[order] = group
    levels, width = [rank.copy()], 1
    live = order[_shared(group)]
    wanted = live
    while len(live):
        follow = np.where(live + width < end[live], rank[np.minimum(live + width, n)], -1)
        by = np.lexsort((follow, rank[live]))
        live, follow = live[by], follow[by]
        old = rank[live]
        new = np.ones(len(live), bool)
        new[1:] = (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])
        at = np.arange(len(live))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        rank[live] = old + np.maximum.accumulate(np.where(new, at, 0)) - start
        width *= 2
        levels.append(rank.copy())
        live = live[_shared(rank[live])]
        if width <= least:
            wanted = live
    level = least.bit_length() - 1  # neighbours share at least 2**level <= least words
    if len(levels) <= level or not len(wanted):
        return (np.zeros(0, np.int64),) * 3
    near = levels[level]
    wanted = wanted[np.argsort(rank[wanted], kind="stable")]
    i, j = wanted[:-1], wanted[1:]
    pair = near[i] == near[j]
    i, j = i[pair], j[pair]
    lcp = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + lcp, j + lcp
        same = (a < end[i]) & (b < end[j]) & (levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)])
        lcp += same.astype(np.int64) << k
    long = lcp >= least
    return i[long], j[long], lcp[long]


def kruskal(edges: Iterator[tuple[int, int, int]], words: np.ndarray, begin: int, shortest: int, power: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) from the edges (i, j, LCP) of one text by descending LCP."""
    home: dict[int, list[int]] = {}
    found = []

    def meet(p: int, q: int, lcp: int) -> None:
        d = q - p
        if lcp >= (power - 1) * d and lcp + d >= shortest and (p == begin or words[p - 1] != words[q - 1]):
            found.append((p - begin, lcp + d, d))

    for i, j, lcp in edges:
        few, many = home.get(i) or [i], home.get(j) or [j]
        if len(few) > len(many):
            few, many = many, few
        last = len(few) - 1
        for t, x in enumerate(few):
            at = bisect_left(many, x)
            if at and (t == 0 or few[t - 1] < many[at - 1]):
                meet(many[at - 1], x, lcp)
            if at < len(many) and (t == last or few[t + 1] > many[at]):
                meet(x, many[at], lcp)
        if last:
            many += few
            many.sort()
        else:
            many.insert(at, few[0])
        for x in few:
            home[x] = many
        if len(many) == 2:
            home[many[0]] = home[many[1]] = many
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def _batches(shortest: int, power: int):
    least = min(max(shortest, power * d) - d for d in range(1, shortest + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            for lo, hi, data, offsets in pieces(batch.column(0)):
                w = Words(data, offsets, lower=False)
                i, j, lcp = neighbours(w.hash, w.first, least)
                text = np.searchsorted(w.first, i, "right") - 1
                by = np.lexsort((j, i, -lcp, text))
                bounds = np.searchsorted(text[by], np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    begin, n = int(w.first[k]), int(w.first[k + 1] - w.first[k])
                    at = by[bounds[k]:bounds[k + 1]]
                    got = kruskal(zip(i[at].tolist(), j[at].tolist(), lcp[at].tolist(), strict=True), w.hash, begin, shortest, power) if len(at) else []
                    parts = data[offsets[k]:offsets[k + 1]].tobytes().split()
                    if got:
                        parts = [parts[x] for x in np.flatnonzero(_kept(n, got)).tolist()]
                    sizes.append(n)
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in got])
                    texts.append(b" ".join(parts))
            added = [pa.array(sizes, pa.int64()), pa.array(runs, _RUN), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], [*batch.schema.names[1:], *ADDED])
    return run


def find(docs: DataFrame, text: Column | None = None, shortest: int = SHORTEST, power: int = POWER) -> DataFrame:
    """The columns of ``docs`` but the text, with n_words, runs (by start, then period) and collapsed: the words that no run
    contains after its first period, joined by one space. ``text`` is the column ``text`` unless another is given."""
    rest = [F.col(c) for c in docs.columns if c not in ADDED and c != "text"]
    rows = docs.select(F.coalesce(text if text is not None else F.col("text"), F.lit("")).cast("string").alias("_text"), *rest)
    added = T.StructType.fromDDL(f"n_words bigint, runs array<{RUN}>, collapsed string")
    return rows.mapInArrow(_batches(shortest, power), T.StructType([*rows.schema.fields[1:], *added.fields]))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals; null without runs."""
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: F.when(more(best, x), x).otherwise(best))


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The words of a text, where a hash of the id says so with its end made periodic (else the text unchanged): with
    h = crc32(decimal id), g = h div 10, words from a = g % n on repeat the p = 1 + (n - a) div (3 + g % 8) words from there."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def made(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.when(n > 0, F.array_join(F.transform(moved, lambda i: F.get(w, i.cast("int"))), " "))

    return F.coalesce(F.when(F.pmod(h, F.lit(10)) == 0, let(words, made)), text)
