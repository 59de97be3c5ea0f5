"""Operator 2: substring dedup by recompression.

Words become symbols; ``ROUNDS`` rounds name adjacent pairs. In each round a hash coin of the symbol makes it left or
right, and every left-right pair becomes one symbol named by the hash of both: a name depends on nothing but the words
under it, so it is the same wherever it is computed. A symbol spans at most 2**ROUNDS words, and a round can change at
most one symbol at either end of a repeat, so of two equal windows all symbols that touch words ``LO``..``HI`` are equal.
Runs of one symbol never pair; they stay runs of equal names, and are folded when equal rows meet in a piece of text.

Each window is entrusted to the symbol of least hash among those that touch its words LO..HI. The neighbouring windows of one
symbol make one row: ``key`` hashes the words that all windows such a symbol can have share, ``ext`` the words of all of them.

* Rows that share key and ext with another row: all their windows are repeated.
* Rows that share only the key: their windows are compared by 128-bit hashes with the windows of the others of the key.
* All other windows are unique.

One shuffle deals the rows by key, sorted; neighbours are compared in a stream, so nothing is gathered per key. Before it,
equal keys of a piece of text are settled there, and one row goes on: a passage in a third of all documents costs one row a piece.
Copies of a whole text are settled by their hash beforehand.

Defined results: null text is empty: 0 words and an empty kept text; texts under WINDOW words keep all; repeated rows
are copies and lose everything (if of WINDOW words); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, Words, as_signed, cut, hash128, mix64, pieces, small

WINDOW, ROUNDS = 35, 3
#: Words of a window whose symbols are compared; 2**ROUNDS - 1 words at either end may be parsed differently.
LO, HI = 11, 23
assert LO >= 2**ROUNDS - 1 and HI <= WINDOW - 2**ROUNDS
PRESENT, REPEATED, CHECK = 0, 1, 2
_U = np.uint64


def parse(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, first word) of the symbols after all rounds; pairs do not cross texts."""
    name, at = words, np.arange(len(words))
    opens = np.zeros(len(words) + 1, bool)
    opens[first] = True
    opens = opens[:-1]
    for r in range(ROUNDS):
        right = (mix64(name ^ _U(0xA5A5 + 77 * r)) & _U(1)).astype(bool)
        i = np.flatnonzero(~right[:-1] & right[1:] & ~opens[1:])
        pair = mix64(name[i] * _U(0x9E3779B97F4A7C15) + mix64(name[i + 1] + _U(r + 1)))
        name = name.copy()
        name[i] = pair
        keep = np.ones(len(name), bool)
        keep[i + 1] = False
        name, at, opens = name[keep], at[keep], opens[keep]
    return name, at


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    done, out = 1, x
    while done * 2 <= width:
        out, done = np.minimum(out[:-done], out[done:]), done * 2
    rest = width - done
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchored(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, key, ext) of the rows of a piece; windows count from the text's first word."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    if len(words) < WINDOW:
        return none
    name, at = parse(words, first)
    size = np.diff(np.append(at, len(words)))
    symbol = np.repeat(np.arange(len(at)), size)
    value = mix64(name + _U(99))[symbol]
    low = _least(value[LO:], HI - LO + 1)[:len(words) - WINDOW + 1]
    n, chosen = len(low), np.full(len(low), -1)
    for k in range(HI, LO - 1, -1):  # the leftmost wins
        same = value[k:k + n] == low
        chosen[same] = symbol[k:k + n][same]
    text = np.searchsorted(first, np.arange(n), "right") - 1
    whole = np.arange(n) + WINDOW <= first[text + 1]
    start = np.flatnonzero(whole)
    if not len(start):
        return none
    chosen, text = chosen[start], text[start]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    text, b, length, lo, hi = text[new], at[chosen[new]], size[chosen[new]], start[new], start[last]
    a0, a1 = Prefix(words, 0), Prefix(words, 1)
    key = a0.of(b + length - (LO + 1), b + WINDOW - HI)
    left, right = np.maximum(b - HI, first[text]), np.minimum(b + length - (LO + 1) + WINDOW, first[text + 1])
    ext = mix64(a1.of(left, right) + mix64((b - left).astype(_U) * _U(64) + (right - b).astype(_U)))
    return text, lo - first[text], hi - first[text], key, ext


def _beside(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = x[1:] == x[:-1]
    return np.concatenate([[False], same]), np.concatenate([same, [False]])


def settle(key: np.ndarray, ext: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, to check) of rows sorted by key, ext: with an equal row beside; at the border of two exts of one key."""
    key_before, key_after = _beside(key)
    same_before, same_after = _beside(ext)
    same_before &= key_before
    same_after &= key_after
    return same_before | same_after, (key_before & ~same_before) | (key_after & ~same_after)


MARKS = "key long, ext long, rid long, lo long, hi long, kind int"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())


def _marks(key, ext, rid, lo, hi, kind) -> pa.RecordBatch:
    cols = [as_signed(key), as_signed(ext), rid, lo, hi, kind]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), t) for c, t in zip(cols, _TYPES, strict=True)], MARKS.replace(" long", "").replace(" int", "").split(", "))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: the rows of each piece; equal keys of the piece are settled, one row of each key goes on."""
    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        for first_row, end_row, data, offsets in pieces(batch.column(1)):
            w = Words(data, offsets, lower=False)
            text, lo, hi, key, ext = anchored(w.hash, w.first)
            if not len(key):
                continue
            order = np.lexsort((ext, key))
            key, ext, lo, hi, rid = key[order], ext[order], lo[order], hi[order], rids[first_row:end_row][text[order]]
            repeated, check = settle(key, ext)
            key_before, _ = _beside(key)
            same_before = key_before & _beside(ext)[0]
            check = _groups_with(key, ~same_before & key_before) & ~same_before
            for pick, kind in ((~key_before, PRESENT), (repeated, REPEATED), (check, CHECK)):
                # settled rows only pass through the shuffle: a key of their own spreads them
                k = key[pick] if kind == PRESENT else mix64(rid[pick].view(_U) + lo[pick].astype(_U))
                yield _marks(k, ext[pick], rid[pick], lo[pick], hi[pick], np.full(int(pick.sum()), kind, np.int32))


def _groups_with(key: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """For each row of sorted ``key``: does its group hold a flag?"""
    start = np.flatnonzero(~_beside(key)[0])
    return np.repeat(np.logical_or.reduceat(flag, start), np.diff(np.append(start, len(key))))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: sorted rows; each is compared with its neighbours, across batches too. Only findings go on."""
    held: list[np.ndarray] | None = None
    first = True

    def out(cols: list[np.ndarray], from_row: int, to_row: int) -> Iterator[pa.RecordBatch]:
        key, ext, rid, lo, hi, kind = cols
        repeated, check = settle(key, ext)
        present = kind == PRESENT
        for pick, name in (((present & repeated) | (kind == REPEATED), REPEATED), ((present & check) | (kind == CHECK), CHECK)):
            p = np.flatnonzero(pick[from_row:to_row]) + from_row
            if len(p):
                yield _marks(key[p], ext[p], rid[p], lo[p], hi[p], np.full(len(p), name, np.int32))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)] if held else cols
        # The first row is the one before the last of the batch before: settled already, there for comparison only.
        yield from out(cols, 0 if first else 1, len(cols[0]) - 1)
        first = first and len(cols[0]) < 2
        held = [c[-2:] if len(c) > 1 else c for c in cols]
    if held:
        yield from out(held, 0 if first else len(held[0]) - 1, len(held[0]))


CHECKS = "rid long, at long, w1 long, w2 long"


def _check_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of the windows to check; column 2 has the (lo, hi) of each text."""
    for batch in batches:
        rids, spans = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        for first_row, end_row, data, offsets in pieces(batch.column(1)):
            w = Words(data, offsets, lower=False)
            a, b = Prefix(w.hash, 0), Prefix(w.hash, 1)
            for i in range(first_row, end_row):
                at = np.unique(np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans[i].as_py()]))
                lo = at + w.first[i - first_row]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), rids[i])), pa.array(at), pa.array(as_signed(a.of(lo, lo + WINDOW))), pa.array(as_signed(b.of(lo, lo + WINDOW)))], ["rid", "at", "w1", "w2"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, copied, spans: the kept words of each text, joined by one space."""
    for batch in batches:
        ids, copied, spans = batch.column(0), batch.column(2).to_pylist(), batch.column(3)
        for first_row, end_row, data, offsets in pieces(batch.column(1)):
            w = Words(data, offsets, lower=False)
            change = np.zeros(len(w.start) + 1, np.int64)
            for i in range(first_row, end_row):
                lo, hi = w.first[i - first_row], w.first[i - first_row + 1]
                if copied[i] and hi - lo >= WINDOW:
                    change[lo] += 1
                    change[hi] -= 1
                elif spans[i].is_valid:
                    s = spans[i].values
                    np.add.at(change, lo + s.field(0).to_numpy(), 1)
                    np.add.at(change, lo + s.field(1).to_numpy() + WINDOW, -1)
            keep = np.cumsum(change)[:-1] == 0
            text = np.repeat(np.arange(end_row - first_row), np.diff(w.first))
            k = np.flatnonzero(keep)
            joined = k[:-1][text[k[1:]] == text[k[:-1]]] if len(k) else k
            mask = np.zeros(len(data) + 1, np.int8)
            np.add.at(mask, w.start[k], 1)
            np.add.at(mask, w.end[k], -1)
            mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
            mask[w.end[joined]] = True
            data = data.copy()
            data[w.end[joined]] = 0x20
            ends = np.concatenate([[0], np.cumsum(mask)])[offsets].astype(np.int32)
            kept = pa.StringArray.from_buffers(end_row - first_row, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[mask].tobytes()))
            words = np.diff(w.first)
            removed = words - np.bincount(text[k], minlength=end_row - first_row)
            yield pa.RecordBatch.from_arrays([ids[first_row:end_row], kept, pa.array(words.astype(np.int64)), pa.array(removed.astype(np.int64))], ["doc_id", "text", "n_words", "n_removed"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(rid, lo, hi): first windows lo..hi of each text whose words stand elsewhere too. ``texts``: rid, text, one row per text."""
    rows = texts.select("rid", "text").mapInArrow(_rows, MARKS)
    marks = cut(rows.repartition("key").sortWithinPartitions("key", "ext").mapInArrow(_meet, MARKS).select("rid", "lo", "hi", "kind"))
    sure = marks.where(F.col("kind") == REPEATED).select("rid", "lo", "hi")
    doubt = cut(marks.where(F.col("kind") == CHECK).groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    found = cut(texts.join(doubt, "rid").select("rid", "text", "spans").mapInArrow(_check_rows, CHECKS))
    twice = cut(found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"))
    return sure.unionByName(found.join(small(twice), ["w1", "w2"], "left_semi").select("rid", F.col("at").alias("lo"), F.col("at").alias("hi")))


OUT = "doc_id long, text string, n_words long, n_removed long"


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, n_removed): each text without the words of repeated windows, words joined by one space."""
    keys = dict(zip(("rid", "rid2"), hash128(F.col("text")), strict=True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns(keys)
    copies = cut(docs.where("text is not null").groupBy("rid", "rid2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("one")).where("copies > 1"))
    marked = docs.join(small(copies), ["rid", "rid2"], "left")
    texts = marked.where("text is not null and (copies is null or doc_id <=> one)")
    spans = repeated_spans(texts).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    # Copies need no spans: with a key of their own they do not crowd the join.
    marked = marked.withColumn("_to", F.when(F.col("copies").isNull(), F.col("rid")))
    spread = F.coalesce("_to", F.xxhash64("doc_id"))
    out = marked.withColumn("_at", spread).join(spans.withColumnRenamed("rid", "_at"), "_at", "left")
    out = out.select("doc_id", "text", F.coalesce(F.col("copies") > 1, F.lit(False)).alias("copied"), F.when(F.col("_to").isNotNull(), F.col("spans")).alias("spans"))
    return out.mapInArrow(_cut_out, OUT)
