"""Operator 7: benchmark decontamination by winnowing (DataFrame functions only).

Words are lower-cased ASCII letters, digits and everything beyond ASCII. A window is ``SPAN`` consecutive words of a
benchmark item; an item with fewer words, but not none, is one window.

1. ``fingerprints``: of every ``K``-gram hash of a text, each sliding window of ``SPAN - K + 1`` hashes keeps its minimum.
   A shared run of SPAN words therefore shares a kept hash: nothing long enough is missed. Texts are read where they lie; only
   hashes leave the row.
2. The kept hashes of documents meet those of the benchmark. The benchmark's side is broadcast if a count shows it small.
3. Hits are extended: for the documents with hits, the windows around each hit are compared word by word (as
   strings) with the benchmark's windows. A matching window marks all its words.
Items under SPAN words have no full window: documents keep all their n-grams of those lengths that occur as items'
lengths, and these are matched as strings alone.

Texts are identified by two 64-bit hashes, so copies are worked once and get equal rows.

Defined results: null or wordless text has no words, no hits and is not contaminated; empty or null items have no
windows; an empty benchmark hits nothing; repeated items and repeated rows repeat their results; null item ids
are not listed; extra columns are passed on, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, hash128, small

#: Words of a window, and of a hashed k-gram (5 to 8 words are hashed, and 4 to 8 hashes compared, by overlapping fours).
SPAN, K = 13, 7
# The words of the contract, before and after lower-casing A-Z.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A document is contaminated if it has hits and SHARE * hits >= words.
SHARE = 20
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of words. lower() is exact, and fast, for texts of ASCII only; the rest is translated."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_ANY_CASE)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row: as a lambda's variable the optimiser cannot copy it into loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shift(a: Column, k: int) -> Column:
    """``a`` without its first k elements. slice() walks the whole array: it is used once per array, never per element."""
    return F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))


def _grams(hashes: Column) -> Column:
    """Hash of each K consecutive word hashes, from hashes of 2 and of 4; the last K - 1 elements reach over the end."""
    pair = lambda x, y: F.xxhash64(x, y)
    two = lambda body: let(F.zip_with(hashes, _shift(hashes, 1), pair), body)
    return two(lambda p: let(F.zip_with(p, _shift(p, 2), pair), lambda q: F.zip_with(q, _shift(q, K - 4), pair)))


def _kept(grams: Column) -> Column:
    """Minimum of every SPAN - K + 1 consecutive hashes, each once; none if the text has fewer than SPAN words."""
    least = lambda x, y: F.least(x, y)
    two = lambda body: let(F.zip_with(grams, _shift(grams, 1), least), body)
    mins = two(lambda p: let(F.zip_with(p, _shift(p, 2), least), lambda q: F.zip_with(q, _shift(q, SPAN - K + 1 - 4), least)))
    return let(mins, lambda m: F.array_distinct(F.slice(m, 1, F.greatest(F.size(m) - (SPAN - 1), F.lit(0)))))


def _key() -> list[Column]:
    return [c.alias(f"k{i}") for i, c in enumerate(hash128(F.col("text")), 1)]


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def fingerprints(df: DataFrame) -> DataFrame:
    """(k1, k2, f): the winnowed hashes of each text of SPAN words or more."""
    kept = let(_hashes(words(F.col("text"))), lambda h: let(_grams(h), _kept))
    return df.where("text is not null").select(*_key(), F.explode(kept).alias("f"))


def _words_at(w: Column, at: Column, size: Column | int) -> Column:
    return F.array_join(F.transform(F.sequence(at, at + size - 1), lambda j: F.get(w, j - 1)), " ")


def _windows(w: Column, starts: Column, size: Column | int) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("at"), _words_at(w, i, size).alias("window")))


def _all_windows(n: int) -> Callable[[Column], Column]:
    return lambda w: F.when(F.size(w) >= n, _windows(w, F.sequence(F.lit(1), F.size(w) - (n - 1)), n))


def _near(w: Column, fs: Column) -> Column:
    """The windows around the k-grams whose hash is in ``fs``: those that start up to SPAN - K words before a hit."""

    def around(g: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - (K - 1), F.lit(1))), lambda i: F.array_contains(fs, F.get(g, i - 1)))
        spread = F.transform(hits, lambda i: F.sequence(F.greatest(i - (SPAN - K), F.lit(1)), F.least(i, F.size(w) - (SPAN - 1))))
        return F.array_distinct(F.flatten(spread))

    return let(_hashes(w), lambda h: let(_grams(h), lambda g: let(around(g), lambda at: _windows(w, at, SPAN))))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, window): every window of every item, as text."""
    def all_of(w: Column) -> Column:
        size = F.least(F.size(w), F.lit(SPAN))
        of = _windows(w, F.sequence(F.lit(1), F.size(w) - size + 1), size)
        return F.when(size > 0, F.transform(of, lambda x: F.struct(size.alias("size"), x["window"].alias("window"))))

    return benchmark.where("text is not null").select("item_id", F.explode(let(words(F.col("text")), all_of)).alias("x")).select("item_id", "x.size", "x.window").distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, at, size, window) of the places where a window stands in a text, and the items' windows."""
    windows = cut(item_windows(benchmark))
    distinct = cut(windows.select("size", "window").distinct())
    sizes = sorted(r["size"] for r in distinct.select("size").distinct().collect())  # SPAN values at most
    found = None
    if SPAN in sizes:
        marks = cut(fingerprints(benchmark).select("f").distinct())
        touched = cut(fingerprints(docs).join(small(marks), "f", "left_semi").groupBy("k1", "k2").agg(F.collect_set("f").alias("fs")))
        texts = docs.where("text is not null").select(*_key(), "text").join(small(touched), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
        near = texts.select("k1", "k2", F.explode(let(words(F.col("text")), lambda w: _near(w, F.col("fs")))).alias("x"))
        found = near.select("k1", "k2", "x.at", F.lit(SPAN).alias("size"), "x.window")
    for n in (n for n in sizes if n < SPAN):
        every = let(words(F.col("text")), _all_windows(n))
        one = docs.where("text is not null").select(*_key(), F.explode(every).alias("x")).select("k1", "k2", "x.at", F.lit(n).alias("size"), "x.window")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "k1 long, k2 long, at int, size int, window string")
    hit = found.join(small(distinct), ["size", "window"], "left_semi").select("k1", "k2", "at", "size", "window").distinct()
    return cut(hit), windows


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    docs = docs.drop(*ADDED)
    places, windows = occurrences(docs, benchmark)
    covered = F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1)))
    hit = places.groupBy("k1", "k2").agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    items = places.select("k1", "k2", "size", "window").distinct().join(small(windows.where("item_id is not null")), ["size", "window"]).select("k1", "k2", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("item")).alias("items"))
    k1, k2, found, found_items = free(docs, "_k1", "_k2", "_hit", "_items")
    per = cut(hit.join(items, ["k1", "k2"], "left").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("n_hit").alias(found), F.coalesce("items", F.array().cast("array<string>")).alias(found_items)))
    out = docs.withColumns({"n_words": n_words(F.col("text"))}).withColumns(dict(zip((k1, k2), hash128(F.col("text")), strict=True)))
    out = out.join(small(per), [k1, k2], "left").drop(k1, k2)
    names = F.coalesce(found_items, F.array().cast("array<string>"))
    out = out.withColumns({"n_hit": F.coalesce(found, F.lit(0)).cast("long"), "n_items": F.size(names).cast("long"), "items_sha256": F.sha2(F.array_join(names, ",").cast("binary"), 256)})
    return out.drop(found, found_items).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    keep = [c for c in docs.columns if c not in ADDED]
    return decontaminate(docs, benchmark).where(~F.col("contaminated")).select(*keep)
