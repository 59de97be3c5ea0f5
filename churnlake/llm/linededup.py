"""Operator 1: line dedup by a log-template tree (DataFrame functions only).

Lines (split at line feeds) become templates in a tree of fixed depth:

1. Digit runs are masked as ``<*>``. A line's leaf is its token count and its first ``DEPTH`` masked tokens.
2. A leaf is split further on its frequent tokens: those that at least ``MIN_DOCS`` lines of different texts have at the same
   position behind the leading ones. Lines with the same frequent tokens at the same positions have one template (their other
   tokens are ``<*>``) if these make up at least ``SHARE`` of the positions behind the leading ones; any other line is a template
   of its own. So a leaf holds as many templates as recur in it, whatever else it holds, and short lines that agree in
   their leading tokens only stay apart.
3. A template is recurring if lines of it stand in at least ``MIN_DOCS`` documents of different text (copies of a whole text
   count once: they are left to the near-duplicate operators).
4. Lines of recurring templates are dropped, except in the document with the smallest doc_id that holds the template (and
   in its copies), so one specimen stays.

Only leaves that can recur are parsed: the first pass counts, per leaf, small rows of hashes with partial aggregation,
so a line in a third of all documents is one row per map task. Hashes of lines are 128 bits wide.

Defined results: null text stays null with 0 lines; a document whose lines all go keeps an empty text; empty or
blank lines are never dropped; the smallest doc_id decides ties, null doc_id last; repeated rows are copies; an empty
table gives an empty result; extra columns are passed on, clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fits, free, hash128, small
from .decontam import let

DEPTH, SHARE, MIN_DOCS = 3, 0.5, 10
BLANK = r"[\x20\x09-\x0D]+"
ADDED = ("n_lines", "n_dropped", "dropped_lines")


def _mask(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), "[0-9]+", "<*>")


def _tokens(masked: Column) -> Column:
    return F.filter(F.split(masked, BLANK), lambda t: t != "")


def _leaf(masked: Column) -> Column:
    return let(_tokens(masked), lambda t: F.xxhash64(F.size(t), F.slice(t, 1, DEPTH)))


def _texts() -> list[Column]:
    return [c.alias(f"t{i}") for i, c in enumerate(hash128(F.col("text")), 1)]


def _line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, masked): the distinct masked lines of each document."""
    lines = F.array_distinct(F.transform(F.split("text", "\n"), _mask))
    rows = docs.where("text is not null").select("doc_id", *_texts(), F.explode(lines).alias("masked"))
    return rows.where("masked <> ''")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(l1, l2, template, n_docs, keep_t1, keep_t2): the masked lines (hashed) of recurring templates."""
    slim = _line_rows(docs).select("doc_id", "t1", "t2", *[c.alias(f"l{i}") for i, c in enumerate(hash128(F.col("masked")), 1)],
                                   _leaf(F.col("masked")).alias("leaf"))
    # One row per line and text: copies of a text count once, the first document of each is kept.
    slim = cut(slim.groupBy("leaf", "l1", "l2", "t1", "t2").agg(F.min("doc_id").alias("doc_id")))
    lines = cut(slim.groupBy("leaf", "l1", "l2").agg(F.count(F.lit(1)).alias("n")))
    leaves = cut(lines.groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_lines")).where(F.col("n") >= min_docs))
    live = lines.join(leaves.select("leaf", "n_lines"), "leaf")
    # The tokens of the lines of leaves with several lines, read again from the texts.
    wanted = cut(live.where("n_lines > 1").select("l1", "l2", "leaf", "n"))
    texts = _line_rows(docs).select(*[c.alias(f"l{i}") for i, c in enumerate(hash128(F.col("masked")), 1)], "masked")
    if not fits(wanted):  # beyond a broadcast: a line in many texts is reduced to one row before it is joined
        texts = texts.groupBy("l1", "l2").agg(F.first("masked").alias("masked"))
    words = texts.join(small(wanted), ["l1", "l2"]).groupBy("l1", "l2", "leaf", "n").agg(F.first("masked").alias("masked"))
    behind = let(_tokens(F.col("masked")), lambda t: F.slice(t, F.lit(DEPTH + 1), F.greatest(F.size(t) - DEPTH, F.lit(0))))
    words = cut(words.select("l1", "l2", "leaf", "n", F.posexplode(behind).alias("pos", "token")))
    common = words.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("had")).where(F.col("had") >= min_docs)
    common = small(cut(common.select("leaf", "pos", "token", F.lit(True).alias("kept"))))
    split = words.join(common, ["leaf", "pos", "token"], "left").groupBy("l1", "l2", "leaf").agg(
        F.count(F.lit(1)).alias("size"), F.count("kept").alias("same"), F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("pos", "token")))).alias("pattern"))
    of_leaf = split.where(F.col("same") >= F.col("size") * SHARE).select("l1", "l2", F.xxhash64(F.lit("leaf"), "leaf", "pattern").alias("p"))
    template = live.join(of_leaf, ["l1", "l2"], "left").select("l1", "l2", "leaf", F.coalesce("p", F.xxhash64("l1", "l2")).alias("template"))
    template = cut(template)
    places = slim.drop("leaf").join(template.drop("leaf"), ["l1", "l2"]).groupBy("template", "t1", "t2").agg(F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2"))
    support = places.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), first.alias("f")).where(F.col("n_docs") >= min_docs)
    support = support.select("template", "n_docs", F.col("f.t1").alias("keep_t1"), F.col("f.t2").alias("keep_t2"))
    return cut(template.join(support, "template").select("l1", "l2", "template", "n_docs", "keep_t1", "keep_t2"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines that are left in ``text`` (``n_chars`` follows if there), n_lines, n_dropped and dropped_lines (their numbers from 0)."""
    docs = docs.drop(*ADDED)
    marks = recurring(docs, min_docs)
    rows = _line_rows(docs).select("t1", "t2", *[c.alias(f"l{i}") for i, c in enumerate(hash128(F.col("masked")), 1)])
    gone = rows.join(small(marks), ["l1", "l2"]).where("t1 <> keep_t1 or t2 <> keep_t2").groupBy("t1", "t2").agg(F.collect_set("l1").alias("gone"))
    t1, t2, lost = free(docs, "_t1", "_t2", "_lost")
    keyed = docs.withColumns(dict(zip((t1, t2), hash128(F.col("text")), strict=True)))
    gone = small(cut(gone.withColumnsRenamed({"t1": t1, "t2": t2, "gone": lost})), 1_000_000, lost)
    out = keyed.join(gone, [t1, t2], "left").drop(t1, t2)
    lines = F.split("text", "\n")
    one = lambda line: hash128(_mask(line))[0]
    places = let(lines, lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.array_contains(lost, one(F.get(a, i))) & (F.trim(F.get(a, i)) != "")))
    out = out.withColumn("dropped_lines", F.when(F.col(lost).isNotNull(), places).otherwise(F.array().cast("array<int>")))
    left = let(lines, lambda a: F.array_join(F.filter(a, lambda line, i: ~F.array_contains("dropped_lines", i)), "\n"))
    count = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long")
    out = out.withColumn("n_lines", count).withColumn("text", F.when(F.size("dropped_lines") > 0, left).otherwise(F.col("text")))
    out = out.withColumn("n_dropped", F.size("dropped_lines").cast("long")).drop(lost)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
