"""Operator 3: mixing sources to target weights (DataFrame functions only).

``allocate`` gives each document the number of its copies, ``mix`` emits them.

1. Sizes (words) are summed per source; partial aggregation makes a hot source no heavier than another.
2. Sources in code point order, null last, weigh 1, 2, 3, repeating (or as given) and share the total of all sizes.
   A target stops at ``MOST`` times its source's size; the excess is reshared by weight. The level at which it
   settles comes in closed form from the sources sorted by cap / weight, not by repeated passes.
3. A document of a source with rate r = target / size is taken floor(r) times, and once more if a uniform number
   hashed from (seed, doc_id) is under r - floor(r).

Defined results: null text has size 0; a null source is a source; sources of size 0 have target 0 and rate 0, their
documents are not taken; an empty table gives an empty result; repeated rows are documents of their own with the same
draw; extra columns are passed on, columns that clash with the added ones are replaced.

The table of sources has one row per source; it is ordered in one task and broadcast only if it counts at most
``BROADCAST_ROWS`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, n_words, small

#: No source, hence no document, is taken more often than this.
MOST = 3
#: Weights by position of the source, repeating.
CYCLE = (1, 2, 3)
SEED = 20_240_601
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def targets(docs: DataFrame, size: Column | None = None, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target, rate), one row per source."""
    sums = docs.select("source", (n_words(F.col("text")) if size is None else size).alias("size"))
    sums = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle)).cast("int") + 1)
    rows = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    # Source i is capped when the shares do not yet use up the total at the level at which i reaches its cap.
    to_here = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.sum("source_size").over(everything).cast("double").alias("total"), F.sum("weight").over(everything).alias("weights"),
                       F.sum("cap").over(to_here).alias("caps_to"), F.sum("weight").over(to_here).alias("weights_to"))
    rows = rows.withColumn("full", F.col("caps_to") + F.col("cap") / F.col("weight") * (F.col("weights") - F.col("weights_to")) < F.col("total"))
    full = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(everything), F.lit(0.0))
    rows = rows.select("*", full("cap").alias("caps_full"), full("weight").alias("weights_full"))
    level = (F.col("total") - F.col("caps_full")) / F.nullif(F.col("weights") - F.col("weights_full"), F.lit(0.0))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    rows = rows.withColumn("target", target)
    return rows.select("source", "source_size", "weight", "target", F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("rate"))


def allocate(docs: DataFrame, seed: int = SEED, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken (size times copies)."""
    docs = docs.drop(*ADDED)
    (own,) = free(docs, "_source")
    per = cut(targets(docs, cycle=cycle, most=most)).select(F.col("source").alias(own), "source_size", "target", "rate")
    out = docs.withColumn("size", n_words(F.col("text"))).join(small(per), F.col("source").eqNullSafe(F.col(own))).drop(own)
    # 32 bits of md5, so that SQL engines draw alike
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    whole = F.floor("rate")
    out = out.withColumn("copies", (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("long"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with ``copy`` counting from 0."""
    keep = [c for c in docs.columns if c not in (*ADDED, "copy")]
    out = allocate(docs, **how).where("copies > 0")
    return out.select(*keep, F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
