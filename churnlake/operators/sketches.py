"""Profiles of a table that grows load by load (AG2, AG7, AG30): one mergeable distinct-count sketch per column and load.

A load is read once, when it arrives; a later profile merges the stored sketches and reads no rows. Counts of values are
HyperLogLog estimates; rows, missing values and the columns are exact. ``profile.column_profile`` and ``profile.duplicate_ids``
give the exact figures when asked for.

A sketch of 2^LG_K registers has a standard error of 1.04 / sqrt(2^LG_K); ``ERROR`` is four of them (1 in 16,000 estimates
falls outside). Size: at most 2^LG_K bytes a column and load, whatever the rows.

Defined results: null and NaN are missing, not values; columns that a load lacks are missing in all its rows; an empty load has
empty sketches; a load written again under its name replaces the earlier one, so a retried job counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .profile import _as_key, dtype_name

LG_K = 14
ERROR = 4 * 1.04 / 2 ** (LG_K / 2)


def load_sketches(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, present, sketch) of one load: one scan and one aggregate, partially merged in the tasks."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        key = _as_key(df, c)
        aggs += [F.count(key).alias(f"_p{i}"), F.hll_sketch_agg(key, F.lit(LG_K)).alias(f"_s{i}")]
    types = {f.name: dtype_name(f.dataType) for f in df.schema.fields}
    return df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col("_rows").alias("rows"), F.col(f"_p{i}").alias("present"), F.col(f"_s{i}").alias("sketch"))
        for i, c in enumerate(cols)])))


def add_load(df: DataFrame, path: str, load: str) -> None:
    """Store the sketches of a load in their own folder below ``path``."""
    load_sketches(df).write.mode("overwrite").parquet(f"{path}/load={load}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of all loads, with the load's name."""
    return spark.read.option("mergeSchema", True).parquet(path)


def merged_profile(sketches: DataFrame) -> DataFrame:
    """AG2 / AG30 over all loads: column, dtype (the first by name where loads differ), rows, missing, n_unique (estimate)."""
    total = sketches.select("load", "rows").distinct().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    per = sketches.groupBy("column").agg(F.min("dtype").alias("dtype"), F.sum("present").alias("_p"),
                                         F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_unique"))
    return per.crossJoin(F.broadcast(total)).select("column", "dtype", "rows", (F.col("rows") - F.col("_p")).alias("missing"), "n_unique")


def merged_duplicates(sketches: DataFrame, key: str) -> DataFrame:
    """AG7 over all loads: rows less distinct ids (a missing id counts as one), never under 0. The error is that of the distinct
    count, ``ERROR`` times the ids, not times the duplicates: for few duplicates ask for the exact figure."""
    p = merged_profile(sketches).filter(F.col("column") == key)
    distinct = F.col("n_unique") + (F.col("missing") > 0).cast("long")
    return p.select(F.greatest(F.lit(0).cast("long"), F.col("rows") - distinct).alias("duplicate_ids"))
