"""Projections, filters and predicates (PF1-PF10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PF1: column subset in the given order (prunes the parquet scan)."""
    return df.select(*[F.col(c) for c in cols])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PF2: drop (e.g. leakage) columns."""
    return df.drop(*cols)


def exclude_columns(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """PF4: every column except ``exclude``, order kept."""
    ex = set(exclude)
    return df.select(*[F.col(c) for c in df.columns if c not in ex])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PF5: rename by mapping."""
    return df.withColumnsRenamed(dict(mapping))


def count_where(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """PF6 / PF7: several predicate counts in one pass (one row)."""
    return df.agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])


def is_member(col: str, values: Sequence) -> Column:
    """PF8: membership as a 0/1 int (NULL is not a member)."""
    return F.coalesce(F.col(col).isin(list(values)).cast("int"), F.lit(0))


def add_constant_columns(df: DataFrame, cols: Sequence[str], value=0) -> DataFrame:
    """PF10: add each missing column as a constant."""
    have = set(df.columns)
    return df.select("*", *[F.lit(value).alias(c) for c in cols if c not in have])
