"""Table sources: parquet/CSV/JSON scans with explicit schemas (IO1, IO2, IO5)."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan one of the given parquet tables; ``columns`` prunes the read schema."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType | str | None = None, **options) -> DataFrame:
    """IO1: load a table with an explicit schema (no inference on big inputs).

    ``fmt`` is one of parquet, csv (header row expected) or json (one record
    per line). A schema is applied as the read schema, so CSV/JSON never need
    an inference pass over the data.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(fmt).load(path)


def read_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """IO2: one JSON object (possibly spanning lines) as a one-row DataFrame."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for
    cluster file systems as well as local paths)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def source_or_fallback(spark: SparkSession, primary_path: str,
                       primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> DataFrame:
    """IO5: plan-time choice between two inputs by existence of ``primary_path``."""
    return primary() if path_exists(spark, primary_path) else fallback()
