"""Sinks: CSV with header (IO3) and JSON documents (IO4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO3: header row, no index column; one file per partition (a cluster
    writes in parallel; no coalesce to one task)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_document(doc: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO4: write a one-row document. ``doc`` either has a string ``json``
    column already or is a struct-shaped row that is encoded here."""
    if doc.columns != ["json"]:
        doc = doc.select(F.to_json(F.struct(*[F.col(c) for c in doc.columns])).alias("json"))
    doc.write.mode(mode).text(path)


def write_document_rows(doc: DataFrame, name: str, rows: DataFrame, order: str, path: str) -> None:
    """IO4 for a document with an array of any length: the one-row ``doc`` (a ``json`` column holding an object with at least
    one field), to which field ``name`` is added with one record per row of ``rows``, by ``order`` (a unique bigint from 0, itself left out).

    The array is written as ordered parts, one line a record: the range-partitioned sort writes them in parallel and nothing
    is gathered. The files joined by name are one JSON document; ``read_document_rows`` reads the records back. The one row of ``doc``
    is worked out once, before the sort: its sampling and the closing line would each run all of the document's aggregates again."""
    ensure_checkpoint_dir(doc.sparkSession)
    doc = doc.select("json").checkpoint(eager=True)
    fields = [F.col(c) for c in rows.columns if c != order]
    first = rows.agg(F.min(order)).head()[0]
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    # a blank in front of the first record, a comma in front of the others
    lines = rows.select(F.col(order).alias("at"), F.concat(F.when(F.col(order) == F.lit(first), " ").otherwise(","), record).alias("value"))
    head = doc.select(F.lit(-1).cast("long").alias("at"), F.concat(F.expr("substr(json, 1, length(json) - 1)"), F.lit(f',"{name}":[')).alias("value"))
    tail = doc.select(F.lit((1 << 63) - 1).alias("at"), F.lit("]}").alias("value"))
    head.unionByName(lines).unionByName(tail).orderBy("at").select("value").write.mode("overwrite").text(path)


def read_document_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The records of the array of a document written by ``write_document_rows``, in no promised order."""
    lines = spark.read.text(path).filter(F.substring("value", 1, 1).isin(" ", ","))
    return lines.select(F.from_json(F.expr("substr(value, 2)"), schema).alias("r")).select("r.*")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Hand-over between stages as parquet (cuts lineage; survives executor loss)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
