"""Orders and line items kept bucketed and sorted by order key, for jobs that join them again and again (J5).

Both tables are shuffled once, when they are stored; every later join on the order key reads matching buckets and shuffles
neither side. The number of buckets follows the size of the input unless given (about ``BUCKET_BYTES`` of it a bucket), so a
join task's share stays the same at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, input_bytes
from .tables import load, table_path

BUCKET_BYTES = 32 << 20  # as stored: a task sorts several times as much in memory
KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def bucket_count(in_bytes: int) -> int:
    """Buckets for so many bytes of both tables' files."""
    return max(8, -(-in_bytes // BUCKET_BYTES))


def store_by_order(spark: SparkSession, sf_dir: str, name: str, folder: str | None = None, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write both tables as ``<name>_orders`` and ``<name>_lineitem`` of the session's catalog, with their files below ``folder``
    (the shared checkpoint folder if not given); an earlier pair of that name is replaced. Returns (orders, lineitem)."""
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/by-order-{name}"
    buckets = buckets or bucket_count(input_bytes(spark, [table_path(sf_dir, t) for t in KEYS]))
    out = []
    for table, key in KEYS.items():
        # dealt by the key before the write: one file a bucket instead of one a task and bucket
        rows = load(spark, sf_dir, table).repartition(buckets, key)
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{table}").saveAsTable(f"{name}_{table}")
        out.append(spark.table(f"{name}_{table}"))
    return out[0], out[1]
