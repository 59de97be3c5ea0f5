"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Defaults for a local test session. On a cluster, the values from
# spark-defaults / the submitting job win because getOrCreate() reuses the
# existing session and we only fill in settings that are unset.
_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "churnlake", cpus: int | str = "*", shuffle_partitions: int = 8,
              driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench (cluster jobs pass their own)."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder there; we only set our own when it is
    unset on a local master (tests), and then under a fresh directory in
    /tmp. On any other master a machine-local folder would lose data with
    its machine, so an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {sc.master}")
        import tempfile
        conf_dir = tempfile.mkdtemp(prefix="churnlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the input files (Hadoop FileSystem content summary:
    metadata only, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        jp = jvm.org.apache.hadoop.fs.Path(p)
        fs = jp.getFileSystem(conf)
        if fs.exists(jp):
            total += int(fs.getContentSummary(jp).getLength())
    return total


TARGET_PARTITION_BYTES = 256 << 20


def tune_for_scale(spark: SparkSession, in_bytes: int, target_partition_bytes: int = TARGET_PARTITION_BYTES,
                   max_shuffle_partitions: int = 200_000) -> dict[str, str]:
    """Size scan splits and shuffle partitions for the input at hand.

    Scans read ``target_partition_bytes`` per task; the initial shuffle
    partition count is the input size over the same target (AQE then
    coalesces small ones and splits skewed ones to the advisory size).
    Settings the user or cluster set explicitly are left alone; only keys
    still at their defaults are changed. Returns what was set."""
    # values that mean "nobody chose this": Spark's defaults
    defaults = {"spark.sql.shuffle.partitions": {"200"},
                "spark.sql.files.maxPartitionBytes": {"128MB", "128m", "134217728", "134217728b"}}
    want = {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(max(8, min(max_shuffle_partitions, in_bytes // target_partition_bytes + 1))),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    done = {}
    for k, v in want.items():
        cur = spark.conf.get(k, None)
        chosen = k in defaults and cur is not None and cur not in defaults[k]
        if not chosen and cur != v:
            spark.conf.set(k, v)
            done[k] = v
    return done
