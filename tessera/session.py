"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, app: str = "tessera",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    AQE re-plans joins and coalesces partitions at runtime; skew-join splits
    hot keys.  The UI stays off: no server is started.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    (tests, a bare local session) do we set our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")  # one machine: its own folder is shared
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint root (never machine-local
    on a cluster).  Used for scratch lakes and written intermediate tables."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    name = "-".join(parts) if parts else "scratch"
    return f"{root}/tessera/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder (survives the loss
    of executors; never ``localCheckpoint``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread ``df`` over the cluster when its rows lie in fewer partitions
    than there are task slots, or most of them in few, and the next step is
    heavy per-row work.  A file's splits need not hold rows: one large row group is
    read by one task however many splits its file has, so the rows of each partition are
    counted (no column is read).  Where they are even -- the normal case on a cluster --
    it is a no-op, so no shuffle is added."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    if n >= slots:
        held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one row for each partition
        if max(held, default=0) * slots <= 2 * sum(held):
            return df
    n = max(n, slots)
    return df.repartition(n, *keys) if keys else df.repartition(n)
