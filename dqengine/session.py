"""Session defaults and the shared checkpoint folder.

On a cluster the operator names a shared folder in ``spark.checkpoint.dir``;
we read it from the session and only fall back to a fresh local folder when
nothing is configured (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "dqengine") -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("DQ_DRIVER_MEMORY", "16g")))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    local master (tests, laptops) gets a fresh scratch folder; any other
    master is refused, because executors would each write to their own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(
            f"spark.checkpoint.dir is unset on master {master!r}: name a folder that "
            "the driver and all executors share (hdfs://, s3a://, a mounted path)")
    d = tempfile.mkdtemp(prefix="dq-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def stage_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder for written
    intermediate tables; the driver's JVM removes it when it exits."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/dq-stage-{uuid.uuid4().hex[:12]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a (small) result table to the shared folder and read it back.

    This cuts the lineage: later plans read a few Parquet files instead of
    re-planning and re-running the work that produced them, and a lost
    executor cannot force that work to run again.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
