"""Session helpers that every job shares."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between the JVM and a Python worker; some copies of it are held on both sides.
BATCH_BYTES = 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, Arrow batches bounded in bytes, and a checkpoint folder known.

    A folder named in ``spark.checkpoint.dir`` is used as it is. Where none is set, a
    local one takes its place if the session runs on this machine alone; on a cluster
    executors couldn't share it, so that is an error.
    """
    sc = spark.sparkContext
    have = sc.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if int(re.sub(r"\D", "", most) or 0) == 64 << 20:  # the default; another value is the user's choice
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a small table dealt evenly to all shuffle partitions, before each becomes many."""
    return rows.repartition(shuffle_partitions(rows.sparkSession))
