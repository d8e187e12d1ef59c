"""Where intermediate data goes: the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session that names none gets a temporary folder; on a cluster that raises."""
    for key in ("spark.checkpoint.dir", "tallyweave.shared.dir"):
        if named := spark.conf.get(key, None):
            return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    spark.conf.set("tallyweave.shared.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path; none is used twice."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Takes a scratch path away once nothing reads it any more."""
    sc = spark.sparkContext
    gone = sc._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(sc._jsc.hadoopConfiguration()).delete(gone, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, lineage cut, read by any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
