"""Tables written once and read again, in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset a temporary folder of this machine, on local masters alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once however often it is read, and lost with no executor.

    It goes when the application ends.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    context = df.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)
