"""Cutting lineage, sizing partitions, and small helpers on DataFrames."""

from __future__ import annotations

import gc
import time
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


#: Seconds after a table is written in which its plan is let go: by listeners that hear of the end, and by the thread that tells the JVM what Python has dropped.
SETTLES = 0.3


def tidy(spark: SparkSession) -> None:
    """Asks both collectors to run: shuffle files go with the last reference to what they were for."""
    gc.collect()
    time.sleep(SETTLES)
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    What was computed survives lost executors, is computed once however often it
    is used, and its shuffle files can go: the driver's collector is asked to run,
    since Spark drops shuffle files only with the last reference to them.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    tidy(spark)
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


#: Where tables that ``cut`` wrote stand, as long as they are named.
_paths: dict[int, str] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that nothing reads any more; a table from elsewhere stays."""
    for df in tables:
        path = _paths.pop(id(df), None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch at most; documents are long, and a Python worker holds a batch several times over.
BATCH_ROWS = 1000


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, and no rows without an id; further columns never clash with its own.

    Also holds the session's Arrow batches to BATCH_ROWS rows, which bounds workers' memory.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs.select(*columns).where(F.col(columns[0]).isNotNull())


def spare(df: DataFrame, name: str) -> str:
    """``name``, with as many signs added as it takes to be no column of ``df`` yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
