"""A training log that grows: batches of a stream appended once each, however often they are tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_log(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts writing a stream's rows to ``folder``, a directory for each batch.

    A batch that is tried again, after a failure between its rows and the checkpoint,
    replaces its own directory, so no row is there twice.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The rows so far, with ``logged``: later batches after earlier ones, then by the rows' own order if they have one."""
    rows = spark.read.parquet(folder)
    own = F.col("logged") if "logged" in rows.columns else F.lit(0).cast("long")
    return rows.withColumn("logged", F.struct(F.col("batch").cast("long").alias("batch"), own.alias("own")))
