"""Ranks and running sums over an order, without a sort or a sum in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..storage import stored


def _running(weight: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, at = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            own = np.ones(n, np.int64) if weight is None else batch.column(batch.schema.get_field_index(weight)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            ends = at + np.cumsum(own)
            more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(no, no + n)), pa.array(ends - own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_part", "_no", "_at"])
            no, at = no + n, int(ends[-1]) if n else at

    return run


def ranked(df: DataFrame, order: list[str], weight: str | None = None, name: str = "ranked", ranged: bool = False) -> DataFrame:
    """``df`` with ``_no``, a row's place in ``order``, and ``_at``, the sum of ``weight`` (without null) over the rows before it.

    Rows go to ranges of the order and are counted where they are, so they are shuffled
    once.  The driver holds two sums a range.  Rows that ``order`` does not tell apart
    are numbered in some order; the table is stored, so that it stays.  ``ranged`` says that
    partitions are ranges of the order already.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = S.StructType([*df.schema.fields, S.StructField("_part", S.IntegerType()), S.StructField("_no", S.LongType()), S.StructField("_at", S.LongType())])
    dealt = df if ranged else df.repartitionByRange(n, *order)
    local = stored(dealt.sortWithinPartitions(*order).mapInArrow(_running(weight), schema), name)
    sums = local.groupBy("_part").agg(F.count("*").alias("n"), F.sum(F.lit(1) if weight is None else F.col(weight)).alias("w")).orderBy("_part").collect()
    bases, no, at = [], 0, 0
    for r in sums:
        bases.append((r["_part"], no, at))
        no, at = no + r["n"], at + r["w"]
    bases = df.sparkSession.createDataFrame(bases, "_part int, _no0 long, _at0 long")
    placed = local.join(F.broadcast(bases), "_part")
    return placed.select(*df.columns, (F.col("_no") + F.col("_no0")).alias("_no"), (F.col("_at") + F.col("_at0")).alias("_at"))
