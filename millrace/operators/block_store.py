"""A store of one token stream from which blocks are read by their place, instead of writing each token of each block.

The stream is cut into segments of SEGMENT tokens, a row each, sorted by number, so that a
block is found in the few row groups whose numbers its segments fall in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 4096


def write_tokens(stream: DataFrame, path: str, segment: int = SEGMENT) -> str:
    """Writes (segment, size, ids) of a stream's (start, ids) pieces; pieces of any length, in any order."""
    at = F.sequence(F.floor(F.col("start") / segment), F.floor((F.col("start") + F.size("ids") - 1) / segment))
    cut = stream.where(F.size("ids") > 0).select("start", "ids", F.explode(at).alias("segment"))
    first = F.greatest(F.col("segment") * segment - F.col("start"), F.lit(0)).cast("int")
    last = F.least((F.col("segment") + 1) * segment - F.col("start"), F.size("ids").cast("long")).cast("int")
    parts = cut.select("segment", F.struct((F.col("start") + first).alias("at"), F.slice("ids", first + 1, last - first).alias("ids")).alias("part"))
    whole = parts.groupBy("segment").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))
    whole = whole.select("segment", F.size("ids").alias("size"), F.lit(segment).alias("wide"), "ids")
    whole.repartitionByRange("segment").sortWithinPartitions("segment").write.mode("overwrite").parquet(path)
    return path


def token_total(spark: SparkSession, path: str) -> int:
    """The tokens of a store."""
    return spark.read.parquet(path).agg(F.coalesce(F.max(F.col("segment") * F.col("wide") + F.col("size")), F.lit(0)).alias("n")).first()["n"]


def read_blocks(places: DataFrame, path: str, block: int) -> DataFrame:
    """(pos, x, y) for each ``pos`` of ``places``: the block that begins there, and the same shifted by one.

    Places that no whole block begins at give no row.  Only the segments that blocks lie
    in are joined, and a bounded few of them per block.
    """
    if block <= 0:
        raise ValueError("a block must hold at least one token")
    spark = places.sparkSession
    store = spark.read.parquet(path)
    one = store.select("wide").first()
    if one is None:
        return places.limit(0).select(F.col("pos").cast("long").alias("pos"), F.array().cast("array<int>").alias("x"), F.array().cast("array<int>").alias("y"))
    wide = one["wide"]
    asked = places.where("pos >= 0").select(F.col("pos").cast("long").alias("pos")).distinct()
    needed = asked.select("pos", F.explode(F.sequence(F.floor(F.col("pos") / wide), F.floor((F.col("pos") + block) / wide))).alias("segment"))
    first = F.greatest(F.col("pos") - F.col("segment") * wide, F.lit(0)).cast("int")
    last = F.least(F.col("pos") + block + 1 - F.col("segment") * wide, F.lit(wide)).cast("int")
    parts = needed.join(store.select("segment", "ids"), "segment").select("pos", F.struct("segment", F.slice("ids", first + 1, last - first).alias("ids")).alias("part"))
    whole = parts.groupBy("pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("t")).where(F.size("t") == block + 1)
    return whole.select("pos", F.slice("t", 1, block).alias("x"), F.slice("t", 2, block).alias("y"))
