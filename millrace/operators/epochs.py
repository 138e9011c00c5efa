"""Epochs without a sort: a keyed permutation of row numbers says which row stands where.

The permutation is a Feistel network over pairs (l, r) of numbers below two sides whose
product is the least above n: rounds add a keyed function of one half to the other, modulo
its side.  Numbers that come out above n are sent through again (cycle walking), so the
network is a permutation of [0, n) for every key.  A batch of any epoch is found from its
number alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .ranks import ranked

ROUNDS = 6
PRIME, FACTOR, WIDE = 2147483647, 48271, 65521


def sides(n: int) -> tuple[int, int]:
    """Two numbers, nearly alike, whose product is n at least and below n and the first."""
    a = max(1, int(np.ceil(np.sqrt(n))))
    return a, max(1, -(-n // a))


def keys(seed: int, epoch: int) -> list[int]:
    return [(seed * 1000003 + epoch * 7919 + k * 104729 + 1) % PRIME for k in range(ROUNDS)]


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    y = (x % PRIME * FACTOR + key) % PRIME
    return y * (y % WIDE + 1) % PRIME


def permuted(places: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The numbers that stand at these places of [0, n)."""
    a, b = sides(n)
    out = np.asarray(places, np.int64).copy()
    left = np.arange(len(out))
    while len(left):
        low, high = out[left] // b, out[left] % b
        for k, key in enumerate(keys(seed, epoch)):
            if k % 2:
                high = (high + _mixed(low, key)) % b
            else:
                low = (low + _mixed(high, key)) % a
        out[left] = low * b + high
        left = left[out[left] >= n]
    return out


def permutation(place: Column, n: int, seed: int, epoch: int) -> Column:
    """``permuted`` as a column."""

    @F.pandas_udf(LongType())
    def moved(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(permuted(part.to_numpy(), n, seed, epoch))

    return moved(place)


def batch_rows(spark: SparkSession, n: int, size: int, seed: int = 0, epoch: int = 0, batches: tuple[int, int] | None = None) -> DataFrame:
    """(batch_no, slot, row): which of n rows stand in an epoch's batches of ``size``, or in those from one number to below another.

    The last batch, if it isn't full, is left out.
    """
    if size <= 0 or n < 0:
        raise ValueError("batches need a size, and rows")
    full = n // size
    first, last = batches or (0, full)
    place = spark.range(max(0, first) * size, max(0, min(last, full)) * size)
    return place.select(F.floor(F.col("id") / size).alias("batch_no"), (F.col("id") % size).alias("slot"), permutation(F.col("id"), n, seed, epoch).alias("row"))


def epoch_batches(df: DataFrame, order: list[str], size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``df`` with batch_no and slot in an epoch; rows are numbered by ``order``, which tells them apart."""
    numbered = ranked(df, order, name="numbered")
    n = numbered.count()
    where = batch_rows(df.sparkSession, n, size, seed, epoch)
    return numbered.join(where, numbered["_no"] == where["row"]).select(*df.columns, "batch_no", "slot")
