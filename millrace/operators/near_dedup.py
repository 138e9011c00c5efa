"""SimHash near-duplicates of paragraphs: four bands of 16 bits, within three bits, keep the first.

Bands are worked one after another, as the order decides who stays: a paragraph that
an earlier band removed is unseen in the next.  All pairs within three bits are found
before, and only they take part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..storage import stored

_WORD = re.compile(r"[a-z0-9]+")


#: Eight bytes for a shingle, by name.
DIGESTS = {"blake2b": lambda raw: hashlib.blake2b(raw, digest_size=8).digest(), "md5": lambda raw: hashlib.md5(raw).digest()[:8]}


def fingerprints(texts: list[str], width: int = 4, digest: str = "blake2b") -> np.ndarray:
    """64 bits over each text's distinct word shingles: a bit is set if more have it set than not; 0 without words."""
    digests, count, hashed = [], [], DIGESTS[digest]
    for text in texts:
        words = _WORD.findall((text or "").lower())
        grams = {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {" ".join(words)} - {""}
        digests += [hashed(g.encode()) for g in grams]
        count.append(len(grams))
    out = np.zeros(len(texts), np.uint64)
    size = np.array(count)
    full = np.flatnonzero(size)
    if len(full):
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        # Eight bits' counts are added in one number, of 255 rows at most, so none of them overflows.
        runs, heads = -(-size[full] // 255), (np.cumsum(size) - size)[full]
        first = np.cumsum(runs) - runs
        starts = np.repeat(heads - 255 * first, runs) + 255 * np.arange(runs.sum())
        votes = np.add.reduceat(np.add.reduceat(bits.view(np.uint64), starts).view(np.uint8), first, dtype=np.int64)
        out[full] = np.packbits(2 * votes > size[full][:, None], axis=1).view(">u8").ravel()
    return out.view(np.int64)


def simhash_of(text: str, width: int = 4) -> int:
    return int(fingerprints([text], width)[0])


def simhash(text: Column, digest: str = "blake2b") -> Column:
    @F.pandas_udf(S.LongType())
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.concatenate([fingerprints(part.iloc[i : i + 500].tolist(), digest=digest) for i in range(0, len(part), 500)] or [np.zeros(0, np.int64)]))

    return made(text)


def _pairs(nodes: DataFrame, scope: list[str], threshold: int) -> DataFrame:
    """(a, b, bands) of fingerprints of a scope within ``threshold`` bits, the earlier first; ``bands`` has a bit for each band they share.

    Of twice ``threshold`` blocks of bits two such fingerprints have half equal, so each goes
    to as many keys as there are halves: 20 of 32 bits for three.  A key's group shares 32
    bits, however large a band is, and a fingerprint has at most some 43,000 neighbours.
    """
    count = 2 * threshold
    edges = [64 * k // count for k in range(count + 1)]
    masks = [sum((1 << hi) - (1 << lo) for lo, hi in some) for some in combinations(list(zip(edges, edges[1:])), threshold)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select(*scope, "_fp", "_o", F.posexplode(F.array(*(F.col("_fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("_half", "_key"))
    one = keyed.select(*scope, "_half", "_key", F.col("_fp").alias("_a"), F.col("_o").alias("_first"))
    other = keyed.select(*scope, "_half", "_key", F.col("_fp").alias("_b"), F.col("_o").alias("_later"))
    apart = F.col("_a").bitwiseXOR(F.col("_b"))
    # Spark takes a table for as large as before it was exploded, so it would send all keys of a million rows through the driver: they are shuffled.
    near = one.join(other.hint("merge"), [*scope, "_half", "_key"]).where((F.col("_first") < F.col("_later")) & (F.bit_count(apart) <= threshold))
    bands = sum(F.when(F.shiftrightunsigned(apart, 16 * k).bitwiseAND(0xFFFF) == 0, 1 << k).otherwise(0) for k in range(4))
    return near.select(F.struct(*scope, "_a").alias("a"), F.struct(*scope, F.col("_b").alias("_a")).alias("b"), bands.alias("bands")).distinct()


def _first_of(bands: Column) -> Column:
    """The lowest band of a set of them; null for none."""
    return F.coalesce(*(F.when(bands.bitwiseAND(1 << k) != 0, k) for k in range(4)))


def _settled(pairs: DataFrame) -> list[DataFrame]:
    """Tables (node) of what goes: in the first band in which an earlier neighbour is there that this band doesn't remove either.

    With R(a) the band that removes a, 4 if none does, R(b) is the least band k that b
    shares with an earlier a of which R(a) > k.  So all bands are settled together, in
    rounds: a node is known once its earlier neighbours are, or once no unknown one
    shares a lower band.  There are as many rounds as pairs in the longest chain in which
    each waits for the one before, at most; each reads the pairs that are left.
    """
    later = pairs.groupBy(F.col("b").alias("a")).agg(F.count("*").alias("waits"))
    left = stored(pairs.join(later, "a", "left").select("a", "b", "bands", F.when(F.col("waits").isNull(), 4).alias("r")), "pairs")
    out = []
    while not left.isEmpty():
        hit = F.when(F.col("r").isNotNull(), _first_of(F.col("bands").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("r")) - 1)))
        found = left.groupBy("b").agg(F.min(hit).alias("hit"), F.min(F.when(F.col("r").isNull(), _first_of(F.col("bands")))).alias("wait"))
        known = stored(found.where("wait is null or hit <= wait").select(F.col("b").alias("node"), F.coalesce("hit", F.lit(4)).alias("own")), "settled")
        out.append(known.where("own < 4").select("node"))
        rest = left.join(known.select(F.col("node").alias("b")), "b", "left_anti").join(known.select(F.col("node").alias("a"), "own"), "a", "left")
        left = stored(rest.select("a", "b", "bands", F.coalesce("r", "own").alias("r")), "pairs")
    return out


def near_dedup(df: DataFrame, scope: list[str], order: list[str] | str = "para_no", threshold: int = 3, column: str = "text", broadcast_rows: int = 1_000_000, digest: str = "blake2b") -> DataFrame:
    """``df`` without paragraphs within ``threshold`` bits of an earlier one that shares a band and stays.

    Texts are read once for their fingerprints; of equal ones the first by ``order``, which
    names a row, is compared.  What is within the bits is found once, by equal halves of
    the fingerprint's blocks, and only such pairs are settled.  What goes is
    broadcast up to so many rows, and joined by a shuffle beyond.
    """
    if not 1 <= threshold <= 3:
        raise ValueError("bands of 16 bits find what is within 1 to 3 bits")
    order = [order] if isinstance(order, str) else order
    names = [*scope, *(c for c in order if c not in scope)]
    prints = stored(df.select(*names, simhash(F.col(column), digest).alias("_fp")), "fingerprints")
    nodes = stored(prints.groupBy(*scope, "_fp").agg(F.min(F.struct(*order)).alias("_o"), F.count("*").alias("_n")), "nodes")
    removed = _settled(stored(_pairs(nodes, scope, threshold), "pairs"))
    # Later rows of a fingerprint go, and all rows of one that goes.
    later = nodes.where("_n > 1").select(*scope, "_fp", "_o")
    for some in removed:
        later = later.union(some.select(*(F.col(f"node.{c}").alias(c) for c in scope), F.col("node._a").alias("_fp"), F.lit(None).cast(nodes.schema["_o"].dataType).alias("_o")))
    same = [prints[c].eqNullSafe(later[c]) for c in scope]
    both = prints.join(later.hint("merge"), [*same, prints["_fp"] == later["_fp"]])
    gone = stored(both.where(F.coalesce(F.struct(*(prints[c] for c in order)) > F.col("_o"), F.lit(True))).select(*(prints[c] for c in names)).distinct(), "near-duplicates")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return df.join(gone, names, "left_anti")
