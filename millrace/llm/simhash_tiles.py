"""Near-duplicates by SimHash, found by exact comparison of tiles of fingerprints.

A document's fingerprint is 64 bits over its 4-word shingles.  Distinct fingerprints
are cut into tiles of at most TILE that agree in the population counts of three parts
of their bits.  Two fingerprints within the radius have counts whose differences sum to
the radius at most, so a tile meets the tiles of such counts alone, and all other pairs
of tiles are skipped.  Tiles that meet are compared in full, by exclusive-or and bit
counts in numpy, and send on a forest of what they link instead of all links.

The work is quadratic in the distinct fingerprints, less what the counts skip: of random
ones about one pair in four is compared, a nanosecond each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .store import cut, discard, only, partitions

#: Shingles' words, hash seed, and the most bits by which fingerprints that link differ.
WIDTH, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile at most: 16 kB with their documents.
TILE = 1024
#: The parts of the 64 bits whose population counts tell tiles apart: first bit and width.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Shingles that are hashed at once.
PIECE = 1 << 17
_LANES = np.uint64(0x0101010101010101)


def _votes(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many hashes of each run of ``size`` (all above 0) have each bit set: bytes add up lane by lane, 255 at once."""
    runs = -(-size // 255)
    starts = K.ragged(np.zeros(len(size), np.int64), runs) * 255 + np.repeat(np.cumsum(size) - size, runs)
    heads, out = np.cumsum(runs) - runs, np.zeros((len(size), 64), np.int64)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, starts)
        out[:, b::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), heads, axis=0, dtype=np.int64)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The fingerprints of texts given by their bytes: a bit is set if over half of the shingles' hashes have it; 0 without words."""
    start, end, first = K.words(data, offsets)
    lens, n = end - start, np.diff(first)
    place = np.cumsum(lens + 1) - (lens + 1)
    joined = np.full(int((lens + 1).sum()), 32, np.uint8)
    joined[K.ragged(place, lens)] = K.FOLD[data[K.ragged(start, lens)]]
    text, stop = joined.tobytes(), place + lens
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), size)
    at = K.ragged(first[:-1], size)
    last = np.minimum(at + width, first[1:][doc]) - 1
    votes, digest = np.zeros((len(n), 64), np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(at), PIECE):
        a, b = place[at[lo : lo + PIECE]], stop[last[lo : lo + PIECE]]
        hashes = np.fromiter((digest(text[i:j], SEED) for i, j in zip(a.tolist(), b.tolist())), np.uint64, len(a))
        docs, counts = np.unique(doc[lo : lo + PIECE], return_counts=True)
        votes[docs] += _votes(hashes, counts)
    return np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in K.slices(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fingerprints(data, offsets).view(np.int64))], ["doc_id", "fp"])


def printed(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of documents."""
    return docs.mapInArrow(_printed, "doc_id long, fp long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, first, fps, ids): rows sorted by cell, packed into tiles of one cell."""
    for batch in batches:
        cell, fp, doc = (K.int_column(batch, c) for c in ("cell", "fp", "doc_id"))
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(cell))
        cuts = [(i, min(i + TILE, e)) for h, e in zip(heads.tolist(), ends.tolist()) for i in range(h, e, TILE)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(cell[i]) for i, _ in cuts], pa.int32()), pa.array([int(fp[i]) for i, _ in cuts], pa.int64()), pa.array([fp[i:j].tobytes() for i, j in cuts], pa.binary()), pa.array([doc[i:j].tobytes() for i, j in cuts], pa.binary())],
            ["cell", "first", "fps", "ids"],
        )


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest over the links between two tiles, or within one if both are the same: pairs of places (in a, in b)."""
    own = a is b
    tree, out = np.arange(len(b)), []
    near = np.zeros(len(b), bool)
    hits = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if own:
        hits = np.triu(hits, 1)
    for i in np.flatnonzero(hits.any(axis=1)).tolist():
        found = np.flatnonzero(hits[i])
        # One place for each tree that this row reaches; the trees become one.
        roots, where = np.unique(tree[found], return_index=True)
        least = min(int(roots[0]), int(tree[i])) if own else int(roots[0])
        for root, j in zip(roots.tolist(), found[where].tolist()):
            if not own or root != tree[i]:
                out.append((i, j))
        if own:
            roots = np.append(roots, tree[i])
        if len(roots) > 1:
            near[:] = np.isin(tree, roots)
            tree[near] = least
    return out


def _compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for fa, ia, fb, ib, own in zip(*(batch.column(k).to_pylist() for k in range(5))):
                a, docs_a = np.frombuffer(fa, np.uint64), np.frombuffer(ia, np.int64)
                b, docs_b = (a, docs_a) if own else (np.frombuffer(fb, np.uint64), np.frombuffer(ib, np.int64))
                edges += [(docs_a[i], docs_b[j]) for i, j in linked(a, b, radius)]
            pairs = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of counts that sum to the radius at most, one of each two that only differ in sign."""
    some = product(range(-radius, radius + 1), repeat=len(PARTS))
    return [s for s in some if sum(map(abs, s)) <= radius and s >= (0,) * len(PARTS)]


def _code(counts) -> int:
    """Counts, 32 at most and 8 below 0 at least, as one number."""
    return sum((c + 8) << (6 * k) for k, c in enumerate(counts))


def tile_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a_fps, a_ids, b_fps, b_ids, own): all pairs of tiles whose counts allow links, of (fp, doc_id) rows with distinct fps.

    Tiles are ranges of (counts, fingerprint), so one crowded cell of counts is many
    tiles, and its pairs are rows of a join that Spark can split.
    """
    if not 0 <= radius <= 8:
        raise ValueError("counts are told apart for a radius of 0 to 8")
    counts = [F.bit_count(F.shiftrightunsigned("fp", at).bitwiseAND((1 << wide) - 1)) for at, wide in PARTS]
    cell = sum((c + 8) * (1 << (6 * k)) for k, c in enumerate(counts))
    celled = prints.select(cell.cast("int").alias("cell"), "fp", "doc_id").repartitionByRange(partitions(prints.sparkSession), "cell", "fp")
    tiles = cut(celled.sortWithinPartitions("cell", "fp").mapInArrow(_packed, "cell int, first long, fps binary, ids binary"), "tiles")
    steps = F.array(*(F.lit(_code(s) - _code((0,) * len(PARTS))) for s in _steps(radius)))
    sent = tiles.select(F.explode(steps).alias("step"), *(F.col(c).alias(f"a_{c}") for c in tiles.columns)).withColumn("cell", F.col("a_cell") + F.col("step"))
    # Within a cell each two tiles meet once, and a tile meets itself without being sent.
    met = sent.join(tiles, "cell").where((F.col("step") != 0) | (F.col("a_first") <= F.col("first")))
    own = (F.col("step") == 0) & (F.col("a_first") == F.col("first"))
    return met.select("a_fps", "a_ids", F.when(~own, F.col("fps")).alias("b_fps"), F.when(~own, F.col("ids")).alias("b_ids"), own.alias("own"))


def simhash_near_dedup(docs: DataFrame, radius: int = RADIUS, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hexadecimal digits, and the least doc_id that links within ``radius`` bits reach.

    Words are runs of other than space and U+0009 to U+000D, with A-Z in lower case.  A
    text of fewer than four words is one shingle; a null or empty one, or one without
    words, has fingerprint 0, which links like any other.  Rows without a doc_id go; rows
    that share one are a row each and reach what any of them reaches.  Equal fingerprints
    are one in all comparisons, so a group of copies, however large, is one entry.
    Components are joined by broadcast up to so many rows and by a shuffle beyond.
    """
    prints = cut(printed(only(docs, "doc_id", "text")), "prints")
    # The least document stands for a fingerprint; rows of one document with two texts tie their fingerprints.
    shown = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "shown")
    edges = tile_pairs(shown.select("fp", "doc_id"), radius).mapInArrow(_compared(radius), "a long, b long")
    shared = prints.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    ties = prints.join(shared, "doc_id").join(shown.select("fp", F.col("doc_id").alias("b")), "fp").select(F.col("doc_id").alias("a"), "b")
    reached = components(edges.union(ties))
    group = shown.join(reached, shown["doc_id"] == reached["id"], "left").where("n > 1 or component is not null").select("fp", F.coalesce("component", "doc_id").alias("component_id"))
    group = cut(group, "groups")
    joined = prints.join(F.broadcast(group) if group.count() <= broadcast_rows else group, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
