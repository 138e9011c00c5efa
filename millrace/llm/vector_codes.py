"""Product codes of vectors: four codebooks fitted by whole-number rounds, nearest entries found by segment means.

A part's nearest entry is searched coarse to fine.  For a block of L components with
sums s and t, and residual norms p and q about their means, the squared distance is
(s - t)^2 / L + (p - q)^2 at least, the distance of two points, so a matrix product bounds
all entries.  The bound over one block of the whole part keeps the entries that may be as
near as the best found so far, those over four and eight blocks keep fewer, and what is left gets
its exact distance in whole numbers, so no rounding decides.

Each round reads the vectors once and shuffles sums: one row a task for each entry that
it uses, at most 4 x ENTRIES.  The codebooks alone come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, only

#: Parts of a vector, entries of a codebook, rounds, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Blocks of a part, coarse to fine, whose bounds filter entries.
BLOCKS = (1, 4, 8)
#: Vectors that are searched at once.
ROWS = 1024


def largest(width: int) -> int:
    """The magnitude at which whole components saturate, so that a vector's squared distances stay below 2^62."""
    return int((2**60 / max(width, 1)) ** 0.5) - 1


def _whole(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their whole components): vectors of ``width`` finite components."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    fit = np.flatnonzero(lengths == width)
    if not len(fit) or not width:
        return np.zeros(0, np.int64), np.zeros((0, width), np.int64)
    flat = vectors.take(pa.array(fit)).flatten().cast(pa.float64())
    x = np.floor(flat.to_numpy(zero_copy_only=False).reshape(-1, width) * float(SCALE))  # a null is NaN
    good = np.isfinite(x).all(axis=1)
    top = largest(width)
    return fit[good], np.clip(x[good], -top, top).astype(np.int64)


def _points(x: np.ndarray, blocks: int) -> np.ndarray:
    """Each row's block sums over the root of the block's length, then its residual norms: their distances bound the rows' from below."""
    b = np.array_split(x.astype(np.float64), min(blocks, x.shape[1]), axis=1)
    mean = [p.mean(axis=1, keepdims=True) for p in b]
    return np.concatenate([m * p.shape[1] ** 0.5 for p, m in zip(b, mean)] + [np.sqrt(((p - m) ** 2).sum(axis=1, keepdims=True)) for p, m in zip(b, mean)], axis=1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry; of equal ones the lower index."""
    index, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    levels = [(n, p := _points(book, n), (p * p).sum(axis=1)) for n in BLOCKS]
    # Bounds are rounded sums of squares of numbers up to this size.
    slack = 1e-12 * book.shape[1] * (float(np.abs(book).max(initial=0)) + float(np.abs(x).max(initial=0)) + 1) ** 2
    for lo in range(0, len(x), ROWS):
        some = x[lo : lo + ROWS]
        top, left = np.full(len(some), np.iinfo(np.int64).max), np.ones((len(some), len(book)), bool)
        for n, points, squares in levels:
            own = _points(some, n)
            low = (own * own).sum(axis=1)[:, None] + squares - 2 * (own @ points.T)
            guess = np.where(left, low, np.inf).argmin(axis=1)
            top = np.minimum(top, ((some - book[guess]) ** 2).sum(axis=1))
            left &= low <= (top + slack)[:, None]
        row, entry = np.nonzero(left)
        exact = np.full((len(some), len(book)), np.iinfo(np.int64).max)
        exact[row, entry] = ((some[row] - book[entry]) ** 2).sum(axis=1)
        index[lo : lo + ROWS] = best = exact.argmin(axis=1)
        least[lo : lo + ROWS] = exact[np.arange(len(some)), best]
    return index, least


def _summed(books: np.ndarray, width: int):
    """(part, entry, n, sums) of each task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, wide = books.shape
        sums, n = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, x = _whole(batch.column(1), width)
            for p in range(parts):
                own = x[:, p * wide : (p + 1) * wide]
                index, _ = nearest(own, books[p])
                # Whole numbers in doubles: a batch's sums stay far below 2^53.
                sums[p] += np.stack([np.bincount(index, c, entries) for c in own.T], 1).astype(np.int64)
                n[p] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(n)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, wide = books.shape
        for batch in batches:
            rows, x = _whole(batch.column(1), width)
            found = [nearest(x[:, p * wide : (p + 1) * wide], books[p]) for p in range(parts)]
            codes = np.stack([i for i, _ in found], 1).astype(np.uint8)
            error = sum(d for _, d in found)
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64()), batch.column(2).take(rows)], ["vec_id", "code", "error", "label"])

    return run


def _first(vectors: DataFrame, width: int | None) -> list:
    """The ENTRIES first usable vectors by id (ties: by their components), of ``width`` or of any multiple of PARTS."""
    x = F.col("embedding")
    fit = (F.size(x) == width) if width else (F.size(x) > 0) & (F.size(x) % PARTS == 0)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(x.isNotNull() & fit & finite).orderBy("vec_id", "embedding").limit(ENTRIES if width else 1).collect()


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component), of (vec_id, embedding) rows; without usable vectors they have no entries."""
    one = _first(vectors, None)
    if not one:
        return np.zeros((PARTS, 0, 0), np.int64)
    width = len(one[0]["embedding"])
    first = pa.array([r["embedding"] for r in _first(vectors, width)], pa.list_(pa.float64()))
    books = _whole(first, width)[1].reshape(-1, PARTS, width // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = vectors.select("vec_id", "embedding").mapInArrow(_summed(books, width), "part int, entry int, n long, sums array<long>")
        whole = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(books.shape[2])))
        for part, entry, n, *total in whole.collect():  # the entries of four codebooks
            books[part, entry] = [s // n for s in total]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of (vec_id, embedding, label).

    Vectors that are null or hold a null or a component that isn't finite go, and so do
    those without a vec_id or of another width than the kept vector of the least vec_id;
    widths are multiples of four.  Where vec_ids repeat each row counts, ordered by its
    components.  With fewer than 256 vectors the codebooks are as short.  Components
    beyond ``largest`` saturate.  Null labels are one label.  A label's sum beyond a long
    is null.  Labels' errors are broadcast up to so many rows, joined by a shuffle beyond.
    """
    vectors = only(vectors, "vec_id", "embedding", "label")
    books = fit(vectors, rounds)
    if not books.size:
        return vectors.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    coded = cut(vectors.mapInArrow(_coded(books, PARTS * books.shape[2]), f"vec_id {kinds['vec_id']}, code string, error long, label {kinds['label']}"), "codes")
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    errors = cut(errors, "errors")
    joined = coded.join(F.broadcast(errors) if errors.count() <= broadcast_rows else errors, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
