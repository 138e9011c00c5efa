"""Vectorised text kernels shared by the corpus operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, so a
batch of documents costs a handful of NumPy passes and no Python string is made.

Two kinds of hash stand for strings.

* ``word_hashes`` and ``chained`` pass eight bytes, or one element, after another
  through a bijective mixer.  Words of one length up to eight bytes never collide.
* ``running``, ``hashes`` and ``windows`` are polynomial sums modulo the prime
  ``2**61 - 1``: with ``S`` the running sum of ``value[i] * BASE**i``, the hash of the
  slice ``[s, e)`` is ``(S[e] - S[s]) * BASE**-s``, so any slice costs two look-ups.  Two
  different slices of n elements collide for at most n of the ``2**61`` bases.  (Modulo
  a power of two, sequences after Thue and Morse would collide for every base.)

With a known salt or base, texts that collide can be solved for.  Where a hash stands for
a string between tasks, its key is drawn for each run, so texts chosen before cannot
collide but by chance; where the strings are at hand, they are compared (``same``).
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes handled at once; bounds the temporaries to some tens of MB.
SLICE = 1 << 19
#: The polynomials' modulus and base.
PRIME = (1 << 61) - 1
_P = U64(PRIME)
_BASE = 0x9E3779B97F4A7C15 % PRIME
_powers: dict[int, np.ndarray] = {}


def drawn() -> int:
    """A key for a run's hashes, a salt and a base alike."""
    return (1 << 40) + secrets.randbelow(PRIME - (1 << 41))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


#: A random value per byte.
BYTES = mix(np.arange(256, dtype=U64), 77) % _P
#: Bytes with A-Z folded to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: The characters between words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a * b`` modulo PRIME, of numbers below it."""
    low = U64(0xFFFFFFFF)
    al, ah, bl, bh = a & low, a >> U64(32), b & low, b >> U64(32)
    mid = al * bh + ah * bl  # below 2**62
    low_part = al * bl
    # 2**64 is 8, and 2**61 is 1.
    out = ((ah * bh) << U64(3)) + (mid >> U64(29)) + ((mid & U64((1 << 29) - 1)) << U64(32)) % _P + (low_part >> U64(61)) + (low_part & _P)
    return out % _P


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo PRIME, kept between calls up to a few slices' length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, U64)
        k, step = 1, base
        while k < size:
            have[k : 2 * k] = times(have[:k], np.full(k, step, U64))
            k, step = 2 * k, step * step % PRIME
        if size <= 4 * SLICE:
            if len(_powers) > 8:  # of runs before
                _powers.clear()
            _powers[base] = have
    return have[:n]


def running(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """``S`` for hashes of slices of ``values`` (taken modulo PRIME); one longer than they."""
    terms = times(values % _P, powers(base, len(values)))
    # Halves apart, so that no sum leaves 64 bits: up to 2**31 elements.
    low, high = np.cumsum(terms & U64(0xFFFFFFFF)), np.cumsum(terms >> U64(32)) % _P
    out = np.zeros(len(values) + 1, U64)
    out[1:] = (low % _P + (high >> U64(29)) + ((high & U64((1 << 29) - 1)) << U64(32))) % _P
    return out


def _slice(sums: np.ndarray, low: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return mix(times((sums + _P - low) % _P, scale))


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Mixed hashes of the slices ``[start, end)`` of what ``sums`` runs over."""
    return _slice(sums[end], sums[start], powers(pow(base, -1, PRIME), len(sums))[start])


def windows(sums: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Mixed hashes of all slices of one width, by start."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U64)
    return _slice(sums[width:], sums[:n], powers(pow(base, -1, PRIME), n))


#: Pieces of eight bytes that go through the mixer for all words at once; longer words go one by one.
_PIECES = 16
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of the byte strings ``data[start:end]``."""
    length = end - start
    out = mix(length.astype(U64), 201 + salt)
    if not len(start):
        return out
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    live, at = np.arange(len(start)), 0
    long = np.flatnonzero(length > 8 * _PIECES)
    if len(long):
        live = np.flatnonzero(length <= 8 * _PIECES)
    while len(live):
        left = np.minimum(length[live] - at, 8)
        piece = np.ascontiguousarray(eight[start[live] + at]).view("<u8").ravel() & _MASK[left]
        out[live] = mix(out[live] ^ piece, 202 + salt)
        at += 8
        live = live[length[live] > at]
    for i in long.tolist():
        raw = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=salt.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(raw, "little")
    return out


def chained(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``width`` elements, by start."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = mix(values[:n], 210 + salt)
    for k in range(1, width):
        out = mix(out ^ values[k : k + n], 210 + salt)
    return out


def same(a: np.ndarray, start: np.ndarray, length: np.ndarray, b: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the byte strings ``a[start : start + length]`` and ``b[other : other + size]`` are equal."""
    out = length == size
    some = np.flatnonzero(out & (length > 0))
    if len(some):
        n = length[some]
        equal = a[ragged(start[some], n)] == b[ragged(other[some], n)]
        out[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``size`` bytes; a null is an empty text."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        base = int(offsets[lo]) if len(data) else 0
        yield lo, hi, data[base : base + int(offsets[hi] - offsets[lo])], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each document's first word (one longer than the documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = inside[edge]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def int_column(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A whole-number column as int64; rows where it is null must be dropped before."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.int64()).to_numpy(zero_copy_only=False)
