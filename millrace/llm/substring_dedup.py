"""Substring dedup of words by compressed FM-indexes.

Each shard holds the contexts of its anchors (see ``repeats``) as one text of words,
indexed by its Burrows-Wheeler transform in a wavelet matrix of packed bits.  The
documents' contexts are streamed against their shard: backward search extends a
match to the left while some smaller document has it.  Where the search breaks off
at a word, no window that covers the word and the end is matched, and it goes on
with the first one behind; where it covers a window, the match is followed to the
right in the document it was found in.  Intervals of at least ``width`` words come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .repeats import HOT, Windows, covered, documents, repeated

WIDTH = 50


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least, by prefix doubling."""
    n, rank, span = len(text), text.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1 if span < n else 0
        key = rank * (n + int(text.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        span *= 2
        if span >= depth or rank[order[-1]] == n - 1:
            return order


class Index:
    """An FM-index: counts of symbols, and the transform in a wavelet matrix of 64-bit words with ranks."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, n = text, len(text)
        self.suffixes = suffix_array(text, depth)
        last = text[self.suffixes - 1]
        symbols = int(text.max()) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels = []
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            ones = (last >> bit & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 64, bool)
            packed[:n] = ones
            words = np.packbits(packed, bitorder="little").view(np.uint64)
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.int32)
            self.levels.append((bit, words, ranks, n - int(ones.sum())))
            last = np.concatenate([last[~ones], last[ones]])
        self.begin = np.zeros(symbols, np.int64)
        heads = np.flatnonzero(np.append(True, last[1:] != last[:-1])) if n else np.zeros(0, np.int64)
        self.begin[last[heads]] = heads

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One step of backward search for interval ends: symbols before them, plus what sorts below."""
        for bit, words, ranks, zeros in self.levels:
            word = at >> 6
            ones = ranks[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return self.less[symbol] + at - self.begin[symbol]


class Least:
    """The place of the least value of any interval, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.table = [np.arange(len(values), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= len(values):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            a, b = last[:-half], last[half:]
            self.table.append(np.where(values[b] < values[a], b, a))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            some = np.flatnonzero(level == k)
            a, b = self.table[k][lo[some]], self.table[k][hi[some] - (1 << int(k))]
            out[some] = np.where(self.values[b] < self.values[a], b, a)
        return out


def matches(text: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of all windows that a smaller document's context has too.

    ``text`` has the contexts' symbols, each context followed by a 0; ``doc`` ranks
    the contexts' documents.
    """
    index = Index(text, width)
    owner = np.repeat(np.arange(len(start)), length + 1)
    least = Least(doc[owner][index.suffixes].astype(np.int32))
    lane = np.arange(len(start))
    window = np.zeros(len(lane), np.int64)
    at = window + width - 1
    lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), len(text))
    other = np.full(len(lane), -1)  # where a match is followed to the right
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(lane):
        begin, last = start[lane], length[lane] - width
        # Following: the window's last word against that after the match.
        follow = other >= 0
        if follow.any():
            some = np.flatnonzero(follow)
            same = text[begin[some] + window[some] + width - 1] == text[other[some]]
            hit, miss = some[same], some[~same]
            found.append((lane[hit], window[hit]))
            window[hit] += 1
            other[hit] += 1
            other[miss] = -1
            at[miss] = window[miss] + width - 1
            lo[miss], hi[miss] = 0, len(text)
        some = np.flatnonzero(~follow)
        if len(some):
            symbol = text[begin[some] + at[some]]
            a, b = index.step(symbol, lo[some]), index.step(symbol, hi[some])
            best = least(a, np.maximum(b, a + 1))
            ok = (b > a) & (least.values[best] < doc[lane[some]])
            lo[some], hi[some] = a, b
            broken, going = some[~ok], some[ok]
            window[broken] = at[broken] + 1
            at[broken] = window[broken] + width - 1
            lo[broken], hi[broken] = 0, len(text)
            whole = at[going] == window[going]
            full = going[whole]
            found.append((lane[full], window[full]))
            other[full] = index.suffixes[best[ok][whole]] + width
            window[full] += 1
            at[going[~whole]] -= 1
        keep = window <= last
        lane, window, at, lo, hi, other = (x[keep] for x in (lane, window, at, lo, hi, other))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def compare(width: int):
    def run(data: np.ndarray, ends: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end, first = K.words(data, ends)
        symbols = np.unique(K.word_hashes(data, begin, end, K.drawn()), return_inverse=True)[1] + 1
        length = np.diff(first)
        text = np.insert(symbols, first[1:], 0)
        start = first[:-1] + np.arange(len(length))
        return matches(text, start, length, np.unique(doc, return_inverse=True)[1], width)

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document.

    A word goes if a window of ``width`` words that covers it also starts, word for
    word, in a document with a smaller doc_id.  Words are runs of characters other than
    space and U+0009 to U+000D.  ``docs`` has doc_id and text; further columns are
    ignored, rows without a doc_id dropped; a null text has no words, and of rows that
    share a doc_id the one with the largest text counts.  A very long text is as many
    contexts; an empty table gives an empty result.
    """
    of = Windows(width, min(8, max(1, width // 2)), K.drawn())

    def finish(ids, data, offsets, found) -> Iterator[pa.RecordBatch]:
        begin, end, first = K.words(data, offsets)
        gone = covered(ids, first, found, width)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[first[1:]] - total[first[:-1]]
        # Kept words with one space after each; a document's last space is cut off.
        kept = np.flatnonzero(~gone)
        size = end[kept] - begin[kept]
        spaced = np.where(np.repeat(True, len(kept)), size + 1, 0)
        joined = np.full(int(spaced.sum()), 32, np.uint8)
        place = np.cumsum(spaced) - spaced
        joined[K.ragged(place, size)] = data[K.ragged(begin[kept], size)]
        upto = np.concatenate([place, [len(joined)]])[np.searchsorted(kept, first)]
        raw = joined.tobytes()
        digest = [hashlib.sha256(raw[upto[i] : max(upto[i], upto[i + 1] - 1)]).hexdigest() for i in range(len(ids))]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(first)), pa.array(removed), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated(documents(docs), of, compare(width), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", hot)
