"""Suffix-array dedup of bytes.

A byte goes if a string of ``width`` bytes that covers it also starts in a document
with a smaller doc_id.  Not every suffix is needed to find such strings.  The one whose
leading ``gram`` bytes have the least hash in a string is its anchor; equal strings have
equal anchors at equal places, so the suffixes at anchors stand for all, one in about
eighteen bytes.  Neighbouring strings with one anchor go as one *context*.

1. *Splitters.*  Leading tokens of a sample of anchored suffixes are sorted, and their
   quantiles are the borders of ranges.
2. *Buckets.*  Each context goes to the range that its suffix's leading tokens fall in.
   Contexts that are equal byte for byte are collapsed in each task before.  Leading
   tokens of which the sample holds more than a share of a bucket are hot: their strings
   go one by one and are dealt by their whole contents.
3. *Sorting.*  A bucket sorts by leading tokens, drops those of one document, and collapses
   contexts that are equal byte for byte.  All strings of the others it sorts by multikey
   quicksort: a pass sorts what the words of eight bytes before left tied by the next word
   and drops what is single.
4. *Borders.*  What stays tied over the whole width is one string, whose first document
   keeps it.  Suffixes on either side of a border differ within their leading tokens, and
   a string's leading tokens lie inside it, so no string is tied across a border.

Of a run of one byte (blanks, dashes, zeros) all strings are equal: the first alone goes
on, and what is found of it holds for the whole run.

All comparisons are of the bytes themselves; hashes only choose anchors and buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .repeats import COLUMNS, SPREAD, _least, _runs, batch, covered, dealt, documents, home, joined, texts
from .store import cut, partitions, tidy

U64 = np.uint64
WIDTH = 50
#: Documents that are sampled for the splitters, about, and anchors of each, at most.
SAMPLE, ANCHORS = 2000, 256
#: Of a bucket, the share from which leading tokens are hot.
HOT = 0.25
#: Contexts that a scanning task holds before it sends them.
HELD = 1 << 18
#: Bytes of one text that are looked at once.
STRETCH = 1 << 21
#: Strings that are sorted at once, about.
SORTED = 1 << 20


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number that sorts as they do; ``data`` goes on for 8 bytes behind the last place."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    return np.ascontiguousarray(eight[at]).view(">u8").ravel().astype(U64)


def _leading(data: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """The ``gram`` bytes at each place, as strings of 16 bytes."""
    wide = np.lib.stride_tricks.sliding_window_view(data, 16)[at]
    if gram < 16:
        wide = np.where(np.arange(16) < gram, wide, np.uint8(0))
    return np.ascontiguousarray(wide).view("S16").ravel()


def runs_of_one(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one byte, longer than ``width`` and within a document."""
    if len(data) <= width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(data), bool)
    new[1:] = data[1:] != data[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(data))
    long = end - begin > width
    return begin[long], end[long]


def stretches(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets): texts as they are, one above STRETCH in stretches that share a string's bytes, so that each string is in one."""
    if len(data) <= STRETCH or len(offsets) > 2:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - width + 1, STRETCH):
        # With the byte before, as a run of one byte may go on.
        part = data[max(at - 1, 0) : at + STRETCH + width - 1]
        yield max(at - 1, 0), part, np.array([0, len(part)])


def anchored(data: np.ndarray, offsets: np.ndarray, width: int, gram: int, once: bool = False) -> tuple[np.ndarray, ...]:
    """(document, first string, strings, anchor) of all contexts: documents by index, places in ``data``; ``once`` keeps the first string alone of a run of one byte."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    place = np.arange(len(data) - gram + 1)
    one = words_at(padded, place)
    rank = K.mix(one >> U64(8 * (8 - gram)) if gram < 8 else one)
    if gram > 8:
        rank = K.mix(rank ^ (words_at(padded[8:], place) >> U64(8 * (16 - gram))))
    key = (rank & U64(0xFFFFFFFF00000000)) | place.astype(U64)
    at = (_least(key, width - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    first = np.arange(len(at)) + width <= offsets[1:][doc]
    for begin, end in zip(*runs_of_one(data, offsets, width)) if once else ():
        first[begin + 1 : end - width + 1] = False
    inside = np.flatnonzero(first)
    at, doc = at[inside], doc[inside]
    heads = _runs(at, doc, inside - np.arange(len(inside)))
    return doc[heads], inside[heads], np.diff(np.append(heads, len(inside))), at[heads]


def multikey_sort(run: np.ndarray, word: Callable[[int, np.ndarray], np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that equal another row of their run in all words, in order, and where runs of equal rows begin.

    ``word(k, rows)`` gives the rows' k-th words.
    """

    def tied(rows: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = _runs(*keys)
        size = np.diff(np.append(heads, len(rows)))
        some = np.repeat(size > 1, size)
        return rows[some], np.repeat(np.arange(len(size)), size)[some]

    order = np.argsort(run)
    rows, run = tied(order, run[order])
    for k in range(steps):
        if not len(rows):
            break
        own = word(k, rows)
        order = np.lexsort((own, run))
        rows, run = tied(rows[order], run[order], own[order])
    return rows, _runs(run)


def _steps(width: int) -> list[int]:
    """Where words of eight bytes begin that cover ``width`` bytes."""
    return [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])] if width >= 8 else [0]


def _equal(data: np.ndarray, start: np.ndarray, length: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``multikey_sort``, for whole strings of any lengths, which are the same within a run."""

    def word(k: int, rows: np.ndarray) -> np.ndarray:
        left = np.clip(length[rows] - 8 * k, 0, 8).astype(U64)
        own = words_at(data, np.minimum(start[rows] + 8 * k, len(data) - 8))
        return np.where(left > 0, own >> (U64(64) - U64(8) * np.maximum(left, U64(1))), U64(0))

    return multikey_sort(run, word, -(-int(length.max(initial=0)) // 8))


def _sorted(data: np.ndarray, at: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of places by their ``gram`` bytes, and these bytes in that order."""
    one = words_at(data, at)
    if gram <= 8:
        order = np.argsort(one >> U64(8 * (8 - gram)), kind="stable")
    else:
        order = np.lexsort((words_at(data[8:], at) >> U64(8 * (16 - gram)), one))
    return order, _leading(data, at[order], gram)


def _collapsed(data: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that a smaller document has as well, byte for byte, and a mask of the others."""
    rows, heads = _equal(data, start, length, run)
    stays = np.ones(len(doc), bool)
    if not len(rows):
        return rows, stays
    late = rows[doc[rows] > np.repeat(np.minimum.reduceat(doc[rows], heads), np.diff(np.append(heads, len(rows))))]
    stays[late] = False
    return late, stays


def _packed(held: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*held)]


def _told(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, homes: int) -> Iterator[pa.RecordBatch]:
    yield from dealt("f", home(doc, homes), homes, doc, lo.astype(np.uint32), hi.astype(np.uint32))


def _unpacked(r: dict) -> tuple[np.ndarray, ...]:
    """(document, first string, strings, anchor's place, bytes) of a blob of contexts."""
    docs, n = np.frombuffer(r["a"], np.int64).tolist()
    raw, at, out = np.frombuffer(zstandard.decompress(r["b"]), np.uint8), 0, []
    for kind, size in ((np.int64, docs), (np.uint32, n), (np.uint32, n), (np.uint8, n), (np.uint8, n)):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size * wide].reshape(wide, size).T).view(kind).ravel().astype(np.int64))
        at += size * wide
    return np.cumsum(out[0])[out[1]], *out[2:], np.frombuffer(zstandard.decompress(r["c"]), np.uint8)


def _scan(width: int, gram: int, buckets: int, splitters: np.ndarray, hot: np.ndarray):
    """Kind ``c``: contexts by leading tokens.  Kind ``f``: strings that repeat as seen within the task, by document."""

    def send(doc, lo, count, off, data) -> Iterator[pa.RecordBatch]:
        length = count + width - 1
        start = np.cumsum(length) - length
        data = np.concatenate([data, np.zeros(16, np.uint8)])
        if len(hot):
            many = np.isin(_leading(data, start + off, gram), hot)
            w, keep = np.flatnonzero(many), np.flatnonzero(~many)
            own, step = np.repeat(w, count[w]), K.ragged(np.zeros(len(w), np.int64), count[w])
            doc, lo, off, start = (np.concatenate([x[keep], x[own] + k * step]) for x, k in ((doc, 0), (lo, 1), (off, -1), (start, 1)))
            count = np.concatenate([count[keep], np.ones(len(own), np.int64)])
            length = count + width - 1
        else:
            keep = np.arange(len(doc))
        # By leading tokens, in whose order borders are looked up.
        order, lead = _sorted(data, start + off, gram)
        bucket = np.empty(len(doc), np.int64)
        edge = np.concatenate([[0], np.searchsorted(lead, splitters, "left"), [len(lead)]])
        bucket[order] = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        alone = np.arange(len(doc)) >= len(keep)
        if alone.any():
            whole = K.word_hashes(data, start[alone], start[alone] + width)
            bucket[alone] = ((whole >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        rank = np.zeros(len(doc), np.int64)
        rank[_runs(lead)] = 1
        rank[order] = np.cumsum(rank) - 1
        # Of equal contexts the least document's go on; all others repeat whole.
        late, stays = _collapsed(data, start, length, doc, (rank * 256 + off) * 256 + count)
        if len(late):
            yield from _told(doc[late], lo[late], lo[late] + count[late] - 1, buckets)
        order = order[stays[order]]
        order = order[np.argsort(bucket[order], kind="stable")]
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(edge)).tolist():
            pick = order[edge[b] : edge[b + 1]]
            own, at = np.unique(doc[pick], return_inverse=True)
            # Columns apart, and byte by byte, as they pack best so.
            numbers = (np.diff(own, prepend=0), at.astype(np.uint32), lo[pick].astype(np.uint32), count[pick].astype(np.uint8), off[pick].astype(np.uint8))
            packed = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in numbers]
            raw = zstandard.compress(data[K.ragged(start[pick], length[pick])].tobytes(), 3)
            out.append(("c", b, np.array([len(own), len(pick)]).tobytes(), zstandard.compress(b"".join(packed), 3), raw))
            if len(out) == 64:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for rows in batches:
            ids = K.int_column(rows, "doc_id")
            for a, z, data, offsets in K.slices(rows):
                for base, part, edges in stretches(data, offsets, width):
                    doc, at, count, anchor = anchored(part, edges, width, gram, once=True)
                    for k in range(0, len(doc), HELD):  # one text may have very many
                        d, p, n, where = (x[k : k + HELD] for x in (doc, at, count, anchor))
                        held.append((ids[a:z][d], base + p - edges[d], n, where - p, part[K.ragged(p, n + width - 1)]))
                        size += len(d)
                        if size >= HELD:
                            yield from send(*_packed(held))
                            held, size = [], 0
        if size:
            yield from send(*_packed(held))

    return run


def _sort(width: int, gram: int, homes: int, strings: int):
    """Sorts the strings of a bucket; kind ``f``: those that a smaller document has too, by document."""

    def later(data, start, count, off, doc, group, least, most) -> Iterator[pa.RecordBatch]:
        """Of these contexts' strings those whose anchor's place is from ``least`` to ``most``."""
        first = np.maximum(0, off - most)
        some = np.maximum(0, np.minimum(count, off - least + 1) - first)
        which = np.repeat(np.arange(len(count)), some)
        step = K.ragged(first, some)
        begin = start[which] + step
        steps = _steps(width)
        short = U64(8 * max(0, 8 - width))
        rows, heads = multikey_sort(group[which] * (width + 1) + off[which] - step, lambda k, r: words_at(data, begin[r] + steps[k]) >> short, len(steps))
        if not len(rows):
            return
        own = doc[which[rows]]
        late = rows[own > np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(rows))))]
        # Neighbouring strings of a context as one.
        late = np.sort(late)
        if not len(late):
            return
        heads = np.flatnonzero(np.append(True, (np.diff(which[late]) != 0) | (np.diff(step[late]) != 1)))
        tails = np.append(heads[1:], len(late)) - 1
        yield which[late[heads]], step[late[heads]], step[late[tails]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for rows in batches:
            for r in rows.to_pylist():
                if r["kind"] == "f":
                    yield batch([tuple(r.values())])
                else:
                    held.append(_unpacked(r))
        if not held:
            return
        doc, lo, count, off, data = _packed(held)
        held.clear()
        data = np.concatenate([data, np.zeros(16, np.uint8)])
        length = count + width - 1
        start = np.cumsum(length) - length
        order, lead = _sorted(data, start + off, gram)
        group = np.zeros(len(order), np.int64)
        group[_runs(lead)] = 1
        group = np.cumsum(group) - 1
        del lead

        def shared() -> np.ndarray:
            """Whether the leading tokens are of more than one document: others repeat nowhere else."""
            heads = _runs(group)
            if not len(heads):
                return np.zeros(0, bool)
            size = np.diff(np.append(heads, len(order)))
            return np.repeat(np.maximum.reduceat(doc[order], heads) > np.minimum.reduceat(doc[order], heads), size)

        some = shared()
        order, group = order[some], group[some]
        late, stays = _collapsed(data, start[order], length[order], doc[order], (group * 256 + off[order]) * 256 + count[order])
        if len(late):
            own = order[late]
            yield from _told(doc[own], lo[own], lo[own] + count[own] - 1, homes)
        order, group = order[stays], group[stays]
        some = shared()
        order, group = order[some], group[some]
        upto = np.cumsum(count[order])
        edges = np.append(_runs(group), len(order))
        at, found = 0, []
        while at < len(order):
            goal = (upto[at - 1] if at else 0) + strings
            stop = int(edges[max(np.searchsorted(edges, at, "right"), np.searchsorted(edges, np.searchsorted(upto, goal), "right") - 1)])
            pick = order[at:stop]
            wide = width - gram + 1
            # Leading tokens with very many strings go by the anchor's place: strings with other places differ from these.
            parts = min(wide, -(-int(upto[stop - 1] - (upto[at - 1] if at else 0)) // (4 * strings)))
            for k in range(parts):
                for which, one, two in later(data, start[pick], count[pick], off[pick], doc[pick], group[at:stop], wide * k // parts, wide * (k + 1) // parts - 1):
                    found.append((doc[pick[which]], lo[pick[which]] + one, lo[pick[which]] + two))
            at = stop
            if sum(len(f[0]) for f in found) >= HELD:
                yield from _told(*_packed(found), homes)
                found = []
        if found:
            yield from _told(*_packed(found), homes)

    return run


def splitters_of(docs: DataFrame, width: int, gram: int, buckets: int, hot: float = HOT, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(borders, hot leading tokens) from about ``sample`` documents whose ids hash lowest, ANCHORS of each, or of each of its stretches, at most.

    The driver gets 16 bytes an anchor, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for _, data, offsets in (s for _, _, *whole in K.slices(rows) for s in stretches(*whole, width)):
                doc, _, _, anchor = anchored(data, offsets, width, gram, once=True)
                size = np.bincount(doc, minlength=len(offsets) - 1)
                took = np.minimum(size, ANCHORS)
                pick = np.repeat(np.cumsum(size) - size, took) + K.ragged(np.zeros(len(size), np.int64), took) * np.repeat(size, took) // np.maximum(np.repeat(took, took), 1)
                lead = _leading(np.concatenate([data, np.zeros(16, np.uint8)]), anchor[pick], gram)
                yield pa.RecordBatch.from_arrays([pa.array([lead.tobytes()], pa.binary())], ["lead"])

    count = docs.count()
    share = 1 << 30 if count <= sample else int((1 << 30) * sample / count)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    lead = np.sort(np.frombuffer(b"".join(bytes(r["lead"]) for r in some.mapInArrow(run, "lead binary").collect()), "S16"))
    if not len(lead):
        return lead, lead
    borders = np.unique(lead[[len(lead) * k // buckets for k in range(1, buckets)]])
    heads = _runs(lead)
    size = np.diff(np.append(heads, len(lead)))
    return borders, lead[heads][(size > 1) & (size * buckets >= hot * len(lead))]


def suffix_dedup(docs: DataFrame, width: int = WIDTH, hot: float = HOT, sample: int = SAMPLE, strings: int = SORTED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    ``docs`` has doc_id and text; further columns are ignored, rows without a doc_id
    dropped; a null text is empty, and of rows that share a doc_id the one with the
    largest text counts.  Texts shorter than ``width`` (up to 255) stay whole; a very long
    text is as many contexts.  Strings are judged on the input, within documents.  An
    empty table gives an empty result.
    """

    def finish(ids, data, offsets, found) -> Iterator[pa.RecordBatch]:
        gone = covered(ids, offsets, found, width)
        begin, end = runs_of_one(data, offsets, width)
        if len(begin):
            repeats = covered(ids, offsets, found, 1)  # strings by their first byte
            for a, b in zip(begin[repeats[begin]], end[repeats[begin]]):
                gone[a:b] = True
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(gone)]
        begins[inner] = gone[inner]
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins)]
        removed, spans = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
        kept = data[~gone].tobytes()
        upto = offsets - sums[0][offsets]
        digest = [hashlib.sha256(kept[upto[i] : upto[i + 1]]).hexdigest() for i in range(len(ids))]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = documents(docs)
    gram = min(16, max(1, width // 2))
    n = SPREAD * partitions(docs.sparkSession)
    borders, many = splitters_of(docs, width, gram, n, hot, sample)
    # The contexts have no name, so that their shuffle's files can go once the strings are written.
    found = cut(docs.mapInArrow(_scan(width, gram, n, borders, many), COLUMNS).repartitionById(n, F.col("bucket")).mapInArrow(_sort(width, gram, n, strings), COLUMNS), "strings")
    tidy(docs.sparkSession)
    whole = texts(docs, n).union(found).repartitionById(n, F.col("bucket"))
    return whole.mapInArrow(joined(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
