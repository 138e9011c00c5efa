"""What substring dedup is built on: finding where windows of words can repeat.

A window is ``width`` consecutive words of one document.  The least hash among a
window's ``gram``-word grams is its anchor; equal windows have equal anchors at equal
places, so only anchors need to meet, one in about twenty words.  Consecutive windows
with one anchor form a segment.

* Segments that are equal as wholes are collapsed, in each task and then by bucket
  of the anchor: all windows of those in later documents repeat.
* Segments that share an anchor but differ, as at the ends of a repeated passage,
  are the *open* ones; their windows must be compared themselves.  The operator does
  that by its index, for one context (a segment's words) a segment.
* An anchor with more than HOT open segments, as at the end of a passage that very
  many documents share, is spread: each window becomes a context of its own, dealt
  by its content, and equal ones are collapsed in each task.

Blobs of packed numbers go through the shuffles instead of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import cut, only, partitions

U64 = np.uint64
#: Anchors that a scanning task holds before it sends them.
HELD = 1 << 18
#: Open segments of an anchor that stay together.
HOT = 20_000
#: Buckets for each of the session's shuffle partitions: a bucket is sorted in a worker's memory.
SPREAD = 2
#: Bytes of texts that a task packs at once, and bytes of contexts.
PACKED = 1 << 23
COLUMNS = "kind string, bucket int, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), *((k, pa.binary()) for k in "abcd")])


@dataclass(frozen=True)
class Windows:
    """The windows that count: how many words, and how many the grams have that anchor them."""

    width: int
    gram: int
    #: What hashes are keyed by, drawn for each run.
    key: int

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Running sums over the words, each document's first word, and the words' starts and ends in bytes."""
        start, end, first = K.words(data, offsets)
        return K.running(K.word_hashes(data, start, end, self.key), self.key), first, start, end


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    span = 1
    while span * 2 <= width:
        key, span = np.minimum(key[:-span], key[span:]), span * 2
    rest = width - span
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def segments(sums: np.ndarray, first: np.ndarray, of: Windows) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, content) of all segments; documents by index."""
    grams = K.windows(sums, of.gram, of.key)
    span = of.width - of.gram + 1
    none = np.zeros(0, np.int64)
    if len(grams) < span:
        return none, none, none, none.view(U64), none.view(U64)
    key = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    at = (_least(key, span) & U64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(at)]
    window = np.flatnonzero(np.arange(len(at)) + of.width <= first[1:][doc])
    if not len(window):
        return none, none, none, none.view(U64), none.view(U64)
    at, doc = at[window], doc[window]
    heads = _runs(at, doc)
    lo, hi = window[heads], window[np.append(heads[1:], len(window)) - 1]
    return doc[heads], lo, hi, grams[at[heads]], K.hashes(sums, lo, hi + of.width, of.key)


def _runs(*keys: np.ndarray) -> np.ndarray:
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def home(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    return ((K.mix(doc.astype(np.int64).view(U64), 21) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, [*r, *[None] * (6 - len(r))])) for r in rows], _SCHEMA)


def dealt(kind: str, bucket: np.ndarray, buckets: int, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One blob for each bucket that has rows, in which the rows keep their order."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    arrays = tuple(a[order] for a in arrays)
    for lo in range(0, buckets, 64):
        rows = [(kind, b, *(a[edge[b] : edge[b + 1]].tobytes() for a in arrays)) for b in range(lo, min(lo + 64, buckets)) if edge[b] < edge[b + 1]]
        if rows:
            yield batch(rows)


def _collapse(doc: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (anchor, content, document); there, whether a segment is in the least document of its content; and runs of equal segments."""
    order = np.lexsort((doc, content, anchor))
    doc, anchor, content = doc[order], anchor[order], content[order]
    heads = _runs(anchor, content)
    size = np.diff(np.append(heads, len(doc)))
    return order, doc == np.repeat(doc[heads], size), heads


def _scan(of: Windows, buckets: int, homes: int):
    """Kind ``s``: segments by anchor.  Kind ``f``: windows that repeat as seen within the task, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, lo, hi, anchor, content = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order, least, _ = _collapse(doc, anchor, content)
            later = order[~least]
            if len(later):
                yield from dealt("f", home(doc[later], homes), homes, doc[later], lo[later].astype(np.uint32), hi[later].astype(np.uint32))
            keep = np.sort(order[least])  # by document again: neighbouring numbers pack well
            anchor = anchor[keep]
            bucket = ((anchor >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
            place = (lo[keep].astype(U64) << U64(16)) | (hi[keep] - lo[keep]).astype(U64)
            # What follows of the anchor is enough beside the bucket; contents are compared under equal anchors alone.
            yield from dealt("s", bucket, buckets, doc[keep], place, (anchor & U64(0xFFFFFFFF)).astype(np.uint32), content[keep])

        for rows in batches:
            ids = K.int_column(rows, "doc_id")
            for lo, hi, data, offsets in K.slices(rows):
                sums, first, _, _ = of.tokens(data, offsets)
                doc, one, two, anchor, content = segments(sums, first, of)
                held.append((ids[lo:hi][doc], one - first[doc], two - first[doc], anchor, content))
                count += len(doc)
                if count >= HELD:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    return run


def _meet(homes: int, hot: int):
    """Kind ``f`` as before; kind ``o``: open segments, kind ``h``: those of hot anchors, all by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for rows in batches:
            for r in rows.to_pylist():
                if r["kind"] == "f":
                    yield batch([tuple(r.values())])
                else:
                    anchor = np.frombuffer(r["c"], np.uint32).astype(U64) | (U64(r["bucket"]) << U64(32))
                    parts.append((np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], U64), anchor, np.frombuffer(r["d"], U64)))
        if not parts:
            return
        doc, place, anchor, content = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        order, least, heads = _collapse(doc, anchor, content)
        doc, place, anchor = doc[order], place[order], anchor[order]
        lo = (place >> U64(16)).astype(np.uint32)
        hi = lo + (place & U64(0xFFFF)).astype(np.uint32)
        if not least.all():
            yield from dealt("f", home(doc[~least], homes), homes, doc[~least], lo[~least], hi[~least])
        of_anchor = np.zeros(len(doc), np.int64)
        of_anchor[_runs(anchor)] = 1
        of_anchor = np.cumsum(of_anchor) - 1
        contents = np.bincount(of_anchor[heads])
        size = np.bincount(of_anchor[least], minlength=len(contents))
        for kind, some in (("o", (contents > 1) & (size <= hot)), ("h", (contents > 1) & (size > hot))):
            pick = np.flatnonzero(some[of_anchor] & least)
            if len(pick):
                pick = pick[np.lexsort((lo[pick], doc[pick]))]
                yield from dealt(kind, home(doc[pick], homes), homes, doc[pick], lo[pick], hi[pick], K.mix(anchor[pick], 31))

    return run


def texts(docs: DataFrame, homes: int) -> DataFrame:
    """Kind ``t``: texts by document, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(homes)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for b, some in enumerate(held):
                if some:
                    ids, raw = zip(*some)
                    yield batch([("t", b, np.array(ids, np.int64).tobytes(), np.array([len(t) for t in raw], np.int64).tobytes(), zstandard.compress(b"".join(raw), 1))])
                    some.clear()

        for rows in batches:
            ids = K.int_column(rows, "doc_id")
            where = home(ids, homes)
            for lo, hi, data, offsets in K.slices(rows):
                raw = data.tobytes()
                for i in range(hi - lo):
                    held[where[lo + i]].append((ids[lo + i], raw[offsets[i] : offsets[i + 1]]))
                size += len(raw)
                if size >= PACKED:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, COLUMNS)


def joined(handle: Callable, send: Callable | None = None) -> Callable:
    """A task's documents with what was found of them.

    Waits for all blobs, since they come in any order; texts stay packed meanwhile.
    Calls ``handle(ids, data, offsets, found)`` for each blob of texts, where
    ``found[kind]`` has that kind's arrays ordered by document.  It gives batches, or
    tuples of arrays, the last of bytes: these are held up to PACKED bytes over many
    blobs of texts and go to ``send`` together, so that batches grow with what there
    is to send and not with the blobs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, parts, held, size = [], {}, [], 0
        for rows in batches:
            for r in rows.to_pylist():
                if r["kind"] == "t":
                    packed.append((np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64), r["c"]))
                else:
                    kinds = (np.int64, np.uint32, np.uint32, U64)
                    parts.setdefault(r["kind"], []).append(tuple(np.frombuffer(r[k], t) for k, t in zip("abcd", kinds) if r[k] is not None))
        found = {}
        for kind, some in parts.items():
            arrays = [np.concatenate(c) for c in zip(*some)]
            order = np.argsort(arrays[0], kind="stable")
            found[kind] = [a[order] for a in arrays]
        while packed:
            ids, lengths, raw = packed.pop()
            offsets = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(lengths, out=offsets[1:])
            data = np.frombuffer(zstandard.decompress(raw), np.uint8)
            for made in handle(ids, data, offsets, found):
                if not isinstance(made, tuple):
                    yield made
                    continue
                held.append(made)
                size += len(made[-1])
                if size >= PACKED:
                    yield from send(*(np.concatenate(c) for c in zip(*held)))
                    held, size = [], 0
        if held:
            yield from send(*(np.concatenate(c) for c in zip(*held)))

    return run


def of_documents(ids: np.ndarray, arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``arrays`` (ordered by document) belong to these documents, and the documents' indices."""
    lo, hi = np.searchsorted(arrays[0], ids, "left"), np.searchsorted(arrays[0], ids, "right")
    return K.ragged(lo, hi - lo), np.repeat(np.arange(len(ids)), hi - lo)


def _contexts(of: Windows, buckets: int, homes: int):
    """Kind ``c``: contexts of open segments by anchor: documents, (first window, windows), anchors, packed bytes after their lengths."""

    def send(doc, place, anchor, length, data) -> Iterator[pa.RecordBatch]:
        bucket = ((anchor >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        start = np.cumsum(length) - length
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edge)):
            pick = order[edge[b] : edge[b + 1]]
            raw = length[pick].astype(np.uint32).tobytes() + data[K.ragged(start[pick], length[pick])].tobytes()
            rows.append(("c", int(b), doc[pick].tobytes(), place[pick].tobytes(), anchor[pick].tobytes(), zstandard.compress(raw, 1)))
            if len(rows) == 64:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def context(doc, lo, n, anchor, data, start, stop) -> tuple[np.ndarray, ...]:
        return doc, (lo.astype(U64) << U64(16)) | n.astype(U64), anchor, stop - start, data[K.ragged(start, stop - start)]

    def handle(ids, data, offsets, found) -> Iterator[pa.RecordBatch | tuple[np.ndarray, ...]]:
        if not found:
            return
        sums, first, begin, end = of.tokens(data, offsets)
        if "o" in found:
            rows, doc = of_documents(ids, found["o"])
            if len(rows):
                lo, hi, anchor = (found["o"][i][rows].astype(t) for i, t in ((1, np.int64), (2, np.int64), (3, U64)))
                at = first[doc] + lo
                yield context(ids[doc], lo, hi - lo + 1, anchor, data, begin[at], end[first[doc] + hi + of.width - 1])
        if "h" in found:
            rows, doc = of_documents(ids, found["h"])
            if len(rows):
                lo, hi = (found["h"][i][rows].astype(np.int64) for i in (1, 2))
                doc, lo = np.repeat(doc, hi - lo + 1), K.ragged(lo, hi - lo + 1)
                at = first[doc] + lo
                content = K.hashes(sums, at, at + of.width, of.key)
                order = np.lexsort((ids[doc], content))
                heads = _runs(content[order])
                least = np.repeat(ids[doc[order[heads]]], np.diff(np.append(heads, len(order))))
                late = order[ids[doc[order]] != least]
                if len(late):
                    yield from dealt("f", home(ids[doc[late]], homes), homes, ids[doc[late]], lo[late].astype(np.uint32), lo[late].astype(np.uint32))
                keep = order[ids[doc[order]] == least]
                doc, lo, at = doc[keep], lo[keep], at[keep]
                yield context(ids[doc], lo, np.ones(len(doc), np.int64), K.mix(content[keep], 32), data, begin[at], end[at + of.width - 1])

    return joined(handle, send)


def _search(of: Windows, homes: int, compare: Callable):
    """Compares contexts; kind ``f``: windows that repeat, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for rows in batches:
            for r in rows.to_pylist():
                if r["kind"] == "f":
                    yield batch([tuple(r.values())])
                else:
                    parts.append((np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], U64), np.frombuffer(r["c"], U64), r["d"]))
        if not parts:
            return
        data, lengths = [], []
        for doc, _, _, raw in parts:
            raw = zstandard.decompress(raw)
            lengths.append(np.frombuffer(raw, np.uint32, len(doc)).astype(np.int64))
            data.append(np.frombuffer(raw, np.uint8, offset=4 * len(doc)))
        doc, place, anchor = (np.concatenate([p[i] for p in parts]) for i in range(3))
        parts.clear()
        data, lengths = np.concatenate(data), np.concatenate(lengths)
        start = np.cumsum(lengths) - lengths
        # Contexts of one anchor stand together; a portion ends where an anchor does.
        order = np.argsort(anchor, kind="stable")
        upto = np.cumsum(lengths[order])
        heads = _runs(anchor[order])
        at = 0
        while at < len(order):
            goal = (upto[at - 1] if at else 0) + of.width * 80_000
            stop = int(np.searchsorted(upto, goal)) + 1
            later = heads[np.searchsorted(heads, stop) :]
            stop = int(later[0]) if len(later) else len(order)
            pick = order[at:stop]
            ends = np.zeros(len(pick) + 1, np.int64)
            np.cumsum(lengths[pick], out=ends[1:])
            which, window = compare(data[K.ragged(start[pick], lengths[pick])], ends, doc[pick], (place[pick] & U64(0xFFFF)).astype(np.int64))
            if len(which):
                own, lo = doc[pick[which]], ((place[pick[which]] >> U64(16)).astype(np.int64) + window).astype(np.uint32)
                yield from dealt("f", home(own, homes), homes, own, lo, lo)
            at = stop

    return run


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text), one row a document: of rows that share an id, the one with the largest text."""
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.max("text").alias("text"))


def repeated(docs: DataFrame, of: Windows, compare: Callable, finish: Callable, schema: str, hot: int = HOT) -> DataFrame:
    """Rows made by ``finish`` from each document and the windows of it that a smaller doc_id has too."""
    n = SPREAD * partitions(docs.sparkSession)
    met = docs.mapInArrow(_scan(of, n, n), COLUMNS).repartitionById(n, F.col("bucket")).mapInArrow(_meet(n, hot), COLUMNS)
    met = cut(met, "segments")
    opened = texts(docs, n).union(met.where("kind in ('o', 'h')")).repartitionById(n, F.col("bucket"))
    contexts = opened.mapInArrow(_contexts(of, n, n), COLUMNS).repartitionById(n, F.col("bucket"))
    found = cut(contexts.mapInArrow(_search(of, n, compare), COLUMNS), "windows")
    whole = texts(docs, n).union(met.where("kind = 'f'")).union(found)
    return whole.repartitionById(n, F.col("bucket")).mapInArrow(joined(finish), schema)


def covered(ids: np.ndarray, first: np.ndarray, found: dict, width: int) -> np.ndarray:
    """Which tokens of these documents a repeating window covers."""
    edge = np.zeros(int(first[-1]) + 1, np.int32)
    if "f" in found:
        rows, doc = of_documents(ids, found["f"])
        lo, hi = (first[doc] + found["f"][i][rows] for i in (1, 2))
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi + width, -1)
    return np.cumsum(edge[:-1]) > 0
