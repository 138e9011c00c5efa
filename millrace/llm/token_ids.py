"""Token ids of whole documents, written as directly addressable codes and read back."""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dac
from . import kernels as K
from .store import cut, only, partitions

#: Appended to each document.
END = 1
#: Tokens of a file, at least, before a task begins the next one.
SHARD = 1 << 20
#: Different units whose ids a worker remembers; then it begins anew.
REMEMBERED = 3 << 19

_SPACE, _LETTER, _HIGH, _DIGIT, _QUOTE, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[K.SPACE] = _SPACE
_CLASS[128:] = _HIGH
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _QUOTE
#: Whether a unit ends between two adjacent classes.  Only where the tokenizer
#: splits too, whatever else stands around: between ASCII letters, digits and
#: signs.  Not at apostrophes (contractions) or other characters (they may
#: compose with what is before them).
_SPLIT = np.zeros((6, 6), bool)
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _OTHER), (_DIGIT, _LETTER), (_DIGIT, _DIGIT), (_DIGIT, _OTHER), (_OTHER, _LETTER), (_OTHER, _DIGIT)):
    _SPLIT[_a, _b] = True
_SPLIT[_SPACE, 1:] = True
_SPECIAL = re.compile(rb"<\|(?:startoftext|endoftext)\|>")


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first index by document of the stretches that the tokenizer encodes apart from each other."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    begins = np.ones(n, bool)
    begins[1:] = _SPLIT.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
    begins[offsets[:-1][offsets[:-1] < n]] = True
    inside = kind != _SPACE
    begins &= inside
    start = np.flatnonzero(begins)
    # A unit ends before the next one, before white space, or at the document's end.
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


class Encoder:
    """Encodes batches; each different unit goes to the tokenizer once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        gc.freeze()
        gc.set_threshold(200_000, 50, 1000)  # the index holds no cycles worth searching for
        self.whole = Tokenizer.from_file(path)
        # Lower-case Latin words are the same before and after normalizing and splitting.
        self.bare = Tokenizer(self.whole.model)
        spare = iter(range(256, 512))
        keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.shown = {b: (b if b in keep else next(spare)) for b in range(256)}
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = self.units = self.full = 0
        # Units' bytes in lower case: hashes only say where to look.
        self.raw = np.zeros(1 << 20, np.uint8)
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.others: dict[bytes, int] = {}
        self.salt = K.drawn()
        gc.collect()
        self.seen = np.zeros(1 << 21, np.uint64)
        self.slots = np.full(1 << 21, -1, np.int64)

    def learn(self, texts: list[bytes], keys: list[int] | None) -> None:
        """Encodes units for the first time; without keys they are found by their bytes alone."""
        plain, rest, order, others = [], [], [], []
        for i, raw in enumerate(texts):
            text = raw.decode()
            if text.isalpha() and (text.isascii() or max(text) < "ɐ" and "İ" not in text):
                order.append(i)
                plain.append(text.lower() if text.isascii() else text.lower().encode().decode("latin-1").translate(self.shown))
            else:
                others.append(i)
                rest.append(text)
        batches = [plain[k : k + 512] for k in range(0, len(plain), 512)]
        done = [e.ids for e in self.bare.encode_batch_fast(batches, is_pretokenized=True, add_special_tokens=False)]
        ids = np.fromiter((t for x in done for t in x), np.uint32, sum(map(len, done)))
        ends = np.flatnonzero(self.last[ids]) + 1  # a word's last token carries its end
        if len(ends) != len(plain):
            raise RuntimeError("a word was encoded without its end")
        lengths = [np.diff(ends, prepend=0)]
        whole = [e.ids for e in self.whole.encode_batch_fast(rest, add_special_tokens=False)]
        order += others
        lengths.append(np.array([len(x) for x in whole], np.int64))
        ids = np.concatenate([ids, np.fromiter((t for x in whole for t in x), np.uint32)])
        lengths = np.concatenate(lengths)
        base, count = self.units, len(texts)
        raw = K.FOLD[np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)]
        size = np.array([len(texts[i]) for i in order], np.int64)
        while self.full + len(raw) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + count > len(self.start):
            self.start, self.length, self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.at, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[base : base + count] = self.used + np.cumsum(lengths) - lengths
        self.length[base : base + count] = lengths
        self.used += len(ids)
        self.raw[self.full : self.full + len(raw)] = raw
        self.at[base : base + count] = self.full + np.cumsum(size) - size
        self.size[base : base + count] = size
        self.full += len(raw)
        self.units += count
        if keys is None:
            self.others.update(zip((K.FOLD[np.frombuffer(texts[i], np.uint8)].tobytes() for i in order), range(base, base + count)))
            return
        named = np.array(keys, np.uint64)[order]
        self.index.update(zip(named.tolist(), range(base, base + count)))
        slot = named >> np.uint64(43)
        free = self.slots[slot] < 0
        self.seen[slot[free]] = named[free]
        self.slots[slot[free]] = np.arange(base, base + count)[free]
        # Of several units for one free slot the last stays, in both arrays alike.

    def find(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each unit: from a direct-mapped table, or else from the index."""
        at = key >> np.uint64(43)
        slot = np.where(self.seen[at] == key, self.slots[at], -1)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            some, one, back = np.unique(key[missing], return_index=True, return_inverse=True)
            keys = some.tolist()
            new = [j for j, k in enumerate(keys) if k not in self.index]
            if self.units + len(new) > REMEMBERED and self.index:
                self.clear()
                return self.find(K.word_hashes(K.FOLD[data], start, end, self.salt), data, start, end)
            if new:
                first = missing[one[new]]
                self.learn([data[s:e].tobytes() for s, e in zip(start[first], end[first])], [keys[j] for j in new])
            slot[missing] = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))[back]
        folded = K.FOLD[data]
        clash = np.flatnonzero(~K.same(folded, start, end - start, self.raw, self.at[slot], self.size[slot]))
        if len(clash):
            raw = [folded[s:e].tobytes() for s, e in zip(start[clash].tolist(), end[clash].tolist())]
            new = [r for r in dict.fromkeys(raw) if r not in self.others]
            if new:
                self.learn(new, None)
            slot[clash] = [self.others[r] for r in raw]
        return slot

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and how many each has."""
        start, end, first = units(data, offsets)
        slot = self.find(K.word_hashes(K.FOLD[data], start, end, self.salt), data, start, end)
        length = self.length[slot]
        ids = self.flat[K.ragged(self.start[slot], length)]
        upto = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(length, out=upto[1:])
        count = np.diff(upto[first])
        raw = data.tobytes()
        odd = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in _SPECIAL.finditer(raw)} if b"text|>" in raw else ()
        if odd:  # the names of special tokens, which the tokenizer finds before it splits
            parts = np.split(ids, np.cumsum(count)[:-1])
            for d in odd:
                parts[d] = np.array(self.whole.encode(raw[offsets[d] : offsets[d + 1]].decode("utf-8"), add_special_tokens=False).ids, np.uint32)
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, count


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; a path that is a bare name is looked up among the installed public ones."""
    if path not in _encoders:
        where = path
        if not os.path.isabs(path):
            import public_tokenizers

            where = public_tokenizers.path(path)
        _encoders[path] = Encoder(where)
    return _encoders[path]


def _write(path: str, shard: int):
    """Files of whole documents, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        docs, counts, ids = [], [], []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            offsets = np.zeros(sum(len(c) for c in counts) + 1, np.int64)
            np.cumsum(np.concatenate(counts), out=offsets[1:])
            file = dac.pack(np.concatenate(docs), offsets, np.concatenate(ids))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([file], pa.binary())], ["part", "number", "n_tokens", "file"])
            number, size = number + 1, 0
            docs.clear(), counts.clear(), ids.clear()
            return out

        for batch in batches:
            own = K.int_column(batch, "doc_id")
            for lo, hi, data, offsets in K.slices(batch, size=1 << 19):
                found, count = coder.encode(data, offsets)
                # Each document's end id goes after its own ids.
                found = np.insert(found, np.cumsum(count), END)
                docs.append(own[lo:hi])
                counts.append(count + 1)
                ids.append(found)
                size += len(found)
                if size >= shard:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str = "word_bpe_49k.json", shard: int = SHARD) -> DataFrame:
    """(part, number, n_tokens, file): the files of all documents, in ascending doc_id by part and number.

    ``docs`` has doc_id and text; further columns are ignored and rows without a
    doc_id dropped.  A null or empty text has the end id alone.  Rows that share a
    doc_id are all kept, ordered by text.  The rows live in the shared folder as a
    table whose ``file`` column holds the files' bytes.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = docs.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ranged.mapInArrow(_write(path, shard), "part int, number int, n_tokens long, file binary"), "tokens")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            file = dac.Reader(batch.column(2)[r].as_buffer())
            n = len(file.doc_ids)
            sums = [zlib.crc32(file.document(k).astype("<u4").tobytes()) for k in range(n)]
            part, number = (pa.array([batch.column(c)[r].as_py()] * n, pa.int32()) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([part, number, pa.array(file.doc_ids), pa.array(file.offsets[:-1]), pa.array(np.diff(file.offsets)), pa.array(sums, pa.int64())], ["part", "number", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the tokens of all documents before: within a part by a window
    over its files, between parts by their sums, of which the driver holds one each.
    The files' bytes are read in place; only a small row a document is joined.
    """
    sums = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = [], 0
    for part in sorted(sums):
        base.append((part, total))
        total += sums[part]
    bases = F.broadcast(files.sparkSession.createDataFrame(base, "part int, base long"))
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", "number", F.coalesce(before, F.lit(0)).alias("before")).join(bases, "part")
    rows = files.select("part", "number", "file").mapInArrow(_read, "part int, number int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "number"]).select("doc_id", (F.col("base") + F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
