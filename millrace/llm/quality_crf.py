"""Document quality from a linear-chain conditional random field over lines.

Every line that isn't blank is good or bad.  Its features, and those of the lines
before and after it, give a log-odds; transitions tie neighbours together.  Forward
and backward sums give each line's marginal, the marginals' mean weighted by length
is the document's raw quality, and a logistic curve fitted on the same training
documents turns it into a score.

With two labels the forward sums need one number a line, the log-odds of the label,
so all documents of a batch advance together, line by line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import only

#: Labelled documents that the model is fitted on at most, those whose ids hash lowest.
SAMPLE = 4000
#: Bytes of their texts at most, which the driver holds.
BYTES = 1 << 26
ROUNDS = 120
#: The score of a text without any line that isn't blank.
NOTHING = 0.0

_KINDS = np.zeros((7, 256), np.float32)
_KINDS[0, 65:91] = 1  # capitals
_KINDS[1, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters, by bytes
_KINDS[2, 48:58] = 1
_KINDS[3, [c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_KINDS[4, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 1
_KINDS[5, ord("!")] = 1
_KINDS[6, [ord(c) for c in ".,;:?"]] = 1
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and each document's first line (one longer than the documents)."""
    start, end, first_word = K.words(data, offsets)
    if not len(start):
        return np.zeros((0, 3 * 14 + 1), np.float32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # A word opens a line if it opens a document or a line feed stands before it.
    feeds = np.cumsum(data == 10)
    opens = np.ones(len(start), bool)
    opens[1:] = feeds[start[1:]] != feeds[start[:-1]]
    inner = first_word[:-1][first_word[:-1] < len(start)]
    opens[inner] = True
    head = np.flatnonzero(opens)
    tail = np.append(head[1:], len(start)) - 1
    begin, stop = start[head], end[tail]
    size = (stop - begin).astype(np.float64)
    # Bytes after a line's end up to the next line's start are white space and count as nothing.
    kind = [np.add.reduceat(t[data], begin).astype(np.float64) for t in _KINDS]
    count = (tail - head + 1).astype(np.float64)
    word = K.word_hashes(data, start, end)
    again = np.zeros((2, len(word)))
    again[0, 1:] = word[1:] == word[:-1]
    again[1, 2:] = word[2:] == word[:-2]
    again[:, head] = 0
    again[1, np.minimum(head + 1, len(word) - 1)[tail > head]] = 0
    repeats = [np.add.reduceat(a, head) / count for a in again]
    letters = np.maximum(kind[1], 1)
    own = np.stack(
        [
            np.log1p(size) / 8, np.log1p(count) / 6, kind[0] / letters, kind[1] / size, kind[2] / size, kind[3] / size,
            np.sqrt(kind[4] / size), np.sqrt(kind[5] / size), np.sqrt(kind[6] / size), np.sqrt(repeats[0]), np.sqrt(repeats[1]),
            np.minimum(size / count / 12, 2), _ENDS[data[stop - 1]], (kind[4] > 0).astype(np.float64),
        ],
        1,
    ).astype(np.float32)
    first = np.searchsorted(head, first_word)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = first[:-1][first[:-1] < len(own)]
    before[edge] = 0
    after[first[1:][first[1:] > 0] - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1), np.float32)]), size.astype(np.int64), first


@dataclass
class Model:
    weights: np.ndarray
    #: Log-potentials of (label, next label).
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, local: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds of label 1 at each line."""
        count = np.diff(first)
        order = np.argsort(-count, kind="stable")
        begin, length = first[:-1][order], count[order]
        live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
        m = self.moves
        ahead, back = local.astype(np.float64).copy(), np.zeros(len(local))
        for t in range(1, len(live)):
            at = begin[: live[t]] + t
            before = ahead[at - 1]
            ahead[at] += np.logaddexp(m[0, 1], m[1, 1] + before) - np.logaddexp(m[0, 0], m[1, 0] + before)
        for t in range(len(live) - 2, -1, -1):
            at = begin[: live[t + 1]] + t
            after = local[at + 1] + back[at + 1]
            back[at] = np.logaddexp(m[1, 0], m[1, 1] + after) - np.logaddexp(m[0, 0], m[0, 1] + after)
        return ahead, back

    def raw(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds of each document's mean marginal, weighted by the lines' lengths."""
        ahead, back = self.odds(x @ self.weights, first)
        good = 1 / (1 + np.exp(-(ahead + back)))
        sums = np.concatenate([[0.0], np.cumsum(good * size)])
        total = np.concatenate([[0.0], np.cumsum(size)])
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(total[first[1:]] - total[first[:-1]], 1)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, size, first = features(data, offsets)
        out = 1 / (1 + np.exp(-(self.slope * self.raw(x, size, first) + self.shift)))
        return np.where(np.diff(first) > 0, out, NOTHING)


def _sliced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of many documents, made slice by slice: the temporaries of all at once wouldn't fit a driver."""
    rows = pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.large_string())], ["text"])
    parts = [features(d, o) for _, _, d, o in K.slices(rows)]
    if not parts:
        return features(data, offsets)
    ends = np.cumsum([0] + [len(x) for x, _, _ in parts])
    first = np.concatenate([f[:-1] + e for (_, _, f), e in zip(parts, ends)] + [ends[-1:]])
    return np.concatenate([x for x, _, _ in parts]), np.concatenate([n for _, n, _ in parts]), first


def fit(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The field's most likely weights, by Adam; every line of a training document bears its label."""
    x, size, first = _sliced(data, offsets)
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(x) or len(set(labels.tolist())) < 2:
        model.shift = float(np.clip(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)), -6, 6)) if len(labels) else 0.0
        model.slope = 0.0
        return model
    y = np.repeat(labels.astype(np.float64), np.diff(first))
    pair = np.ones(len(y), bool)
    pair[first[1:][first[1:] > 0] - 1] = False
    at = np.flatnonzero(pair)
    seen = np.array([[np.sum(y[at] == 0), 0], [0, np.sum(y[at] == 1)]], float)
    state = np.zeros((2, x.shape[1] + 4))
    for k in range(1, rounds + 1):
        local = x @ model.weights
        ahead, back = model.odds(local, first)
        p = 1 / (1 + np.exp(-(ahead + back)))
        after = local[at + 1] + back[at + 1]
        log = np.stack([model.moves[r, s] + r * ahead[at] + s * after for r in (0, 1) for s in (0, 1)])
        each = np.exp(log - np.logaddexp.reduce(log, axis=0)).sum(1).reshape(2, 2)
        gradient = np.concatenate([x.T @ (y - p), (seen - each).ravel()]) / len(y) - 1e-4 * np.concatenate([model.weights, model.moves.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        step = 0.3 * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
        model.weights += step[:-4]
        model.moves += step[-4:].reshape(2, 2)
    raw, a, b = model.raw(x, size, first), 1.0, 0.0
    some = np.diff(first) > 0
    z, t = raw[some], labels[some]
    for _ in range(50):  # Newton on the logistic curve
        q = 1 / (1 + np.exp(-(a * z + b)))
        w = q * (1 - q) + 1e-6
        h = np.array([[np.sum(w * z * z) + 1e-2, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-2]])
        d = np.linalg.solve(h, [np.sum((t - q) * z) - 1e-2 * (a - 1), np.sum(t - q) - 1e-2 * b])
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
    model.slope, model.shift = a, b
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BYTES) -> Model:
    """A model from labelled documents that aren't held out: those whose ids hash lowest, up to ``sample`` of them and ``most`` bytes of text."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "y").where("doc_id is not null")
    found = texts.join(F.broadcast(chosen), "doc_id")
    # One row each, and no text: at most ``sample`` of them.
    sizes = found.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    kept, held = [], 0
    for r in sizes:  # a text that doesn't fit shuts out no other
        if held + r["n"] <= most:
            kept.append((r["doc_id"],))
            held += r["n"]
    rows = []
    if kept:
        ids = docs.sparkSession.createDataFrame(kept, "doc_id long")
        rows = found.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    raw = [r["text"].encode("utf-8") for r in rows]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) for t in raw], out=offsets[1:])
    return fit(np.frombuffer(b"".join(raw), np.uint8), offsets, np.array([r["y"] for r in rows], np.int64))


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with one more column, the score of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in K.slices(batch):
                score[lo:hi] = model.score(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality; further columns are
    ignored.  Rows without a doc_id are dropped, repeated rows scored each.  A null,
    empty or blank text scores NOTHING.  Without labels of both kinds every text gets
    the share of the kind there is.  Of several labels of a document the largest counts;
    of rows that share a doc_id the one with the largest text is learnt from.  A very long
    text is scored line by line as a whole.  An empty table gives an empty result.
    """
    model = train(docs, labels, sample)
    out = scored(only(docs, "doc_id", "text"), model).select(F.col("doc_id").cast("long").alias("doc_id"), "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
