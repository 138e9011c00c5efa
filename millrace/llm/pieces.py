"""SentencePiece encoding and decoding over a relational lattice.

1. The distinct words of the corpus are counted.  A word is a run of spaces
   (shown as U+2581) and what follows up to the next space, and no piece reaches
   across words, so the best segmentation of a text is that of its words.
2. The lattice: each word's substrings, no longer than the longest piece, are
   exploded and equi-joined to the piece table; a character that no piece covers
   has an edge that stands for its UTF-8 bytes.
3. Edges are grouped by word, and a higher-order ``aggregate`` folds Viterbi over
   them in order of their ends: for each position the best sum and the last edge.
4. The dictionary of encoded words goes to the tasks up to a bound on its entries,
   the most frequent words first, and documents are written out in ids.  Words
   beyond the bound are folded by the same rule in the task that meets them.

Among equal sums the longer last edge wins, in both forms.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .store import cut, only

SPACE = "▁"
#: What each piece costs beside its rank; ranks of a word's pieces sum to less.
EACH = float(1 << 24)
#: Added to the worst piece's score for a character in bytes.
BYTES_PENALTY = 2 * EACH
#: Words of the dictionary that tasks hold.
DICTIONARY = 1 << 19
#: Words beyond it that a task remembers.
REMEMBERED = 1 << 16
#: Of a word's hash, the bits below those that are looked up at once.
SHIFT = np.uint64(44)
#: Longer words are folded in the task; their state would be copied too often.
LONGEST = 64

_WORD = re.compile(SPACE + "*[^" + SPACE + "]+|" + SPACE + "+")


class Model:
    """The pieces of a model file with the scores that the lattice adds up.

    The file's own scores are ranks of merges, not log-probabilities, and their sums say
    little.  A piece costs EACH and its rank: the best segmentation has the fewest pieces,
    and of these the lowest ranks in all.  Sums are whole numbers, so no rounding decides.
    A score in the file above -1e8 gives the rank, and pieces without one (runs of
    spaces) rank by their id.
    """

    def __init__(self, path: str):
        import sentencepiece

        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i, text in enumerate(self.texts):
            if i in self.byte_of or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or SPACE in text.lstrip(SPACE):
                continue
            rank = -sp.get_score(i) if sp.get_score(i) > -1e8 else i
            self.scores[text], self.ids[text] = -float(EACH + round(rank)), i
        self.longest = max(map(len, self.scores))
        self.fallback = min(self.scores.values()) - BYTES_PENALTY
        # Scores by what pieces begin with: a start's edges end where nothing goes on so.
        self.reach = {t[:k]: -math.inf if k > 1 else self.fallback for t in self.scores for k in range(1, len(t))} | self.scores

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score): as many rows as the vocabulary, whatever the corpus."""
        return spark.createDataFrame([(t, self.ids[t], s) for t, s in self.scores.items()], "piece string, id int, score double")

    def spell(self, character: str) -> list[int]:
        """Ids of a character's bytes."""
        return [self.bytes.get(b, self.unknown) for b in character.encode("utf-8")]

    def fold(self, word: str) -> list[int]:
        """Viterbi over one word, by the rule of the lattice."""
        n, reach, fallback = len(word), self.reach, self.fallback
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        # Longer edges to an end come first, so of equal sums the longer stays.
        for start in range(n):
            base, end = best[start], start + 1
            score = reach.get(word[start:end], fallback)
            while score is not None:
                if base + score > best[end]:
                    best[end], back[end] = base + score, end - start
                end += 1
                score = reach.get(word[start:end]) if end <= n else None
        out, end = [], n
        while end:
            piece = word[end - back[end] : end]
            out.append([self.ids[piece]] if piece in self.ids else self.spell(piece))
            end -= back[end]
        return [i for part in reversed(out) for i in part]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, bytes put together, the added space removed."""
        out, raw = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.texts[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[1:]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def words_of(text: str) -> list[str | None]:
    """A text's words: spaces as U+2581, one put before the first.  None stands for U+2581 itself, which goes by its bytes."""
    if SPACE not in text:
        return _WORD.findall(SPACE + text.replace(" ", SPACE))
    out: list[str | None] = []
    for k, part in enumerate(text.split(SPACE)):
        out += [None] * (k > 0) + _WORD.findall(SPACE * (k == 0) + part.replace(" ", SPACE))
    return out


def lattice(words: DataFrame, pieces: Model) -> DataFrame:
    """(word, ids) of distinct words of at most LONGEST characters, by the lattice's best path.

    The explosion makes at most ``longest`` rows a character.  The piece table is
    broadcast: it has the vocabulary's size, which doesn't depend on the corpus.
    """
    spark = words.sparkSession
    spans = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    spans = spans.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("word") - F.col("start") + 1))).alias("size"))
    spans = spans.withColumn("piece", F.substring("word", F.col("start"), F.col("size")))
    edges = spans.join(F.broadcast(pieces.table(spark)), "piece", "left").where("id is not null or size = 1")
    edge = F.struct((F.col("start") + F.col("size") - 1).alias("end"), "size", F.coalesce("score", F.lit(pieces.fallback)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    # The state holds (sum, last edge) by position; an edge's end is the last position or the next.
    state = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("size"), F.lit(0).alias("id")))

    def step(acc, e):
        here = F.struct((F.element_at(acc, e["end"] - e["size"] + 1)["sum"] + e["score"]).alias("sum"), e["size"].alias("size"), e["id"].alias("id"))
        last = F.element_at(acc, -1)
        grown = F.concat(acc, F.array(here))
        # Edges come by (end, size): of equal sums the longer stays.
        better = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.when(here["sum"] >= last["sum"], here).otherwise(last)))
        return F.when(F.size(acc) == e["end"], grown).otherwise(better)

    folded = grouped.select("word", F.aggregate("edges", state, step).alias("best"))
    # Back from the end: (position, ids so far).
    start = F.struct(F.size("best").alias("at"), F.array().cast("array<int>").alias("ids"))

    def walk(acc, _):
        node = F.element_at(F.col("best"), acc["at"])
        moved = F.struct((acc["at"] - node["size"]).alias("at"), F.concat(F.array(F.when(node["id"] >= 0, node["id"]).otherwise(-(acc["at"] - 1))), acc["ids"]).alias("ids"))
        return F.when(acc["at"] > 1, moved).otherwise(acc)

    # An id below 0 stands for the character at that position, in bytes.
    return folded.select("word", F.aggregate("best", start, walk)["ids"].alias("ids"))


def _spelled(pieces: Model, word: str, ids: list[int]) -> list[int]:
    return ids if min(ids) >= 0 else [j for i in ids for j in ([i] if i >= 0 else pieces.spell(word[-i - 1]))]


class Known:
    """Encoded words as packed arrays, looked up by the words' hashes and then compared."""

    def __init__(self, found: Iterable[tuple[str, list[int]]]):
        # Packed as they come: lists of half a million words and their ids would take a driver's memory.
        raw, ends, flat, count = bytearray(), array("q", [0]), array("I"), array("q")
        for word, ids in found:
            raw += word.replace(SPACE, " ").encode("utf-8")
            ends.append(len(raw))
            flat.extend(ids)
            count.append(len(ids))
        edges, length = np.array(ends, np.int64), np.array(count, np.int64)
        self.raw, self.salt = np.frombuffer(bytes(raw), np.uint8), K.drawn()
        keys = K.word_hashes(self.raw, edges[:-1], edges[1:], self.salt)
        order = np.argsort(keys)
        self.at, self.size = edges[:-1][order].astype(np.int32), np.diff(edges)[order].astype(np.int32)
        self.keys = keys[order]
        self.length = length[order].astype(np.uint16)
        self.start = (np.cumsum(length) - length)[order].astype(np.uint32)
        self.ids = np.array(flat, np.uint32)
        # Where keys with the same upper bits begin.
        self.first = np.searchsorted(self.keys >> SHIFT, np.arange((1 << 64 - int(SHIFT)) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Each word's place, or -1; of words with one hash the first alone is found."""
        out = np.full(len(key), -1, np.int64)
        top = (key >> SHIFT).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        live = np.flatnonzero(at < stop)
        at, stop = at[live], stop[live]
        while len(live):
            hit = self.keys[at] == key[live]
            out[live[hit]] = at[hit]
            at += 1
            going = ~hit & (at < stop)
            live, at, stop = live[going], at[going], stop[going]
        hit = np.flatnonzero(out >= 0)
        equal = K.same(data, start[hit], (end - start)[hit], self.raw, self.at[out[hit]], self.size[out[hit]])
        out[hit[~equal]] = -1
        return out


def dictionary(texts: DataFrame, pieces: Model, bound: int = DICTIONARY) -> Known:
    """Encoded words of a column ``text``: all distinct ones, or if more than ``bound`` those above a count that keeps to it."""
    marked = F.concat(F.lit(" "), F.regexp_replace("text", SPACE, "\u0000"))
    words = texts.where("text is not null").select(F.explode(F.regexp_extract_all(marked, F.lit(" *[^ ]+"), 0)).alias("word"))
    counts = words.where(~F.col("word").contains("\u0000") & (F.length("word") <= LONGEST)).groupBy("word").count()
    counts = cut(counts, "words")
    least, total = None, 0
    # One row for each count that occurs; from the top, as long as all words of a count still fit.
    for row in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():
        total += row["n"]
        if total > bound:
            break
        least = row["count"]
    if least is None:
        return Known(())
    kept = counts.where(F.col("count") >= least).select(F.translate("word", " ", SPACE).alias("word"))
    return Known((r["word"], _spelled(pieces, r["word"], r["ids"])) for r in lattice(kept, pieces).toLocalIterator(prefetchPartitions=True))


class Encoder:
    """Encodes slices of texts by the dictionary; words that it lacks are folded, and remembered up to REMEMBERED."""

    def __init__(self, pieces: Model, known: Known):
        self.pieces, self.known = pieces, known
        self.rare: dict[bytes, np.ndarray] = {}

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        size = np.diff(offsets)
        # Each text that isn't empty gets a space before it; a word begins where a run of spaces does.
        full = size > 0
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        blank = data == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[offsets[:-1][full]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        known = self.known
        key = K.word_hashes(data, start, end, known.salt)
        at = known.find(data, start, end, key)
        hit = at >= 0
        count = np.zeros(len(key), np.int64)
        count[hit] = known.length[at[hit]]
        missed = np.flatnonzero(~hit)
        found: list[np.ndarray] = []
        if len(missed):
            _, one, back = np.unique(key[missed], return_index=True, return_inverse=True)
            first, size = missed[one][back], (end - start)[missed]
            # Of one hash, but another word: each counts for itself.
            other = np.flatnonzero(~K.same(data, start[missed], size, data, start[first], (end - start)[first]))
            back[other] = np.arange(len(one), len(one) + len(other))
            for i in np.concatenate([missed[one], missed[other]]).tolist():
                raw = data[start[i] : end[i]].tobytes()
                ids = self.rare.get(raw)
                if ids is None:
                    ids = np.array(self.word(raw.decode("utf-8")), np.uint32)
                    if len(self.rare) >= REMEMBERED:
                        self.rare.clear()
                    if len(ids) <= 2 * LONGEST:
                        self.rare[raw] = ids
                found.append(ids)
            length = np.array([len(f) for f in found], np.int64)
            count[missed] = length[back]
        out = np.zeros(int(count.sum()), np.uint32)
        place = np.cumsum(count) - count
        out[K.ragged(place[hit], count[hit])] = known.ids[K.ragged(known.start[at[hit]].astype(np.int64), count[hit])]
        if len(missed):
            flat = np.concatenate(found)
            begin = np.cumsum(length) - length
            out[K.ragged(place[missed], count[missed])] = flat[K.ragged(begin[back], length[back])]
        upto = np.concatenate([[0], np.cumsum(count)])
        return out, np.diff(upto[np.searchsorted(start, offsets)])

    def word(self, word: str) -> list[int]:
        """A word with its spaces; U+2581 in it goes by its bytes, and parts the word as a space does."""
        if SPACE not in word:
            return self.pieces.fold(word.replace(" ", SPACE))
        out: list[int] = []
        for k, part in enumerate(word.split(SPACE)):
            out += self.pieces.spell(SPACE) if k else []
            out += self.pieces.fold(part.replace(" ", SPACE)) if part else []
        return out


def encode(docs: DataFrame, path: str = "piece_bpe_32k.model", bound: int = DICTIONARY) -> DataFrame:
    """(doc_id, ids): every document's ids as little-endian unsigned 32-bit integers.

    ``docs`` has doc_id and text; further columns are ignored, rows without a
    doc_id dropped.  A null or empty text has no ids.  Repeated rows are encoded
    each, very long texts whole; an empty table gives an empty result.  White space other than U+0020 is no word end; it has its own bytes.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.sparkSession.sparkContext.broadcast(dictionary(docs, model(path), bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(model(path), known.value)
        for batch in batches:
            own = batch.column(0)
            for lo, hi, data, offsets in K.slices(batch):
                yield pa.RecordBatch.from_arrays([own.slice(lo, hi - lo), pa.array(_split(*coder.texts(data, offsets)), pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def _split(ids: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Each text's ids as little-endian bytes."""
    raw, upto = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(count)]) * 4
    return [raw[a:b] for a, b in zip(upto, upto[1:])]


class Decoder:
    """Texts of ids: each id's bytes, one after another, whether it is a piece or a byte."""

    def __init__(self, pieces: Model):
        raw = [bytes([pieces.byte_of[i]]) if i in pieces.byte_of else t.replace(SPACE, " ").encode("utf-8") for i, t in enumerate(pieces.texts)]
        self.length = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def raw(self, ids: np.ndarray, count: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of several texts' ids, and where each text's begin (one longer)."""
        length = self.length[ids]
        upto = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(count)])]
        return self.flat[K.ragged(self.start[ids], length)].tobytes(), upto

    def text(self, raw: bytes | pa.Buffer) -> str:
        """One text, without the space that was put before it."""
        ids = np.frombuffer(raw, "<u4")
        return self.raw(ids, np.array([len(ids)]))[0].decode("utf-8", "replace")[1:]


def decode(encoded: DataFrame, path: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids, text): the texts that ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(model(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [back.text(raw.as_buffer()) for raw in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def encoded_documents(docs: DataFrame, path: str = "piece_bpe_32k.model", bound: int = DICTIONARY) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256): encoded, decoded again, and digested in one task.

    Rows as in ``encode``; without any the digests are those of nothing.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.sparkSession.sparkContext.broadcast(dictionary(docs, model(path), bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, back = Encoder(model(path), known.value), Decoder(model(path))
        for batch in batches:
            own = batch.column(0)
            for lo, hi, data, offsets in K.slices(batch):
                ids, count = coder.texts(data, offsets)
                text, upto = back.raw(ids, count)
                rows = [own.slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array([zlib.crc32(r) for r in _split(ids, count)], pa.int64())]
                # Without the space that was put before each text.
                rows.append(pa.array([hashlib.sha256(text[a + 1 : b]).hexdigest() for a, b in zip(upto, upto[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")
