"""Packing paragraphs into chunks, token streams, and blocks and batches for training."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import VOCABULARY, BytePairTokens, sliced, tokenizer
from ..storage import stored

# Fixed value: where sentences end.
_SENTENCE_END = re.compile(r"[.!?](\s+)")


class WhitespaceTokens:
    """A counter without a vocabulary: a token is a run of other than white space."""

    ends_at_spaces = True
    #: What a blank line between two texts adds, and what texts begin with behind which it adds something else.
    blank_line, added = 0, ()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(t.split()) for t in texts]

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)


def check_sizes(size: int, overlap: int, least: int) -> None:
    if size <= 0:
        raise ValueError(f"a chunk must hold at least one token, not {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"an overlap of {overlap} doesn't fit chunks of {size}")
    if not 0 <= least <= size:
        raise ValueError(f"a least size of {least} doesn't fit chunks of {size}")


def _sentences(paragraph: str) -> list[str]:
    """What is between the white space after sentences' ends, which a pattern finds sooner than the white space behind one."""
    at, out = 0, []
    for end in _SENTENCE_END.finditer(paragraph):
        out.append(paragraph[at : end.start(1)])
        at = end.end()
    return [*out, paragraph[at:]]


def _joined_sizes(sentences: list[str], coder) -> list[int] | None:
    """Each sentence's tokens behind a space, if a coder's tokens never reach over a space that another sentence begins with."""
    return coder.counts([f" {x}" for x in sentences]) if getattr(coder, "ends_at_spaces", False) else None


def _fit(paragraph: str, size: int, coder, count: Callable[[str], int]) -> Iterator[tuple[str, int]]:
    """A paragraph in pieces of at most ``size`` tokens: whole, by sentences, or cut between tokens.

    Where sentences are joined by a space each, their tokens add up to the paragraph's, so
    a text is encoded once; alone only the sentences that open a piece are.
    """
    sentences = _sentences(paragraph)
    sizes = _joined_sizes(sentences, coder)
    n = count(sentences[0]) + sum(sizes[1:]) if sizes and all(sentences) and " ".join(sentences) == paragraph else count(paragraph)
    if n <= size:
        yield paragraph, n
        return
    packed: list[tuple[str, int]] = []
    for k, sentence in enumerate(sentences):
        before, held = packed[-1] if packed else ("", 0)
        if not before:
            packed[-1:] = [(sentence, count(sentence))]
            continue
        longer = f"{before} {sentence}".strip()
        grown = (held + sizes[k] if sentence else held) if sizes else count(longer)
        if grown <= size:
            packed[-1] = (longer, grown)
        else:
            packed.append((sentence, count(sentence)))
    for piece, n in packed:
        if not piece:
            continue
        if n <= size:
            yield piece, n
            continue
        ids = coder.encode(piece)
        yield from ((c, count(c)) for c in (coder.decode(ids[i : i + size]) for i in range(0, len(ids), size)))


def pack(text: str, size: int = 512, overlap: int = 50, least: int = 64, coder=None) -> list[tuple[str, int]]:
    """(chunk, tokens).  A full chunk's last paragraphs, up to ``overlap`` tokens, open the next; a small last one joins the one before."""
    check_sizes(size, overlap, least)
    coder = coder or WhitespaceTokens()
    known: dict[str, int] = {}

    def count(part: str) -> int:
        if part not in known:
            known[part] = coder.counts([part])[0] if hasattr(coder, "counts") else len(coder.encode(part))
        return known[part]

    parts = [x for p in text.split("\n\n") if p.strip() for x in _fit(p.strip(), size, coder, count)]
    known |= dict(parts)
    chunks: list[list[tuple[str, int]]] = [[]]
    held = 0
    for part in parts:
        if chunks[-1] and held + part[1] > size:
            carried, budget = [], overlap
            for p in reversed("\n\n".join(t for t, _ in chunks[-1]).split("\n\n") if overlap else ()):
                budget -= count(p)
                if budget < 0:
                    break
                carried.insert(0, (p, count(p)))
            chunks.append(carried)
            held = sum(n for _, n in carried)
        chunks[-1].append(part)
        held += part[1]
    out = [("\n\n".join(t for t, _ in c), sum(n for _, n in c)) for c in chunks if c]
    if len(out) > 1 and out[-1][1] < least:
        (a, m), (b, n) = out[-2:]
        out[-2:] = [(f"{a}\n\n{b}", m + n)]
    return out


def chunk(docs: DataFrame, key: str = "doc_id", size: int = 512, overlap: int = 50, least: int = 64, make_coder: Callable = BytePairTokens) -> DataFrame:
    """(key, chunk_no, text, token_count) of each document, in tokens of the coder; documents are packed apart, so they spread over tasks."""
    check_sizes(size, overlap, least)
    kind = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = make_coder()
        for part in parts:
            rows = [(k, i, t.strip(), n) for k, text in zip(part[key], part["text"]) if text for i, (t, n) in enumerate(pack(text, size, overlap, least, coder)) if t.strip()]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "text", "token_count"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, chunk_no int, text string, token_count int")


def _joined_size(text: str, parts: int | None, coder) -> int | None:
    """The tokens of parts joined by blank lines, if a blank line adds the same behind and before each of them."""
    blank_line = getattr(coder, "blank_line", None)
    if blank_line is None or parts is None:
        return None
    some = text.split("\n\n")
    if not all(some) or any(t[0].isspace() or t[-1].isspace() for t in some) or any(t.startswith(coder.added) for t in some):
        return None
    return parts + blank_line * (len(some) - 1)


def coded_sizes(texts: DataFrame, make_coder: Callable = BytePairTokens) -> DataFrame:
    """(n): the tokens of each ``text``; ``parts``, where it is there and not null, sums those of its parts, so that the text isn't encoded again."""
    parts = F.col("parts") if "parts" in texts.columns else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make_coder()
        for batch in batches:
            some = batch.column(0).to_pylist()
            sums = [_joined_size(t, n, coder) for t, n in zip(some, batch.column(1).to_pylist())]
            rest = [t for t, n in zip(some, sums) if n is None]
            counts = iter(coder.counts(rest) if hasattr(coder, "counts") else [len(coder.encode(t)) for t in rest])
            yield pa.RecordBatch.from_arrays([pa.array([next(counts) if n is None else n for n in sums], pa.int64())], ["n"])

    return texts.select("text", parts.alias("parts")).mapInArrow(run, "n long")


def token_blocks(tokens: DataFrame, block: int, scope: list[str]) -> DataFrame:
    """(scope, pos, x, y): all windows of ``block`` tokens and the same shifted by one, of (scope, pos, tok) rows."""
    if block <= 0:
        raise ValueError("block must be positive")
    w = Window.partitionBy(*scope).orderBy("pos")
    out = tokens.withColumn("x", F.collect_list("tok").over(w.rowsBetween(0, block - 1))).withColumn("y", F.collect_list("tok").over(w.rowsBetween(1, block)))
    return out.where(F.size("y") == block).select(*scope, "pos", "x", "y")


#: What the tokenizer's pattern takes for white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_IDS = pa.list_(pa.int32())


def _coded(path: str):
    """(part, number, n, ids, head, white) of a range's texts, cut before runs of white space.

    The first text that isn't blank stays uncoded as ``head``, with what is before it, as
    more may come from ranges before; ``white`` is the white space after the last one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number, white = tokenizer(path), TaskContext.get().partitionId(), 0, None
        for some in (s for batch in batches for s in sliced(batch.column(0).to_pylist())):
            heads, rest = [], []
            for text in some:
                core = text.rstrip(WHITE)
                white = (white or "") + "\n"
                if core:
                    (rest if number + len(heads) else heads).append(white + core)
                    white = ""
                white += text[len(core) :]
            ids = [None] * len(heads) + [e.ids for e in coder.encode_batch_fast(rest, add_special_tokens=False)]
            numbers = range(number, number + len(ids))
            number += len(ids)
            columns = [pa.array([part] * len(ids), pa.int32()), pa.array(numbers, pa.int64()), pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(ids, _IDS), pa.array(heads + [None] * len(rest), pa.string()), pa.nulls(len(ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "number", "n", "ids", "head", "white"])
        if white is not None:
            columns = [pa.array([part], pa.int32()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), _IDS, pa.string())), pa.array([white], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "number", "n", "ids", "head", "white"])

    return run


def _heads(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            ids = [e.ids for some in sliced(batch.column(2).to_pylist()) for e in coder.encode_batch_fast(some, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, _IDS)], ["part", "number", "n", "ids"])

    return run


def token_stream(texts: DataFrame, order: list[str], path: str = VOCABULARY) -> DataFrame:
    """(part, number, start, ids): the tokens of all texts, joined by line feeds in ``order``, as pieces of one stream.

    The pieces' ids are those of the joined text.  Its tokens never reach from other signs
    into white space, so it is cut there: white space around a join, over blank texts
    and ranges too, goes with the text after it.  Texts go to ranges of the order; each
    leaves its first piece open until the white space before it is known, a row a range.
    A piece's start is the sum of the counts before it, of which the driver holds one a
    range.  Null texts are passed over.
    """
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts.where("text is not null").repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    coded = stored(ranged.select("text").mapInArrow(_coded(path), "part int, number long, n long, ids array<int>, head string, white string"), "tokens")
    # A row a range: the white space after a range's last text goes before the next head, wherever that is.
    edges = coded.where("head is not null or white is not null").groupBy("part").agg(F.max("head").alias("head"), F.max("white").alias("white"))
    edges = edges.withColumn("k", F.count("head").over(Window.orderBy("part")))
    before = edges.groupBy((F.col("k") + 1).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "white"))), lambda e: e["white"]), "").alias("before"), F.max("part").alias("last"))
    opened = before.join(edges.where("head is not null").select("part", "head", "k"), "k", "full")
    text = F.concat(F.coalesce("before", F.lit("")), F.coalesce("head", F.lit("")))
    # The stream opens without a line feed; white space that nothing follows ends it, as a piece of its own.
    opened = opened.select(F.coalesce("part", F.col("last") + 1).alias("part"), F.lit(0).cast("long").alias("number"), F.when(F.min("k").over(Window.partitionBy()) == F.col("k"), F.substr(text, F.lit(2))).otherwise(text).alias("text"))
    heads = stored(opened.where("text <> ''").mapInArrow(_heads(path), "part int, number long, n long, ids array<int>"), "heads")
    pieces = coded.where("ids is not null").select("part", "number", "n", "ids").union(heads)
    base, total = [], 0
    for r in pieces.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        base.append((r["part"], total))
        total += r["n"]
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    start = F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.withColumn("start", F.coalesce(start, F.lit(0))).join(bases, "part")
    return placed.select("part", "number", (F.col("base") + F.col("start")).alias("start"), "ids")


def stream_blocks(stream: DataFrame, block: int, segment: int = 4096) -> DataFrame:
    """(pos, x, y): all windows of ``block`` tokens of one stream, and the same shifted by one; N - block of them.

    ``stream`` has (start, ids).  Pieces are cut into segments of ``segment`` positions, what is
    near a segment's start goes to the one before as well, so no row holds more than a
    segment and a block.  A stream of ``block`` tokens or fewer raises.
    """
    if block <= 0:
        raise ValueError("a block must hold at least one token")
    total = stream.agg(F.coalesce(F.max(F.col("start") + F.size("ids")), F.lit(0)).alias("n")).first()["n"]
    if total <= block:
        raise ValueError(f"{total} tokens are too few for blocks of {block}")
    # From the earliest segment that a piece's first token is still read by: one begins at most ``block`` before it.
    earliest, own = F.floor(F.greatest(F.col("start") - block, F.lit(0)) / segment), F.floor((F.col("start") + F.size("ids") - 1) / segment)
    dealt = stream.where(F.size("ids") > 0).select("start", "ids", F.explode(F.sequence(earliest, own)).alias("segment"))
    first = F.greatest(F.col("segment") * segment - F.col("start"), F.lit(0)).cast("int")
    last = F.least((F.col("segment") + 1) * segment + block - F.col("start"), F.size("ids").cast("long")).cast("int")
    parts = dealt.select("segment", F.struct((F.col("start") + first).alias("at"), F.slice("ids", first + 1, last - first).alias("ids")).alias("part"))
    lists = parts.groupBy("segment").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("t"))
    some = F.least(F.lit(segment), F.lit(total - block) - F.col("segment") * segment)
    blocks = lists.where(some > 0).select("segment", "t", F.explode(F.sequence(F.lit(0), (some - 1).cast("int"))).alias("i"))
    return blocks.select((F.col("segment") * segment + F.col("i")).alias("pos"), F.slice("t", F.col("i") + 1, block).alias("x"), F.slice("t", F.col("i") + 2, block).alias("y"))


def batches(df: DataFrame, key: list[str], size: int, seed: int = 0) -> DataFrame:
    """``df`` with batch_no: rows in an order drawn by ``seed``, in batches of ``size``, the last part dropped.

    Ranks are found without one sort over everything: rows fall into ranges of their
    hash, and each range starts where the ones before it end.
    """
    draw = F.xxhash64(F.lit(seed), *key)
    rows = df.withColumn("_draw", draw).withColumn("_range", F.shiftright(F.col("_draw"), 54))
    counts = rows.groupBy("_range").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = counts.agg(F.sum("count").alias("_total"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy("_draw", *key)))
    # 1,024 ranges at most: their counts are broadcast.
    rows = rows.join(F.broadcast(before.drop("count")), "_range").join(F.broadcast(total))
    rows = rows.withColumn("batch_no", F.floor((F.col("_before") + F.col("_n") - 1) / size))
    return rows.where((F.col("batch_no") + 1) * size <= F.col("_total")).drop("_draw", "_range", "_n", "_before", "_total")
