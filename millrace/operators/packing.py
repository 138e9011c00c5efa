"""Packing a whole corpus, as one text, into chunks: the same chunks as one pass makes, whatever the partitions.

A chunk opens with what the one before carries over, and where the next one opens follows
from where it opens itself: each part (a paragraph, or a piece of a long one) points to
the first part after the chunk that it would be the first new one of.  Parts go to ranges
of SPAN tokens with the few of their neighbours that these pointers need.  Within a range
pointers are followed by doubling, which leaves for each part that can open a chunk there
the part that opens one in a later range, and the chunks between.  Ranges are joined by
doubling too, so the opening part and the number of chunks before are known for each
range after a logarithmic number of small joins, and every range cuts its own chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.tokens import BytePairTokens
from ..storage import stored
from .chunking import _fit, check_sizes
from .ranks import ranked

#: Tokens of a range at least; a task holds the texts of one range.
SPAN = 1 << 20
#: Texts that are cut into pieces at once.
ROWS = 256


def parts(paragraphs: DataFrame, order: list[str], size: int, make_coder: Callable = BytePairTokens) -> DataFrame:
    """(order, piece_no, text, n) of (order, text): blank paragraphs go, those of more than ``size`` tokens are split."""
    schema = S.StructType([*(paragraphs.schema[c] for c in order), S.StructField("piece_no", S.IntegerType()), S.StructField("text", S.StringType()), S.StructField("n", S.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = make_coder()
        count = (lambda t: coder.counts([t])[0]) if hasattr(coder, "counts") else (lambda t: len(coder.encode(t)))
        # In small frames, as a batch's rows, pieces and columns are all held at once.
        for frame in (f.iloc[i : i + ROWS] for f in frames for i in range(0, len(f), ROWS)):
            rows = []
            for *key, text in frame.itertuples(index=False, name=None):
                if text and text.strip():
                    rows += [(*key, i, t, n) for i, (t, n) in enumerate(_fit(text.strip(), size, coder, count))]
            yield pd.DataFrame(rows, columns=schema.names)

    return paragraphs.select(*order, "text").mapInPandas(run, schema)


class _Range:
    """A range's parts and their neighbours in order: where chunks open, what they hold, and where the next one opens."""

    def __init__(self, table: pa.Table, size: int, overlap: int, span: int):
        table = table.sort_by("_no")
        self.table = table
        self.no, at, n = (table.column(c).to_numpy() for c in ("_no", "_at", "n"))
        end = at + n
        self.low = int(table.column("range")[0].as_py()) * span
        here = np.arange(len(at))
        self.first = np.searchsorted(at, at - overlap) if overlap else here
        self.next = np.maximum(np.searchsorted(end, at[self.first] + size, "right"), here + 1)
        self.own = np.flatnonzero((at >= self.low) & (at < self.low + span))
        # Past what is here: the part that follows.
        self.at, self.end = np.append(at, end[-1]), end
        self.no = np.append(self.no, self.no[-1] + 1)

    def jumps(self, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(opening part, part that opens a chunk behind the range, chunks between) of parts that a chunk from before can lead to."""
        border = int(self.own[-1]) + 1
        to, count = np.append(self.next, len(self.next)), np.ones(len(self.next) + 1, np.int64)
        while len(inside := self.own[to[self.own] < border]):
            count[inside], to[inside] = count[inside] + count[to[inside]], to[to[inside]]
        some = self.own[self.at[self.own] - self.low <= reach]
        return some, to[some], count[some]


def _jumps(size: int, overlap: int, span: int, reach: int):
    def run(table: pa.Table) -> pa.Table:
        r = _Range(table, size, overlap, span)
        if not len(r.own):
            return _JUMPS.empty_table()
        x, y, n = r.jumps(reach)
        return pa.Table.from_arrays([pa.array(np.full(len(x), r.low // span)), pa.array(r.no[x]), pa.array(r.at[y] // span), pa.array(r.no[y]), pa.array(n)], schema=_JUMPS)

    return run


_JUMPS = pa.schema([(c, pa.int64()) for c in ("range", "x", "to_range", "y", "chunks")])
_CHUNKS = pa.schema([("chunk_no", pa.int64()), ("text", pa.string()), ("token_count", pa.int64())])


def _cut_up(size: int, overlap: int, span: int):
    def run(table: pa.Table) -> pa.Table:
        r = _Range(table, size, overlap, span)
        number, x = (table.column(c)[0].as_py() for c in ("before", "x"))
        texts, out = r.table.column("text").to_pylist(), []
        at, border = int(np.searchsorted(r.no, x)), int(r.own[-1]) + 1
        while at < border:
            first, after = int(r.first[at]), int(r.next[at])
            out.append((number, "\n\n".join(texts[first:after]), int(r.end[after - 1] - r.at[first])))
            number, at = number + 1, after
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CHUNKS)], schema=_CHUNKS)

    return run


def _openings(jumps: DataFrame, ranges: int) -> DataFrame:
    """(range, x, before): for each range the part that opens its first chunk, and the chunks before; jumps are doubled each round."""
    reached = jumps.where("range = 0 and x = 0").select("range", "x", F.lit(0).cast("long").alias("before"))
    step = 1
    while True:
        ends = reached.join(jumps, ["range", "x"]).select(F.col("to_range").alias("range"), F.col("y").alias("x"), (F.col("before") + F.col("chunks")).alias("before"))
        reached = stored(reached.union(ends.where("x is not null")), "openings")
        step *= 2
        if step > ranges:
            return reached
        then = jumps.select(F.col("range").alias("to_range"), F.col("x").alias("y"), F.col("to_range").alias("then_range"), F.col("y").alias("then_y"), F.col("chunks").alias("more"))
        # Jumps that lead out of the text lead no further and go.
        jumps = stored(jumps.join(then, ["to_range", "y"]).select("range", "x", F.col("then_range").alias("to_range"), F.col("then_y").alias("y"), (F.col("chunks") + F.col("more")).alias("chunks")), "jumps")


def chunk_corpus(paragraphs: DataFrame, order: list[str], size: int = 512, overlap: int = 50, least: int = 64, make_coder: Callable = BytePairTokens, span: int = SPAN) -> DataFrame:
    """(chunk_no, text, token_count): the chunks that ``pack`` makes of all paragraphs joined by blank lines in ``order``.

    Paragraphs hold no line feeds, as cleaning leaves them, and ``order`` tells them
    apart.  ``token_count`` sums the parts' tokens.  No string is longer than a chunk, no
    task holds more than a range of ``span`` tokens and its neighbours' edges, and the
    result is the same for any number of partitions.  Without text there are no chunks.
    """
    check_sizes(size, overlap, least)
    # Ranges are sampled from what they deal out, so paragraphs are dealt before they are encoded and not after.
    n = int(paragraphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = parts(paragraphs.select(*order, "text").repartitionByRange(n, *order), order, size, make_coder)
    placed = ranked(pieces, [*order, "piece_no"], "n", "parts", ranged=True).select("_no", "_at", "n", "text")
    longest, total = placed.agg(F.max("n"), F.max(F.col("_at") + F.col("n"))).first()
    if longest is None:
        return paragraphs.sparkSession.createDataFrame([], "chunk_no long, text string, token_count long")
    reach = max(size, longest)
    span = max(span, 2 * reach, 2 * overlap)
    own = F.floor(F.col("_at") / span)
    ranges = F.array_compact(F.array(own, F.when((F.col("_at") - own * span <= 2 * reach) & (own > 0), own - 1), F.when((own + 1) * span - F.col("_at") <= overlap, own + 1)))
    dealt = placed.withColumn("range", F.explode(ranges))
    jumps = stored(dealt.drop("text").groupBy("range").applyInArrow(_jumps(size, overlap, span, reach), "range long, x long, to_range long, y long, chunks long"), "jumps")
    opened = _openings(jumps, total // span + 1)
    # One row a range.
    opened = opened.join(jumps.select("range", "x"), ["range", "x"], "left_semi")
    chunks = dealt.join(opened, "range").groupBy("range").applyInArrow(_cut_up(size, overlap, span), "chunk_no long, text string, token_count long")
    chunks = stored(chunks, "chunks")
    last = chunks.orderBy(F.desc("chunk_no")).select("chunk_no", "token_count").first()
    if last["chunk_no"] == 0 or last["token_count"] >= least:
        return chunks
    tail = chunks.where(F.col("chunk_no") >= last["chunk_no"] - 1)
    joined = tail.agg(F.min("chunk_no").alias("chunk_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda c: c["text"]), "\n\n").alias("text"), F.sum("token_count").alias("token_count"))
    return chunks.where(F.col("chunk_no") < last["chunk_no"] - 1).union(joined)
