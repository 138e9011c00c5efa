"""Repair of conversations' structure by a min-plus scan of matrices.

What precedes a turn is one of four states: nothing, a system turn, a user's, an
assistant's.  A turn is a 4 x 4 matrix: the cheapest edits, as (cost, audit), that lead
from one state to another over that turn, with any insertions before and after it (the
closure).  Products take the least cost and, of equal ones, the ASCII-least audit; they
are associative, so a conversation is reduced as a tree, within a task and, where ranges
of rows cut it, across tasks.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is
spread over tasks.  One that lies within a range and fits HELD is done there; what is cut
is a matrix for each range, reduced FAN at a time, and its text is hashed in a second
pass, in which a hash's bytes must follow one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, only, partitions

#: Costs of a new role, a deletion, an insertion, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Characters of one conversation that a task holds at most, and pieces that are reduced at once.
HELD, FAN = 1 << 23, 16
SPACES = " \t\n\x0b\x0c\r"
#: The state that a role's initial leads to, and the states that it may follow.
LEADS, FOLLOWS = {"s": 1, "u": 2, "a": 3}, {"s": (0,), "u": (0, 1, 3), "a": (2,)}
#: An entry of a matrix: cost and audit, or None where no edits lead.
Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product.

    Audits of one cost over the same turns are never each other's beginnings, as the rest
    would be insertions, which cost; so the least audit stays the least when both grow.
    """
    out = []
    for i in range(4):
        row = []
        for j in range(4):
            found = [(x[0] + y[0], k) for k in range(4) if (x := a[i][k]) and (y := b[k][j])]
            least = min(found, default=(0, 0))[0]
            row.append(min(((c, a[i][k][1] + b[k][j][1]) for c, k in found if c == least), default=None))
        out.append(tuple(row))
    return tuple(out)


def _matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(tuple(entries.get((i, j)) for j in range(4)) for i in range(4))


_ALTERNATE = {(i, LEADS[c]): c for c in "ua" for i in FOLLOWS[c]}
#: No turn: insertions alone, at most a user's and an assistant's.
CLOSURE = _matrix({(i, i): (0, "") for i in range(4)} | {k: (INSERT, "I") for k in _ALTERNATE} | {(i, 3): (2 * INSERT, "II") for i in (0, 1)})


@lru_cache(None)
def turn_matrix(initial: str, fault: str) -> Matrix:
    """A turn by its role's initial and its fault: b(lank), d(uplicate), t(runcated) or none."""
    edits = {(i, i): (DELETE, "D") for i in range(4)}
    if fault not in ("b", "d"):
        more = TRUNCATED if fault == "t" else 0
        staying = {k: (REROLE + more, "R") for k in _ALTERNATE}
        staying |= {(i, LEADS[initial]): (more, "K") for i in FOLLOWS.get(initial, ())}
        edits = {k: min(x for x in (edits.get(k), staying.get(k)) if x) for k in edits | staying}
    return times(times(CLOSURE, _matrix(edits)), CLOSURE)


def _product(turns: str) -> Matrix:
    """The product over turns, two signs each, as a tree."""
    if len(turns) == 2:
        return turn_matrix(turns[0], turns[1])
    half = len(turns) // 4 * 2
    return times(_reduced(turns[:half]), _reduced(turns[half:]))


_short = lru_cache(1 << 14)(_product)


def _reduced(turns: str) -> Matrix:
    """The same; short runs of turns are alike and are kept."""
    return _short(turns) if len(turns) <= 16 else _product(turns)


def reduced(turns: str) -> Matrix:
    return _reduced(turns) if turns else CLOSURE


def cheapest(m: Matrix) -> tuple[int, str]:
    """The cost and audit from nothing to nothing or to an assistant's turn."""
    return min(x for x in (m[0][0], m[0][3]) if x)


def repaired(audit: Iterable[str], turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of what the edits make of (role, text) turns."""
    state = 0
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        yield f"{role}:{text}"
        state = LEADS[role[0]]


class _Hash:
    """SHA-256 of lines, joined by line feeds, as they come."""

    def __init__(self):
        self.sha, self.lines = hashlib.sha256(), 0

    def add(self, line: str) -> None:
        self.sha.update(("\n" + line if self.lines else line).encode())
        self.lines += 1


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by their checksum, dropped ones marked; nulls of role and text are a space."""
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_by"))
    by = F.col("_by")
    text = F.when(by == 1, "").when(by == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(by == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (by == 0).alias("gone"), F.explode(F.when(by == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def _repeats(rows: DataFrame) -> DataFrame:
    """(conv_id, role, md5, none, least): texts that several turns of a conversation have in one role, and the first such turn."""
    keyed = rows.where("not gone").select("conv_id", "role", F.md5(F.col("text").cast("binary")).alias("md5"), "turn")
    sums = keyed.groupBy("conv_id", "role", "md5").agg(F.bool_or(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least"), F.max("turn").alias("_most"))
    return sums.where("(none and least is not null) or least < _most").drop("_most")


def _faulted(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: b, d where an earlier turn says the same, t, or '-'."""
    keyed = rows.withColumn("md5", F.md5(F.col("text").cast("binary"))).join(repeats, ["conv_id", "role", "md5"], "left")
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    seen = F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("least")))
    fault: Column = F.when(body == "", "b").when(F.coalesce(seen, F.lit(False)), "d").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    return keyed.select(*rows.columns, fault.alias("fault"))


#: Rows are ordered by these; of one turn by role and text.
ORDER = ("conv_id", "turn", "role", "text")
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
PIECES = "conv_id {kind}, piece long, open boolean, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, tail string, costs array<long>, audits array<string>, cost long, audit string, repaired_sha256 string"


class _Piece:
    """A conversation, or what a range has of it, as its rows come in order."""

    def __init__(self, conv):
        self.conv, self.kinds, self.matrix = conv, [], None
        self.count = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.head = self.tail = self.before = None
        self.rows, self.held, self.any = [], 0, False

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        now = (turn, role, text)
        if fault != "b" and now == self.before:
            fault = "d"
        self.before, initial = now, role[:1]
        for name, sign in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
            self.count[name] += fault == sign
        if self.any:
            self.count["illegal"] += _illegal(self.tail, initial)
        else:
            self.head = initial
        self.any, self.tail = True, initial
        if turn is not None and turn != self.high:
            self.count["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.kinds.append((initial if initial in LEADS else "?") + fault)
        if len(self.kinds) >= 4096:
            self.fold()
        if self.rows is not None:
            self.rows.append((role, text))
            self.held += len(role) + len(text) + 100
            if self.held > HELD:
                self.rows = None

    def fold(self) -> Matrix:
        m = reduced("".join(self.kinds))
        self.matrix, self.kinds = m if self.matrix is None else times(self.matrix, m), []
        return self.matrix

    def row(self, piece: int, cut_off: bool) -> tuple:
        m = self.fold()
        cut_off = cut_off or self.rows is None
        own = (self.conv, piece, cut_off, *self.count.values(), self.low, self.high, self.head, self.tail)
        if cut_off:
            return (*own, *_flat(m), None, None, None)
        cost, audit = cheapest(m)
        out = _Hash()
        for line in repaired(audit, iter(self.rows)):
            out.add(line)
        return (*own, None, None, cost, audit, out.sha.hexdigest())


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _flat(m: Matrix) -> tuple[list, list]:
    entries = [x for row in m for x in row]
    return [x and x[0] for x in entries], [x and x[1] for x in entries]


def _unflat(costs: list, audits: list) -> Matrix:
    entries = [None if a is None else (int(c), a) for c, a in zip(costs, audits)]
    return tuple(tuple(entries[4 * i : 4 * i + 4]) for i in range(4))


def _scanned(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, piece, first = TaskContext.get().partitionId(), None, True

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

        for batch in batches:
            done = []
            for conv, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        done.append(piece.row(number, first))
                        first = False
                    piece = _Piece(conv)
                if not gone:
                    piece.add(turn, role, text, fault)
            yield made(done)
        yield made([piece.row(number, True)] if piece is not None else [])

    return run


def _joined(schema: pa.Schema):
    """Up to FAN neighbouring pieces of a conversation as one."""

    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        out, m = None, None
        for r in sorted(pieces.to_pylist(), key=lambda r: r["piece"]):
            own = _unflat(r["costs"], r["audits"])
            if out is None:
                out, m = r, own
                continue
            m = times(m, own)
            if out["head"] is not None and r["head"] is not None:
                r["illegal"] += _illegal(out["tail"], r["head"])
            if out["high"] is not None and out["high"] == r["low"]:
                r["turns"] -= 1
            out |= {name: out[name] + r[name] for name in _COUNTS}
            out |= {name: r[name] for name in ("low", "head") if out[name] is None} | {name: r[name] for name in ("high", "tail") if r[name] is not None}
        out["costs"], out["audits"] = _flat(m)
        out["cost"], out["audit"] = cheapest(m)
        out["piece"] = key[1].as_py()
        return pa.Table.from_pylist([out], schema=schema)

    return run


def _hashed(schema: pa.Schema):
    """Of rows sorted by conversation, each one's audit before its turns: the hash of the repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        rows = turns()
        row = next(rows, None)
        while row is not None:
            conv, audit, out = row[0], row[1], _Hash()
            row = next(rows, None)

            def own() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row is not None and row[0] == conv:
                    now, row = row, next(rows, None)
                    yield now[3], now[4]

            left = own()
            for line in repaired(audit, left):
                out.add(line)
            for _ in left:
                pass
            yield pa.RecordBatch.from_arrays([pa.array([conv], schema[0].type), pa.array([out.sha.hexdigest()])], schema=schema)

    return run


def turn_repair(conversations: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation after damage.

    Null roles and texts are one space, null turns stand first and count for no gap.  Of
    one turn's rows that with the least role, then text, is first.  Rows without a
    conv_id go.  A conversation without rows after damage has zeros, an empty audit and
    the hash of nothing.  A role is known by its initial; one of another initial than s,
    u and a is reroled or deleted, and may be empty.
    """
    spark = conversations.sparkSession
    conversations = only(conversations, "conv_id", "turn", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    conversations = conversations.withColumn("turn", F.col("turn").cast("long"))
    rows, n = damaged(conversations), partitions(spark)
    repeats = cut(_repeats(rows), "repeats")
    faults = _faulted(rows, F.broadcast(repeats) if repeats.count() <= broadcast_rows else repeats)
    dealt = faults.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*ORDER)
    schema = PIECES.format(kind=kind)
    pieces = cut(dealt.mapInArrow(_scanned(_arrow(spark, schema)), schema), "pieces")
    open_, span = pieces.where("open"), 1
    while span < max(n, 2):  # once at least
        span *= FAN
        open_ = open_.groupBy("conv_id", F.floor(F.col("piece") / FAN).alias("node")).applyInArrow(_joined(_arrow(spark, schema)), schema)
    open_ = cut(open_, "open")
    ids = open_.select("conv_id")
    cut_rows = damaged(conversations).where("not gone").join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, "conv_id", "left_semi")
    nothing = F.lit(None).cast("string")
    heads = open_.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"))
    stream = heads.unionByName(cut_rows.select("conv_id", nothing.alias("audit"), "turn", "role", "text"))
    stream = stream.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER[1:])
    told = f"conv_id {kind}, repaired_sha256 string"
    hashes = stream.mapInArrow(_hashed(_arrow(spark, told)), told)
    every = pieces.where("not open").unionByName(open_.drop("repaired_sha256").join(hashes, "conv_id"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return every.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
