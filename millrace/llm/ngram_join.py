"""N-gram Jaccard join by count vectors in an R-tree.

A document is the set of its distinct word n-grams.  Hashed into groups, the set
becomes a point whose coordinates count the n-grams of each group, and the summed
coordinate minima of two points bound the overlap of the two sets from above.

1. *Cells.*  Two sets whose Jaccard similarity reaches the threshold differ in at
   most D n-grams.  In a grid of more than D groups some group is therefore equal
   in both, so documents meet in a cell (grid, group, content of the group).  The
   sizes are cut into bands, and a document uses the grids of its own band and of
   the one below, which together serve all sizes that can match.  Groups with few
   n-grams say little: a set sends the cells of at least so many n-grams as still leave
   more groups than can differ.  Sets for which there is no such number meet by a prefix
   of their hashes instead, which is as complete.  Equal cells, and equal sets, are collapsed in each task before the
   shuffle, so a hot cell sends one row a task.
2. *Stars.*  A cell is named by its least document, its leader; all cells of one leader
   are one star, to which each member's set goes once, however many cells they share.
   Any two documents that share a cell are in one star.
3. *R-tree.*  In a star an R-tree is packed over the members' count vectors.  Nodes and
   points whose bound is below the overlap that is needed are dropped, points that are
   left are bounded once more by finer counts, and the sets of the surviving pairs are
   intersected, the likeliest first; documents that are connected by then need no
   further proof.  All links but those of equal sets come from here.
4. *Large stars.*  A star that weighs more than ``weight`` is dealt into blocks, each with
   the leader, which are searched like stars.  What then belongs to the star's largest
   component is connected; only the rest is searched again against all blocks.

No pair at or above the threshold is lost: it shares a cell, and so a star, where it
is linked, already connected, or bounded out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .store import cut, discard, only, partitions

U64 = np.uint64
#: Groups of a count vector in the R-tree, and finer groups that each of them is made of.
GROUPS, FINER = 64, 8
#: Points of a leaf of the R-tree.
LEAF = 32
#: N-grams of the sets that a task holds of a star, each set counting POINT more for its vectors.
WEIGHT, POINT = 1 << 22, 256
#: The most n-grams that a cell is asked to have.
HEAVY = 8
#: Keys that a scanning task holds before it sends them.
HELD = 1 << 19
#: Rows (16 bytes each) of documents and their stars that are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000


def shingles(data: np.ndarray, offsets: np.ndarray, width: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each document, keyed, ascending, and where each document's begin (one longer)."""
    start, end, first = K.words(data, offsets)
    word = K.word_hashes(K.FOLD[data], start, end, key)
    count = np.diff(first)
    grams = K.chained(word, width, key)
    pieces = []
    for d in range(len(count)):
        s, n = int(first[d]), int(count[d])
        if n >= width:
            pieces.append(np.unique(grams[s : s + n - width + 1]))
        elif n:
            pieces.append(K.mix(K.chained(word[s : s + n], n, key), n))
        else:
            pieces.append(np.zeros(0, U64))
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=at[1:])
    return (np.concatenate(pieces) if pieces else np.zeros(0, U64)), at


def bands(percent: int, largest: int) -> np.ndarray:
    """Upper ends of the size bands; a set can match only sets of its own band or a neighbouring one."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    return np.array(ends, np.int64)


def _sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, heads) if len(heads) else np.zeros(0, U64)


def cells(sets: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell keys of all sets, and the index of the set that each belongs to."""
    size = np.diff(at)
    if not len(sets):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    ends = bands(percent, int(size.max()))
    band = np.searchsorted(ends, size)
    inner = K.mix(sets, 5)
    keys, owners = [], []
    for shift in (0, 1):
        grid = band - shift
        live = (size > 0) & (grid >= 0)
        top = ends[np.maximum(grid, 0)]
        differ = top * (100 - percent) // percent
        groups = differ + 3 + differ // 7
        doc = np.flatnonzero(live)
        index = K.ragged(at[doc], size[doc])
        owner = np.repeat(doc, size[doc])
        group = ((sets[index] >> U64(32)) * groups[owner].astype(U64)) >> U64(32)
        heads = _runs(owner, group)
        of, held = owner[heads], np.diff(np.append(heads, len(owner)))
        content = _sums(inner[index], heads)
        key = K.mix(content ^ K.mix(group[heads], 1) ^ K.mix(grid[of].astype(U64), 2), 3)
        # Of two similar sets the one with the larger least number shares a cell of that many with the other.
        least = np.zeros(len(size), np.int64)
        for m in range(1, HEAVY + 1):
            enough = np.bincount(of[held >= m], minlength=len(size)) > differ
            least[live & enough] = m
        sends = (least[of] > 0) & (held >= least[of])
        keys.append(key[sends])
        owners.append(of[sends])
        sparse = np.flatnonzero(live & (least == 0))
        prefix = size[sparse] - (size[sparse] * percent + 99) // 100 + 1
        index = K.ragged(at[sparse], prefix)
        of = np.repeat(sparse, prefix)
        keys.append(K.mix(sets[index] ^ K.mix(grid[of].astype(U64), 4), 6))
        owners.append(of)
    return np.concatenate(keys), np.concatenate(owners)


def vectors(sets: np.ndarray, at: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The count vector of each set."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(owner * groups + (K.mix(sets, 9) % U64(groups)).astype(np.int64), minlength=n * groups).reshape(n, groups).astype(np.int32)


#: What goes through the shuffle: packed numbers, by kind.
_BLOBS = "kind string, bucket int, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), *((k, pa.binary()) for k in "abcd")])


def _blob(kind: str, bucket: int, *arrays: np.ndarray) -> dict:
    return {"kind": kind, "bucket": bucket, **{k: arrays[i].tobytes() if i < len(arrays) else None for i, k in enumerate("abcd")}}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _meet(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of cells' keys and members: each key once with its least member; then (key, leader, member) of shared cells."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    heads = _runs(key)
    size = np.diff(np.r_[heads, len(key)])
    lead = np.repeat(doc[heads], size)
    shared = np.repeat(size > 1, size) & (doc != lead)
    return key[heads], doc[heads], key[shared], lead[shared], doc[shared]


def _named(key: np.ndarray, buckets: int) -> np.ndarray:
    """A cell's name: its bucket, and 32 bits of its key."""
    return (key & U64(0xFFFFFFFF)) | ((key >> U64(32)) * U64(buckets) >> U64(32)) << U64(32)


def _scan(width: int, percent: int, buckets: int, hashed: int):
    """Kind ``s``: ids, sizes and fingerprints of sets.  ``m``: members met within the task.  ``k``: keys with their least members.

    A key's upper bits choose its bucket and 32 others go on: keys that collide make
    documents meet for nothing, and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        known: set[tuple[int, int]] = set()
        count = turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            key, doc, *met = _meet(np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held]))
            if len(met[0]):
                yield _batch([_blob("m", turn % buckets, _named(met[0], buckets), *met[1:])])
                turn += 1
            bucket = (key >> U64(32)) * U64(buckets) >> U64(32)
            low = (key & U64(0xFFFFFFFF)).astype(np.uint32)
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edge)).tolist():
                own, at = np.unique(doc[edge[b] : edge[b + 1]], return_inverse=True)
                rows.append(_blob("k", b, low[edge[b] : edge[b + 1]], at.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32), own))
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            held.clear()
            known.clear()

        for batch in batches:
            ids = K.int_column(batch, "doc_id")
            for lo, hi, data, offsets in K.slices(batch):
                sets, at = shingles(data, offsets, width, hashed)
                size, own = np.diff(at), ids[lo:hi]
                full = np.flatnonzero(size)
                one, two = np.zeros(hi - lo, U64), np.zeros(hi - lo, U64)
                one[full] = _sums(K.mix(sets, 11), at[full])
                two[full] = _sums(K.mix(sets, 12), at[full])
                yield _batch([_blob("s", turn % buckets, own, size, one, two)])
                turn += 1
                new = np.zeros(hi - lo, bool)
                for d in full:
                    if (mark := (int(one[d]), int(two[d]))) not in known:
                        known.add(mark)
                        new[d] = True
                # Of equal sets one goes on; the others follow it by their fingerprints.
                length = np.where(new, size, 0)
                sub = np.zeros(len(length) + 1, np.int64)
                np.cumsum(length, out=sub[1:])
                keys, owner = cells(sets[np.repeat(new, size)], sub, percent)
                held.append((keys, own[owner]))
                count += len(keys)
                if count >= HELD:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, x, y, z, w).  ``s``: id, size, fingerprints; ``m``: cell, leader, member within a task; ``l``: cell, leader of a cell of several tasks; ``p``: member, leader of these."""

    def rows(kind: str, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        full = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns] + [pa.nulls(n, pa.int64())] * (4 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array([kind] * n), *full], ["kind", "x", "y", "z", "w"])

    keys, docs = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == "k":
                own = np.frombuffer(row["c"], np.int64)
                key = np.frombuffer(row["a"], np.uint32)
                at = np.frombuffer(row["b"], np.uint16 if len(own) <= 1 << 16 else np.uint32)
                # The bucket above the 32 bits: a cell's name here and in the tasks that met it.
                keys.append(key.astype(U64) | U64(row["bucket"]) << U64(32))
                docs.append(own[at])
            elif row["kind"] == "m":
                yield rows("m", *(np.frombuffer(row[k], np.int64) for k in "abc"))
            else:
                yield rows("s", *(np.frombuffer(row[k], np.int64) for k in "abcd"))
    if keys:
        _, _, cell, lead, member = _meet(np.concatenate(keys), np.concatenate(docs))
        if len(cell):
            heads = _runs(cell)
            yield rows("l", cell[heads], lead[heads])
            both = np.unique(np.stack([member, lead], 1), axis=0)
            yield rows("p", both[:, 0], both[:, 1])


def _sets(texts: pa.Array, width: int, hashed: int) -> tuple[np.ndarray, np.ndarray]:
    parts, ends = [], [0]
    for _, _, data, offsets in K.slices(pa.RecordBatch.from_arrays([texts], ["text"])):
        sets, at = shingles(data, offsets, width, hashed)
        parts.append(sets)
        ends += list(at[1:] + ends[-1])
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.array(ends, np.int64)


def _encoded(width: int, hashed: int):
    """(stars, id, set) of (stars, id, text): the sets as packed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets, at = _sets(part.column(2), width, hashed)
                raw = [sets[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["stars", "id", "grams"])

    return run


class Tree:
    """An R-tree over count vectors, packed by halving along the widest coordinate; each node has its corners."""

    def __init__(self, points: np.ndarray):
        parts, leaves = [np.arange(len(points))], []
        while parts:
            part = parts.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            axis = int(np.argmax(points[part].max(0) - points[part].min(0)))
            part = part[np.argsort(points[part, axis], kind="stable")]
            half = len(part) // 2
            parts += [part[half:], part[:half]]
        self.points, self.leaves = points, leaves
        heads = np.cumsum([0] + [len(x) for x in leaves])[:-1]
        ordered = points[np.concatenate(leaves)]
        self.low, self.high = [np.minimum.reduceat(ordered, heads)], [np.maximum.reduceat(ordered, heads)]
        while len(self.low[-1]) > 8:
            step = np.arange(0, len(self.low[-1]), 8)
            self.low.append(np.minimum.reduceat(self.low[-1], step))
            self.high.append(np.maximum.reduceat(self.high[-1], step))

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Points whose summed coordinate minima with the query leave the threshold in reach."""
        total = int(query.sum())
        nodes = np.arange(len(self.low[-1]))
        for level in range(len(self.low) - 1, -1, -1):
            best = np.minimum(query, self.high[level][nodes]).sum(1)
            nodes = nodes[best * (100 + percent) >= percent * (total + self.low[level][nodes].sum(1))]
            if level:
                nodes = (nodes[:, None] * 8 + np.arange(8)).ravel()
                nodes = nodes[nodes < len(self.low[level - 1])]
        if not len(nodes):
            return np.zeros(0, np.int64)
        found = np.concatenate([self.leaves[n] for n in nodes])
        points = self.points[found]
        return found[np.minimum(query, points).sum(1) * (100 + percent) >= percent * (total + points.sum(1))]


def _linked(ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray, base: np.ndarray, asked: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that tie all components which the threshold ties, between documents of ``asked`` and of ``base``.

    ``label`` numbers the components that are known; it is changed.
    """
    if not len(base) or not len(asked):
        return []
    size = np.array([len(s) for s in sets])
    at = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    fine = vectors(np.concatenate(sets), at, GROUPS * FINER)
    # A fine group's number modulo GROUPS is the group that it is part of.
    points = fine.reshape(len(sets), FINER, GROUPS).sum(1, dtype=np.int32)
    fine = fine.astype(np.min_scalar_type(int(fine.max(initial=0))))
    grown, links = Tree(points[base]), []
    asks, found = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
    asks[asked], found[base] = True, True
    for q in asked.tolist():
        hits = base[grown.search(points[q], percent)]
        # Without what is connected, and what has asked for q itself before.
        hits = hits[(label[hits] != label[q]) & ~(found[q] & asks[hits] & (hits < q))]
        total = size[q] + size[hits]
        overlap = np.minimum(fine[q], fine[hits]).sum(1, dtype=np.int64)
        near = overlap / np.maximum(total, 1)
        some = overlap * (100 + percent) >= percent * total
        hits = hits[some][np.argsort(-near[some], kind="stable")]
        while len(hits):
            h, hits = hits[0], hits[1:]
            if len(np.intersect1d(sets[q], sets[h], assume_unique=True)) * (100 + percent) >= percent * (size[q] + size[h]):
                links.append((int(max(ids[q], ids[h])), int(min(ids[q], ids[h]))))
                label[label == label[h]] = label[q]
                hits = hits[label[hits] != label[q]]
    return links


def _search(percent: int):
    """Links of each group (star, left, right); rows (star, left, right, id, role, label, grams) come sorted by these.

    Roles: 1 to be found, 2 to ask, 3 both.
    """

    def join(rows: list[tuple]) -> list[tuple[int, int]]:
        unique = {r[3]: r for r in rows}  # a large star's leader comes with every block, and with its own twice
        if len(unique) < 2:
            return []
        rows = [unique[i] for i in sorted(unique)]
        ids, role = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        label = np.unique([r[5] for r in rows], return_inverse=True)[1]
        sets = [np.frombuffer(r[6], U64) for r in rows]
        return _linked(ids, sets, label, np.flatnonzero(role & 1), np.flatnonzero(role & 2), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out += join(held)
                    held = []
                held.append(row)
            yield _links(out)
        if held:
            yield _links(join(held))

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _in_stars(docs: DataFrame, stars: DataFrame, width: int, bound: int, hashed: int) -> DataFrame:
    """(star, left, right, id, role, label, grams) for (star, left, right, id, role, label), with the documents' sets.

    Of rows that share an id the one with the largest text counts.
    """
    key = F.struct("star", "left", "right", "role", "label")
    of = stars.groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(key).alias("stars"))
    joined = docs.join(F.broadcast(of) if stars.count() <= bound else of, "doc_id").select("stars", F.col("doc_id").alias("id"), "text")
    sets = joined.mapInArrow(_encoded(width, hashed), "stars array<struct<star:bigint,left:int,right:int,role:int,label:bigint>>, id bigint, grams binary")
    return sets.select(F.explode("stars").alias("s"), "id", "grams").select("s.star", "s.left", "s.right", "id", "s.role", "s.label", "grams")


def _found(rows: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) of all groups."""
    dealt = rows.repartition(partitions(rows.sparkSession), "star", "left", "right").sortWithinPartitions("star", "left", "right")
    return dealt.mapInArrow(_search(percent), "a long, b long")


def ngram_jaccard_join(docs: DataFrame, width: int = 4, percent: int = 85, broadcast_ids: int = BROADCAST, weight: int = WEIGHT) -> DataFrame:
    """Near-duplicate groups: (doc_id, n_shingles, component_id) of every document.

    ``docs`` has doc_id and text; further columns are ignored, and a row without a
    doc_id is dropped.  Words are runs of characters other than white space (space,
    U+0009 to U+000D), A-Z lower-cased; the set holds the distinct ``width``-grams,
    or of fewer words the whole sequence.  Null, empty and blank texts have an empty
    set and stand alone.  Sets link when ``100 * intersection >= percent * union``.
    N-grams are compared by 64 bits of a hash whose key is drawn for each run.
    component_id is the least doc_id reachable by links.  Of rows that share a doc_id
    the one with the largest text counts.  A text may be as long as a row can be; its
    set must fit a task's memory.  An empty table gives an empty result.

    A star of s members that weighs k times ``weight`` sends its members once to the
    first search and, if u of them are outside its largest component then, about
    s * u / weight more rows to the second.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    n, hashed = 2 * partitions(spark), K.drawn()
    # By the bucket's number: its hash would put several buckets in one task.
    met = cut(docs.mapInArrow(_scan(width, percent, n, hashed), _BLOBS).repartitionById(n, F.col("bucket")).mapInArrow(_gather, "kind string, x long, y long, z long, w long"), "met")
    sets = met.where("kind = 's'").select(F.col("x").alias("doc_id"), F.col("y").alias("n_shingles"), F.col("z").alias("one"), F.col("w").alias("two"))

    same = sets.where("n_shingles > 0").groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    equal = sets.join(same, ["one", "two", "n_shingles"]).select(F.col("doc_id").alias("a"), "b").where("a <> b")

    # A cell of several tasks has one leader for all; within a task its members know that task's leader.
    heads = met.where("kind = 'l'").select(F.col("x").alias("cell"), F.col("y").alias("head"))
    inner = met.where("kind = 'm'").select(F.col("x").alias("cell"), F.col("y").alias("leader"), F.col("z").alias("id"))
    inner = inner.join(heads, "cell", "left").select("id", F.coalesce("head", "leader").alias("star"))
    pairs = inner.union(met.where("kind = 'p'").select("x", "y")).where("id <> star").distinct()
    pairs = pairs.union(pairs.select("star", "star").distinct())
    weighed = pairs.join(sets.select(F.col("doc_id").alias("id"), (F.col("n_shingles") + POINT).alias("weight")), "id")
    weighed = cut(weighed.select("star", "id", "weight"), "stars")
    blocks = weighed.groupBy("star").agg(F.ceil(F.sum("weight") / weight).cast("int").alias("blocks"))
    large = cut(blocks.where("blocks > 1"), "large")
    some = not large.isEmpty()
    members = weighed.join(large, "star", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) if some else weighed.withColumn("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # A large star's leader goes to every block.
    left = F.when(F.col("id") == F.col("star"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    first = members.select("star", F.explode(left).alias("left"), F.lit(0).alias("right"), "id", F.lit(3).alias("role"), F.col("id").alias("label"))
    links = cut(_found(_in_stars(docs, first, width, broadcast_ids, hashed), percent).union(equal), "links")
    groups = cut(components(links), "groups")

    if some:
        named = weighed.join(large, "star").join(groups, "id", "left").select("star", "id", "weight", "blocks", F.coalesce("component", "id").alias("label"))
        named = cut(named, "named")
        most = named.groupBy("star", "label").count().groupBy("star").agg(F.max(F.struct("count", "label"))["label"].alias("most"))
        rest = named.join(most, "star").where("label <> most").drop("most")
        turns = rest.groupBy("star").agg(F.ceil(F.sum("weight") / weight).cast("int").alias("turns"))
        asking = rest.join(turns, "star").withColumn("turn", F.pmod(F.xxhash64("id", F.lit(1)), F.col("turns")).cast("int"))
        asking = asking.select("star", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("left"), F.col("turn").alias("right"), "id", F.lit(2).alias("role"), "label")
        asked = named.join(turns, "star").select("star", own.alias("left"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("right"), "id", F.lit(1).alias("role"), "label")
        second = asking.union(asked).groupBy("star", "left", "right", "id", "label").agg(F.sum("role").cast("int").alias("role"))
        second = cut(second.select("star", "left", "right", "id", "role", "label"), "second")
        more = cut(links.union(_found(_in_stars(docs, second, width, broadcast_ids, hashed), percent)), "links")
        discard(links, named, second)
        links, first_groups = more, groups
        groups = cut(components(links), "groups")
        discard(first_groups)
    discard(weighed, large, links)
    return sets.select("doc_id", "n_shingles").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
