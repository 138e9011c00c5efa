"""Benchmark decontamination by SimHash windows, with DataFrame functions alone.

1. A document's word 5-grams are hashed.  Every item-sized window, wherever it begins,
   is a candidate if it holds as many of its item's 5-grams as the wanted similarity
   needs; a window with fewer cannot reach it, in whatever order its parts stand.
2. Each such window gets a SimHash of 64 bits over its weighted 5-grams,
   the weight being how often one occurs.
3. Multi-index Hamming blocks: the fingerprints of windows and items are cut into
   RADIUS + 1 blocks; within the radius at least one block is equal, so an equi-join
   on (size, block, value) finds every item of the window's size within it.  At a
   similarity of 0.8 bits differ with a chance of 0.15, and more than RADIUS of 64 in
   about one of a million windows, which are lost.  Blocks of two or three bits, as this
   radius needs, select little: it is the first step that keeps windows few.
4. Exact weighted similarity, the sum of least counts over the sum of largest ones,
   verifies what is left.

An item of fewer than five words has one gram, all of its words; a document has it
wherever these words stand in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, only

GRAM = 5
SIMILARITY = 0.8
RADIUS = 24
#: Rows of benchmark 5-grams, or ids of documents, that are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column, width: int = GRAM) -> Column:
    """Hashes of all runs of ``width`` words, or of all words if there are fewer; none without words."""
    # Element by element: a slice would copy the whole array each time.
    many = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    few = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(F.size(words) >= width, many).when(F.size(words) > 0, few).otherwise(F.array().cast("array<bigint>"))


def simhash(grams: Column) -> Column:
    """Bit b is set if more of the hashes, each as often as it occurs, have it set than not."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.when(F.aggregate(grams, F.lit(0), lambda s, g: s + F.getbit(g, b) * 2 - 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """The fingerprint's ``radius + 1`` blocks with their numbers."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    cut = [F.shiftrightunsigned(fingerprint, lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:])]
    return F.array(*(F.struct(F.lit(k).alias("block"), c.alias("value")) for k, c in enumerate(cut)))


def _sized(small: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(small) if small.count() <= bound else small


def _starts(hits: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, copy, item_id, row, n, start) of all windows with enough 5-grams of their item.

    A window of w grams and its item of n are similar only if they share at least
    similarity * (w + n) / (1 + similarity) grams, so as many places in the window
    are hits.  From each hit on, the window that holds that hit and the next ones it
    needs may begin anywhere between the last one's place - n + 1 and the hit.
    """
    found = hits.groupBy("doc_id", "copy", "item_id", "row", "n", "m").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # A little less, against rounding; the exact similarity decides.
    need = F.ceil((F.least("m", "n") + F.col("n")) * (similarity / (1 + similarity)) - 1e-6).cast("int")
    found = found.withColumn("need", F.greatest(F.lit(1), need)).where("size(at) >= need")
    first = F.explode(F.sequence(F.lit(0), F.size("at") - F.col("need"))).alias("i")
    found = found.select("doc_id", "copy", "item_id", "row", "n", "m", "need", "at", first)
    lo = F.greatest(F.lit(0), F.get("at", F.col("i") + F.col("need") - 1) - F.col("n") + 1)
    hi = F.least(F.get("at", F.col("i")), F.greatest(F.lit(0), F.col("m") - F.col("n")))
    found = found.select("doc_id", "copy", "item_id", "row", "n", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    return found.select("doc_id", "copy", "item_id", "row", "n", F.explode(F.sequence("lo", "hi")).alias("start")).distinct()


def _short(docs: DataFrame, items: DataFrame, bound: int) -> DataFrame:
    """(doc_id, copy, item_id, start, distance, similarity) of each place of items (item_id, w) with fewer than GRAM words."""
    texts = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("copy"), words(F.col("text")).alias("w"))
    out = None
    for r in items.select(F.size("w").alias("n")).distinct().collect():
        own = items.where(F.size("w") == r["n"]).select("item_id", grams(F.col("w"), r["n"])[0].alias("gram")).distinct()
        found = texts.where(F.size("w") >= r["n"]).select("doc_id", "copy", F.posexplode(grams(F.col("w"), r["n"])).alias("start", "gram")).join(_sized(own, bound), "gram")
        found = found.select("doc_id", "copy", "item_id", "start", F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"))
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, bound: int = BROADCAST) -> DataFrame:
    """(doc_id, item_id, similarity, distance, start, n_windows): every document and item with a window at the similarity.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; further columns are
    ignored, rows without an id dropped, a null text empty.  ``start`` is the first
    word of the best window, the earliest among equals; a window of a document shorter
    than the item is the document.  Texts without words match nothing.  Of rows that
    share an id each is compared, and the best counts.  ``n_windows`` counts all windows
    at the similarity, at every start.
    """
    items = only(benchmark, "item_id", "text").select("item_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    few = items.where((F.size("w") > 0) & (F.size("w") < GRAM)).select("item_id", "w")
    items = items.where(F.size("w") >= GRAM).select("item_id", "row", grams(F.col("w")).alias("g"))
    items = cut(items, "grams")
    items = cut(items.select("item_id", "row", "g", F.size("g").alias("n"), simhash(F.col("g")).alias("item_hash")), "items")
    places = items.select("item_id", "row", "n", F.explode_outer("g").alias("gram"))

    texts = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("copy"), words(F.col("text")).alias("w"))
    texts = texts.select("doc_id", "copy", grams(F.col("w")).alias("g"))
    hits = texts.select("doc_id", "copy", F.size("g").alias("m"), F.posexplode_outer("g").alias("at", "gram")).join(_sized(places.distinct(), bound), "gram")
    starts = cut(_starts(hits, similarity), "starts")

    # Only documents with a shared 5-gram are read again.
    ids = _sized(starts.select("doc_id").distinct(), bound)
    near = only(docs, "doc_id", "text").join(ids, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("copy"), "text").dropDuplicates(["doc_id", "copy"])
    near = near.select("doc_id", "copy", words(F.col("text")).alias("w")).select("doc_id", "copy", grams(F.col("w")).alias("g"))
    key = ["doc_id", "copy", "n", "start"]
    windows = starts.select(*key).distinct().join(near, ["doc_id", "copy"]).select(*key, F.slice("g", F.col("start") + 1, F.col("n")).alias("g"))
    # Written before they are hashed: a lambda over a computed array would compute it again for every bit.
    windows = cut(windows, "windows").withColumn("hash", simhash(F.col("g")))
    windows = cut(windows, "hashes")

    # The index says which items of a window's size are near, whatever item the window was made for.
    theirs = items.select("item_id", "row", "n", "item_hash", F.explode_outer(blocks(F.col("item_hash"))).alias("b")).select("item_id", "row", "n", "item_hash", "b.block", "b.value")
    ours = windows.select(*key, "hash", F.explode_outer(blocks(F.col("hash"))).alias("b")).select(*key, "hash", "b.block", "b.value")
    met = ours.join(_sized(theirs, bound), ["n", "block", "value"]).select(*key, "item_id", "row", F.bit_count(F.col("hash").bitwiseXOR(F.col("item_hash"))).alias("distance"))
    met = met.where(F.col("distance") <= RADIUS).distinct()

    pair = [*key, "item_id", "row", "distance"]
    mine = windows.join(met, key).select(*pair, F.size("g").alias("m"), F.explode_outer("g").alias("gram"))
    mine = mine.groupBy(*pair, "m", "gram").agg(F.count("*").alias("k"))
    counts = places.groupBy("row", F.col("n").alias("total"), "gram").agg(F.count("*").alias("c"))
    # Every window found shares a gram with its item or is below any threshold above 0.
    shared = mine.join(counts, ["row", "gram"]).groupBy(*pair, "m", "total").agg(F.sum(F.least("k", "c")).alias("least"))
    exact = shared.withColumn("similarity", F.col("least") / (F.col("m") + F.col("total") - F.col("least"))).where(F.col("similarity") >= similarity)
    exact = exact.select("doc_id", "copy", "item_id", "start", "distance", "similarity")
    if not few.isEmpty():
        exact = exact.union(_short(docs, few, bound))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), (-F.col("distance")).alias("distance"))).alias("best")
    out = exact.groupBy("doc_id", "item_id").agg(best, F.countDistinct("copy", "start").alias("n_windows"))
    return out.select("doc_id", "item_id", "best.similarity", (-F.col("best.distance")).alias("distance"), (-F.col("best.start")).alias("start"), "n_windows")
