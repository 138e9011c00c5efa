"""SpotSigs document fingerprints, by DataFrame functions alone.

A signature is a common word (the antecedent) with the next two content words behind
it, common words skipped; an antecedent counts where a content word follows at once.
The set of a text's signatures is its fingerprint, so text that runs without such
words, as lists and menus do, weighs little.  A text without any signature has one
for the whole of its words.

To join a corpus with itself, sets are partitioned by their length: a similarity of
at least t needs lengths within a factor of t.  Within neighbouring partitions sets
meet on the first places of their signatures, sorted by hash (the prefix in which any
similar pair shares one), and the Jaccard of what is left is computed behind a bound by length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, only, partitions

#: Common words of English, German, French and Spanish.
COMMON = """a an the of and to in is was are that this it for on with as at by from or be
der die das den dem des ein eine einer und ist von zu im mit für auf nicht als auch
le la les un une de du des et est que qui en dans pour sur par au avec ce pas
el los las una y que en por con para no se del su lo al es""".split()
_STOP = "(?:" + "|".join(sorted(set(COMMON))) + ")"
_SPOT = rf"(?<= )({_STOP}) (?!{_STOP} )(?=(\S+) (?:{_STOP} )*+(\S+) )"


def signatures(text: Column) -> Column:
    """The sorted set of hashes of a text's signatures; each scan of the text is linear in its length."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit("  "))
    marked = F.regexp_replace(plain, _SPOT, "\u0001$1 $2 $3\u0002")
    spots = F.regexp_extract_all(marked, F.lit("\u0001([^\u0002]*)\u0002"), F.lit(1))
    whole = F.array(F.concat(F.lit("\u0001"), plain))
    chosen = F.when(F.size(spots) > 0, spots).otherwise(whole)
    return F.array_sort(F.array_distinct(F.transform(chosen, lambda s: F.xxhash64(s))))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two fingerprints, neither of which is empty."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def shown(signatures: Column) -> Column:
    """A fingerprint as text: 16 hexadecimal digits for each signature's hash."""
    return F.lower(F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s), 16, "0")), ""))


def _between(value: Column, splits: Sequence[int], lo: int = 0, hi: int | None = None) -> Column:
    """How many splits are at or below the value, as nested comparisons of logarithmic depth."""
    hi = len(splits) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value >= splits[mid], _between(value, splits, mid + 1, hi)).otherwise(_between(value, splits, lo, mid))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each document with the one that follows by doc_id; the first follows the last.

    Texts move once, to ranges of ids whose splitters are sampled quantiles; the
    first document of a range is sent to the range before as well.  The driver holds
    one splitter and one id a range.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    splits = sorted({int(x) for x in docs.stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    # Nested comparisons for a few ranges; for very many one array and no expression for each.
    at = _between(F.col("doc_id"), splits) if len(splits) <= 512 else F.size(F.filter(F.lit(splits), lambda x: x <= F.col("doc_id")))
    placed = docs.withColumn("range", at)
    least = sorted((r["range"], r["id"]) for r in placed.groupBy("range").agg(F.min("doc_id").alias("id")).collect())
    if not least:
        heads = placed.limit(0)
    else:
        before = dict(zip([r for r, _ in least[1:]] + [least[0][0]], [r for r, _ in least]))
        heads = placed.where(F.col("doc_id").isin([i for _, i in least])).groupBy("range", "doc_id").agg(F.min("text").alias("text"))
        back = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        heads = heads.select("doc_id", "text", back[F.col("range")].alias("range"))
    rows = placed.withColumn("sent", F.lit(0)).unionByName(heads.withColumn("sent", F.lit(1)))
    order = Window.partitionBy("range").orderBy("sent", "doc_id", "text")
    # Signatures are made before the exchange, once a document.  Ranges go by their number, as their hash would put several together.
    rows = rows.withColumn("sigs", signatures(F.col("text"))).repartitionById(n, F.col("range"))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sigs", F.lead("sigs").over(order))
    return rows.where("sent = 0").drop("sent", "range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    ``docs`` has doc_id and text; further columns are ignored, rows without a doc_id
    dropped; a null text is empty.  The edited text has the last half of its code
    points, rounded down, replaced by as many from the next document's start, or all
    it has.  Rows that share a doc_id follow each other by text.  Texts without words
    have equal fingerprints.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", "sigs", "next_sigs", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_sigs"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("sigs")).alias("fingerprint"), shown(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b, similarity) of pairs a < b of the least documents of equal fingerprints, at ``percent`` or more.

    Partitioned by set length; equal sets are collapsed first, so copies make no pairs.
    """
    sets = only(docs, "doc_id", "text").select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    sets = cut(sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sigs")), "sets")
    step = F.log(F.lit(100 / percent))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    keyed = sets.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    keys = keyed.select("doc_id", "n", "part", F.explode_outer(F.slice("sigs", F.lit(1), prefix.cast("int"))).alias("sig"))
    other = keys.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"), "sig")
    pairs = keys.withColumnRenamed("doc_id", "a").join(other, ["part", "sig"]).where("a < b and least(n, m) * 100 >= greatest(n, m) * " + str(percent)).select("a", "b").distinct()
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("sigs").alias("s")), sets.select(F.col("doc_id").alias("b"), F.col("sigs").alias("t"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("s"), F.col("t")).alias("similarity"))
    return both.where(F.col("similarity") * 100 >= percent)
