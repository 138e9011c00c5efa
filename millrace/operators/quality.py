"""Scoring paragraphs, classifying them by first match, removing duplicates, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stored

REASONS = ("markup", "non_english", "citation_fragment", "unusual_characters", "low_quality")


def score(df: DataFrame, column: str = "text", detector: T.Detector | None = None) -> DataFrame:
    """``df`` with the metrics of a paragraph, unrounded, and its score from 0 to 100.

    Words and letters are computed once each, in lower case; later columns refer to them by name.
    Without a language ``detector`` only the script tells other languages.
    """
    p, words, alpha = F.col(column), F.col("_words"), F.col("_alpha")
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(p), F.lit(1))
    spaces = lambda t: F.when(F.col("_odd"), T.spaced(t)).otherwise(t)
    df = df.withColumn("_odd", T.odd_white(p)).withColumns({"_lower": F.lower(p), "_letters": T.lower_letters(p)})
    df = df.withColumns({"_words": T.split_words(F.col("_lower"), spaces), "_alpha": T.split_words(F.col("_letters"), spaces)})
    stop = sorted(set(T.STOPWORDS))
    df = df.withColumns({
        "n_words": F.size(words),
        "n_alpha": F.size(alpha),
        "english_probability": T.english_probability(p, detector),
        "alphabetic_ratio": T.count_of(p, r"\p{L}") / chars,
        "unusual_char_ratio": T.count_unusual(p) / chars,
        "repeated_token_ratio": 1 - F.size(F.array_distinct(words)) / n,
        "url_density": F.regexp_count(p, F.lit(T.URL)) / n,
        "citation_density": F.when(F.size(words) > 0, T.citation_hits(p) / n).otherwise(0.0),
        "has_markup": T.contains_markup(p),
        "punctuation_ratio": T.count_of(p, "[.,;:!?]") / chars,
        "broken_word_ratio": F.size(F.filter(alpha, T.is_broken)) / n,
        "avg_word_len": F.when(F.size(alpha) > 0, F.length(F.array_join(alpha, "")) / F.size(alpha)).otherwise(0.0),
        "stopword_ratio": F.when(F.size(alpha) > 0, F.size(F.filter(alpha, lambda w: w.isin(stop))) / F.size(alpha)).otherwise(0.0),
    })
    # Each metric's weight, and where it begins to count.
    c, over = F.col, lambda x, limit: F.greatest(F.lit(0.0), x - limit)
    penalty = (
        (1 - c("english_probability")) * 35 + over(F.lit(0.5), c("alphabetic_ratio")) * 100 + c("unusual_char_ratio") * 120
        + over(c("repeated_token_ratio"), 0.4) * 80 + c("url_density") * 150 + c("citation_density") * 60 + F.when(c("has_markup"), 25).otherwise(0)
        + over(c("punctuation_ratio"), 0.15) * 100 + c("broken_word_ratio") * 100 + over(c("avg_word_len"), 7.0) * 6
        + F.when((c("n_alpha") >= 3) & (c("stopword_ratio") == 0), 25).otherwise(0)
        + F.when(c("n_words") <= 1, 65).when(c("n_words") == 2, 30).when(c("n_words") <= 4, 12).otherwise(0)
    )
    return df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - penalty))).drop("_odd", "_lower", "_letters", "_words", "_alpha")


def classify(df: DataFrame, english_only: bool = True, english_threshold: float = 0.55, remove_citations: bool = True, remove_low_quality: bool = True, min_quality_score: float = 40.0, max_unusual_char_ratio: float = 0.15) -> DataFrame:
    """Scored paragraphs with ``reason``: the first rule that drops one, or ``kept``.

    Markup and unusual characters drop a paragraph whatever the switches say; the
    ratio of unusual characters is compared as rounded to three places.
    """
    n, density = F.col("n_words"), F.col("citation_density")
    fragment = (n > 0) & (((n <= 6) & (density > 0)) | ((density > 0.25) & (n <= 40)))
    reason = F.when(F.col("has_markup"), "markup")
    if english_only:
        reason = reason.when(F.col("english_probability") < english_threshold, "non_english")
    if remove_citations:
        reason = reason.when(fragment, "citation_fragment")
    reason = reason.when(F.round("unusual_char_ratio", 3) > max_unusual_char_ratio, "unusual_characters")
    if remove_low_quality:
        reason = reason.when(F.col("score") < min_quality_score, "low_quality")
    return df.withColumn("reason", reason.otherwise("kept"))


def explode_paragraphs(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, para_no, text): paragraphs in their order."""
    return docs.select(key, F.posexplode_outer(T.paragraphs(F.col(column))).alias("para_no", "text")).where("text is not null")


def exact_dedup(df: DataFrame, order: list[str], scope: list[str] | None = None, column: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The first of each normalized text by ``order``, within a scope or over all.

    Texts are read once for 24 bytes of hashes, which are written with the order; only these
    are shuffled.  The least order of each
    key is combined before, so a text with very many copies sends one row a task.
    ``order`` names a row.  What goes is broadcast up to so many rows, and joined by a
    shuffle beyond.
    """
    scope = scope or []
    keyed = df.select(*scope, F.struct(*order).alias("_order"), T.normalized(F.col(column)).alias("_text"))
    narrow = stored(keyed.select(*scope, "_order", F.xxhash64("_text").alias("_key"), F.unhex(F.md5("_text")).alias("_md5")), "keys")
    first = narrow.groupBy(*scope, "_key", "_md5").agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = narrow.join(first, [*scope, "_key", "_md5"]).where("_order > _first")
    gone = later.select(*scope, *(F.col(f"_order.{c}").alias(c) for c in order if c not in scope))
    gone = stored(gone, "exact-duplicates")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return df.join(gone, list(dict.fromkeys([*scope, *order])), "left_anti")


def stats(scored: DataFrame, survivors: DataFrame, scope: list[str]) -> DataFrame:
    """The ten counters of each scope: characters and paragraphs before and after, and removals by reason."""
    count = lambda *r: F.count_if(F.col("reason").isin(*r))
    size = F.length("text")
    before = scored.groupBy(*scope).agg(
        (F.sum(size) + 2 * (F.count("*") - 1)).alias("original_chars"), F.count("*").alias("original_paragraphs"), count("non_english").alias("removed_non_english"),
        count("markup").alias("removed_markup"), count("citation_fragment").alias("removed_citations"),
        count("unusual_characters", "low_quality").alias("removed_low_quality"), count("kept").alias("_kept"),
    )
    after = survivors.groupBy(*scope).agg((F.sum(size) + 2 * (F.count("*") - 1)).alias("clean_chars"), F.count("*").alias("remaining_paragraphs"))
    both = before.join(after, scope, "left") if scope else before.crossJoin(after)
    out = both.fillna(0, ["clean_chars", "remaining_paragraphs"])
    return out.withColumn("removed_paragraphs", F.col("original_paragraphs") - F.col("remaining_paragraphs")).withColumn("duplicates_removed", F.col("_kept") - F.col("remaining_paragraphs")).drop("_kept")


def first_rows(df: DataFrame, scope: list[str], order: list[str], limit: int = 60) -> DataFrame:
    """The first rows of each scope, which ``order`` names: what ``examples`` shows, before it is cleaned and scored."""
    w = Window.partitionBy(*scope).orderBy(*order)
    keys = df.select(*scope, *order).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return df.join(keys.select(*order), order, "left_semi")


def examples(scored: DataFrame, scope: list[str], order: list[str], limit: int = 60) -> DataFrame:
    """The first decisions of each scope, in order."""
    w = Window.partitionBy(*scope).orderBy(*order)
    out = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return out.select(*scope, F.col("_n").alias("example_no"), F.col("text").alias("original"), F.round("score", 1).alias("score"), (F.col("reason") == "kept").alias("keep"), "reason")
