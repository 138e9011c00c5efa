"""Cleaning of paged documents, in its fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What a document's warnings say.
REPEATED = "Removed %d repeated header/footer line(s)."
EMPTY = "Cleaned text is empty — this file will be excluded from the dataset."


def repeated_lines(pages: DataFrame, key: str = "doc_id", page: str = "page_no", edge: int = 2, min_pages: int = 4, share: float = 0.6) -> DataFrame:
    """(key, line): lines at the first or last places of at least max(min_pages, share of pages) pages of a document."""
    lines = pages.select(key, page, F.posexplode(F.filter(F.transform(F.split("text", T.LINE_END), T.strip), lambda x: x != "")).alias("n", "line"))
    w = Window.partitionBy(key, page)
    edges = lines.withColumn("last", F.max("n").over(w)).where((F.col("n") < edge) | (F.col("n") > F.col("last") - edge))
    edges = edges.where(~F.col("line").rlike(r"(?U)^[\p{Nd}²³¹⁰-⁹₀-₉]+$") & (F.length("line") >= 3)).select(key, page, "line").distinct()
    counts = pages.groupBy(key).agg(F.count("*").alias("_pages")).where(F.col("_pages") >= min_pages)
    found = edges.groupBy(key, "line").agg(F.count("*").alias("c")).join(counts, key)
    return found.where(F.col("c") >= F.greatest(F.lit(min_pages), F.floor(F.col("_pages") * share))).select(key, "line")


def without_lines(pages: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``pages`` with ``removed_lines`` and no line that is among its document's ``lines`` (key, line), wherever it stands."""
    found = lines.groupBy(key).agg(F.array_sort(F.collect_list("line")).alias("removed_lines"))
    pages = pages.join(found, key, "left")
    kept = F.array_join(F.filter(F.split("text", T.LINE_END), lambda x: ~F.array_contains(F.col("removed_lines"), T.strip(x))), "\n")
    return pages.withColumn("text", F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(kept))


def clean(pages: DataFrame, key: str = "doc_id", page: str = "page_no", remove_headers_footers: bool = True, remove_page_numbers: bool = True, normalize_unicode: bool = True, remove_markup: bool = True, remove_web_artifacts: bool = True) -> DataFrame:
    """(key, text, removed_lines, page_count, warnings): each document cleaned and joined in page order."""
    pages = pages.select(key, page, F.coalesce("text", F.lit("")).alias("text"))
    if remove_headers_footers:
        pages = without_lines(pages, repeated_lines(pages, key, page), key)
    else:
        pages = pages.withColumn("removed_lines", F.lit(None).cast("array<string>"))
    for wanted, step in ((remove_page_numbers, T.strip_page_numbers), (remove_markup, T.strip_markup), (remove_web_artifacts, T.strip_web_lines)):
        if wanted:
            pages = pages.withColumn("text", step(F.col("text")))
    docs = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, "text"))).alias("p"), F.first("removed_lines").alias("removed_lines"), F.count("*").alias("page_count"))
    docs = docs.withColumn("text", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"))
    docs = docs.withColumn("text", T.reflow(T.dehyphenate(T.drop_garbage(F.col("text")))))
    if normalize_unicode:
        docs = docs.withColumn("text", T.nfkc(F.col("text")))
    docs = docs.withColumn("text", T.collapse(F.col("text"))).withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<string>")))
    said = F.when(F.size("removed_lines") > 0, F.format_string(REPEATED, F.size("removed_lines")))
    empty = F.when(T.strip(F.col("text")) == "", EMPTY)
    return docs.select(key, "text", "removed_lines", "page_count", F.filter(F.array(said, empty), lambda x: x.isNotNull()).alias("warnings"))


def clean_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows that are documents of one page, without headers or page numbers: built-in functions alone but for NFKC.

    Each pattern is run on the texts alone that hold a sign without which it changes nothing.
    """
    text, odd = F.col(column), F.col("_odd")
    df = df.withColumn("_odd", text.rlike(T.ODD_SIGNS))
    # Tags may go and leave spaces, but no other signs.
    df = df.withColumn(column, T.strip_markup_and_web_lines(text, F.when(odd, T.LINE_END).otherwise("\n")))
    df = df.withColumn(column, F.when(odd, T.drop_garbage(text)).otherwise(text)).drop("_odd")
    # Line feeds are the only line ends that are left.
    df = df.withColumn(column, T.reflow(T.changed(text, T.dehyphenate, "-\n"), "\n"))
    return df.withColumn(column, T.nfkc(text)).withColumn(column, T.apart(T.changed(text, T.one_space, "  ", "\t")))
