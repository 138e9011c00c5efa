"""Whole runs: pages or tables to survivors, statistics, chunks, a dataset and its manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import BytePairTokens, token_count
from ..operators import chunking, cleaning, near_dedup, packing, quality
from ..sources import readers, writers
from ..storage import stored

# Fixed value: what a document's warnings say of removals.
REMOVED = "Quality filter removed %d of %d paragraph(s) (non-English: %d, markup: %d, citations: %d, low quality: %d, duplicates: %d)."
STATS = ("original_chars", "clean_chars", "original_paragraphs", "remaining_paragraphs", "removed_paragraphs", "removed_non_english", "removed_markup", "removed_citations", "removed_low_quality", "duplicates_removed")


def filter_paragraphs(docs: DataFrame, key: str = "doc_id", scope: str = "document", deduplicate: bool = True, near: bool = True, detector: T.Detector | None = None, digest: str = "blake2b", **rules) -> tuple[DataFrame, DataFrame]:
    """(scored paragraphs with reasons, survivors).  ``scope`` says whether duplicates count within a document or the corpus.

    Scores are written to the shared folder once; survivors and statistics read them there.
    """
    scored = quality.classify(quality.score(quality.explode_paragraphs(docs, key), detector=detector), **rules)
    scored = stored(scored, "scored")
    kept = scored.where("reason = 'kept'")
    if deduplicate:
        within = [key] if scope == "document" else []
        order = [key, "para_no"]
        kept = quality.exact_dedup(kept, order, within)
        if near:
            kept = near_dedup.near_dedup(kept, within, order, digest=digest)
    return scored, kept


def process_pages(pages: DataFrame, key: str = "path", rules: dict | None = None, tokens: bool = True, **cleaning_options) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): pages with ``error`` become errors; documents carry text, counts, statistics and warnings."""
    errors = pages.where("error is not null").select(key, "error") if "error" in pages.columns else pages.limit(0).select(key, F.lit("").alias("error"))
    good = pages.where("error is null") if "error" in pages.columns else pages
    cleaned = cleaning.clean(good, key, **cleaning_options)
    scored, kept = filter_paragraphs(cleaned, key, **(rules or {}))
    texts = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda r: r["text"]), "\n\n").alias("kept_text"))
    docs = cleaned.join(texts, key, "left").withColumn("text", F.coalesce("kept_text", F.lit(""))).drop("kept_text")
    docs = docs.join(quality.stats(scored, kept, [key]), key, "left")
    names = ("removed_paragraphs", "original_paragraphs", "removed_non_english", "removed_markup", "removed_citations", "removed_low_quality", "duplicates_removed")
    said = F.when(F.col("removed_paragraphs") > 0, F.format_string(REMOVED, *names))
    docs = docs.withColumn("warnings", F.filter(F.concat("warnings", F.array(said)), lambda x: x.isNotNull()))
    docs = docs.withColumn("char_count", F.length("text")).withColumn("word_count", F.size(T.split_words(F.col("text"))))
    return (docs.withColumn("estimated_tokens", token_count(F.col("text"))) if tokens else docs), errors


def process_sources(spark: SparkSession, paths: list[str], folder: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of files; cleaned texts go to ``folder`` if it is given.  Without any document it raises."""
    docs, errors = process_pages(readers.read_pages(spark, paths), **options)
    docs = stored(docs, "documents")
    if docs.isEmpty():
        raise RuntimeError("no document could be processed: " + "; ".join(f"{r['path']}: {r['error']}" for r in errors.take(20)))
    if folder:
        writers.write_text_files(docs, folder, "path")
    return docs, errors


def process_table(table: DataFrame, key: str, rules: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored, survivors) of a table whose rows are paragraphs of one corpus: duplicates count over all rows."""
    return filter_paragraphs(cleaning.clean_text(table.select(key, "text")), key, scope="corpus", **(rules or {}))


def _examples(chunks: DataFrame, order: list[str], samples: int, make_coder: Callable) -> DataFrame:
    """One row: how many chunks there are, the tokens of their texts, joins included, and the first ones."""
    first = chunks.orderBy(*order).limit(samples).select(F.struct(*order, "text").alias("c")).agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["text"]).alias("sample_examples"))
    counts = chunking.coded_sizes(chunks, make_coder).agg(F.count("*").alias("example_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_estimated_tokens"))
    return counts.crossJoin(first)


def build(docs: DataFrame, key: str, size: int = 512, overlap: int = 50, least: int = 64, samples: int = 5, make_coder: Callable = BytePairTokens) -> tuple[DataFrame, DataFrame]:
    """(chunks, manifest): the manifest counts examples, their tokens and skipped documents, sums the statistics and shows the first examples."""
    chunks = stored(chunking.chunk(docs, key, size, overlap, least, make_coder), "chunks")
    sums = [F.sum(c).alias(c) for c in STATS if c in docs.columns]
    skipped = docs.agg(F.count_if(T.strip(F.col("text")) == "").alias("skipped_documents"), *sums)
    return chunks, _examples(chunks, [key, "chunk_no"], samples, make_coder).crossJoin(skipped)


def build_dataset(docs: DataFrame, key: str, folder: str, name: str, single_file: bool = False, **sizes) -> DataFrame:
    """Writes the chunks of documents as JSON lines under ``folder``; the manifest, with the path.  Nothing empty is written."""
    if docs.isEmpty():
        raise ValueError("there are no documents to build a dataset from")
    path = f"{folder.rstrip('/')}/{writers.dataset_name(name)}"
    chunks, manifest = build(docs, key, **sizes)
    writers.write_jsonl(chunks.orderBy(key, "chunk_no"), path, single_file)
    return manifest.withColumn("jsonl_path", F.lit(path))


def table_to_dataset(table: DataFrame, key: str, folder: str, source: str, text_field: str = "text", name: str | None = None, max_rows: int | None = 5000, order: list[str] | None = None, rules: dict | None = None, single_file: bool = False, size: int = 512, overlap: int = 50, least: int = 64, samples: int = 5, examples: int = 60, make_coder: Callable = BytePairTokens) -> DataFrame:
    """A table's rows cleaned, filtered and deduplicated as one corpus, packed as one text into chunks, and written as JSON lines.

    The manifest has the statistics, the first decisions and chunks, and the table's
    columns.  ``max_rows`` rows at most are read, in ``order``; None takes all.  Survivors
    are packed in the order of ``key``, whatever the partitions.
    """
    if not (source or "").strip():
        raise ValueError("the source needs a name")
    rows = stored(readers.read_table(table.select(key, *([text_field] if text_field in table.columns and text_field != key else [])) if text_field in table.columns else table, text_field, order or [key], max_rows).select(key, "text"), "rows")
    if rows.isEmpty():
        raise RuntimeError(f"no usable rows in '{source}', so no dataset is written")
    scored, kept = process_table(rows, key, rules)
    kept = stored(kept.select(key, "para_no", "text"), "survivors")
    if kept.isEmpty():
        raise RuntimeError(f"the filters left nothing of '{source}', so no dataset is written; milder rules may keep more")
    path = f"{folder.rstrip('/')}/{writers.dataset_name(name, source)}"
    chunks = packing.chunk_corpus(kept, [key, "para_no"], size, overlap, least, make_coder)
    chunks = chunks.select("chunk_no", T.strip(F.col("text")).alias("text"), F.when(T.strip(F.col("text")) == F.col("text"), F.col("token_count")).alias("parts")).where("text <> ''")
    writers.write_jsonl(chunks.orderBy("chunk_no"), path, single_file)
    stats, shown = quality.stats(scored, kept, []), quality.examples(scored, [], [key, "para_no"], examples)
    listed = shown.agg(F.array_sort(F.collect_list(F.struct(*shown.columns))).alias("quality_examples"))
    out = _examples(chunks, ["chunk_no"], samples, make_coder).crossJoin(stats).crossJoin(listed).withColumn("total_chars", F.col("clean_chars"))
    return out.withColumn("columns", F.array(*(F.lit(c) for c in table.columns))).withColumn("jsonl_path", F.lit(path))


def parameter_count(configs: DataFrame) -> DataFrame:
    """Configs (vocab, n_embd, n_layer, block, tied) with the closed-form number of parameters and how it is shown."""
    v, c, layers, b = (F.col(x).cast("long") for x in ("vocab", "n_embd", "n_layer", "block"))
    n = v * c + b * c + layers * (12 * c * c + 13 * c) + 2 * c + F.when(F.col("tied"), F.lit(0)).otherwise(v * c)
    return configs.withColumn("n_params", n).withColumn("shown", shown_count(n)).withColumn("bytes_fp32", n * 4).withColumn("bytes_fp16", n * 2)


def shown_count(n: Column) -> Column:
    """A count in billions, millions or thousands, to two places."""
    return F.when(n >= 10**9, F.format_string("%.2fB", n / 1e9)).when(n >= 10**6, F.format_string("%.2fM", n / 1e6)).when(n >= 10**3, F.format_string("%.2fK", n / 1e3)).otherwise(n.cast("string"))
