"""Reports: statistics as text, previews, status lines, example decisions, loss histories and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The reports' wording, and how much they show.
LABELS = (
    ("Original characters", "original_chars", True),
    ("Clean characters", "clean_chars", True),
    ("Original paragraphs", "original_paragraphs", False),
    ("Remaining paragraphs", "remaining_paragraphs", False),
    ("Removed paragraphs", "removed_paragraphs", False),
    ("Removed as non-English", "removed_non_english", False),
    ("Removed as markup", "removed_markup", False),
    ("Removed as citation/reference fragments", "removed_citations", False),
    ("Removed as low quality", "removed_low_quality", False),
    ("Duplicates removed", "duplicates_removed", False),
)
PREVIEW, TRUNCATED = 5000, "\n\n... (preview truncated, full text saved to the .txt file)"
FIELDS, NOT_SAVED, FILTERING = ("Pages", "Characters", "Words", "Estimated tokens", "Warnings", "TXT saved to"), "(not saved — no extractable text found)", "\n\n--- Quality filtering ---\n"
PROCESSED, STATUS, WARNING = "Processed %d of %d file(s):", "  - %s: %s | pages=%d chars=%d words=%d est_tokens=%d", "      warning: "
SHOWN, ORIGINAL, RULE, NONE = 15, 400, "\n\n---\n\n", "(no paragraphs to show)"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stats_text() -> Column:
    """The ten counters of a row, a line each; character counts in groups of three digits."""
    lines = [F.concat(F.lit(f"{label}: "), F.format_number(F.coalesce(name, F.lit(0)), 0) if grouped else F.coalesce(name, F.lit(0)).cast("string")) for label, name, grouped in LABELS]
    return F.concat_ws("\n", *lines)


def with_stats_text(stats: DataFrame) -> DataFrame:
    return stats.withColumn("report", stats_text())


def examples_text(examples: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, report): the first SHOWN decisions of each scope, cut to ORIGINAL characters, in order."""
    status = F.when(F.col("keep"), "KEEP").otherwise(F.format_string("REMOVE (%s)", "reason"))
    block = F.format_string("[%s] quality score=%s\n%s", status, F.col("score").cast("string"), F.substring("original", 1, ORIGINAL))
    some = examples.where(F.col("example_no") <= SHOWN)
    lists = some.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("example_no", block.alias("block")))).alias("b"))
    return lists.select(*scope, F.array_join(F.transform("b", lambda x: x["block"]), RULE).alias("report"))


def preview(text: Column) -> Column:
    """A text's beginning, and a note where there is more."""
    return F.concat(F.substring(text, 1, PREVIEW), F.when(F.length(text) > PREVIEW, TRUNCATED).otherwise(""))


def document_report(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, preview, report) of processed documents: counts, warnings, where the text is, and the statistics."""
    saved = F.when(F.trim("text") != "", F.concat(F.regexp_replace(base_name(F.col(key).cast("string")), r"\.[^.]*$", ""), F.lit(".txt"))).otherwise(NOT_SAVED)
    lines = [
        F.concat(F.lit(f"{label}: "), value)
        for label, value in zip(FIELDS, (*(F.col(c).cast("string") for c in ("page_count", "char_count", "word_count", "estimated_tokens")), F.when(F.size("warnings") > 0, F.array_join("warnings", "; ")).otherwise("none"), saved))
    ]
    report = F.concat(F.concat_ws("\n", *lines), F.lit(FILTERING), stats_text())
    return docs.select(key, base_name(F.col(key).cast("string")).alias("name"), preview(F.col("text")).alias("preview"), report.alias("report"))


def named_document(reports: DataFrame, name: str) -> DataFrame:
    """The first report with this base name."""
    return reports.where(F.col("name") == name).orderBy(reports.columns[0]).limit(1)


def status_lines(docs: DataFrame, errors: DataFrame, key: str = "path") -> DataFrame:
    """(part, name, line_no, line): a count first, then each document's line and warnings, then each failed file's."""
    counts = docs.agg(F.count("*").alias("n")).crossJoin(errors.agg(F.count("*").alias("e")))
    head = counts.select(F.lit(0).alias("part"), F.lit("").alias("name"), F.lit(0).alias("line_no"), F.format_string(PROCESSED, "n", F.col("n") + F.col("e")).alias("line"))
    name = base_name(F.col(key).cast("string"))
    said = F.format_string(STATUS, name, F.when(F.trim("text") != "", "OK").otherwise("NO EXTRACTABLE TEXT"), "page_count", "char_count", "word_count", "estimated_tokens")
    warned = F.transform("warnings", lambda w: F.concat(F.lit(WARNING), w))
    each = docs.select(F.lit(1).alias("part"), name.alias("name"), F.posexplode_outer(F.concat(F.array(said), warned)).alias("line_no", "line"))
    failed = errors.select(F.lit(2).alias("part"), name.alias("name"), F.lit(0).alias("line_no"), F.concat(F.lit("  - "), name, F.lit(": "), "error").alias("line"))
    return head.unionByName(each).unionByName(failed)


def loss_history(log: DataFrame) -> DataFrame:
    """(step, loss, status) of a training log, a row for each step: the last loss logged for it."""
    last = log.groupBy("step").agg(F.max(F.struct("logged", "loss"))["loss"].alias("loss"))
    return last.select("step", "loss", F.format_string("Step %d — loss %.4f", "step", "loss").alias("status"))


def checkpoint_name(run: Column) -> Column:
    """A run's file name: other characters than letters, digits, points, lines and hyphens become lines; nothing for the default run."""
    name = F.trim(F.coalesce(run, F.lit("")))
    safe = F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")
    return F.when(~name.isin("", "default"), F.when(F.lower(safe).endswith(".pt"), safe).otherwise(F.concat(safe, F.lit(".pt"))))


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, length, size_mb) of a folder's files with a suffix, by name: checkpoints and weights."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder).select("path", "length")
    return files.where(F.lower("path").endswith(suffix)).withColumn("size_mb", F.round(F.col("length") / (1024 * 1024), 2)).orderBy("path")
