"""Sources: file discovery, extractors by suffix, corpora of JSON lines or text, and named tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES
from ..storage import stored

#: Bytes of a file at most that a row can hold.
MOST = (1 << 31) - 1024
PAGES = "path string, page_no int, text string, warning string, error string"
#: suffix -> a function from a file's bytes to its pages' texts.
_EXTRACTORS: dict[str, Callable[[bytes], list[str]]] = {}


def register_extractor(suffix: str, pages_of: Callable[[bytes], list[str]]) -> None:
    """Files with this suffix are read by ``pages_of`` from now on; the last registration wins."""
    _EXTRACTORS[suffix.lower()] = pages_of


def extractor_for(path: str) -> Callable[[bytes], list[str]]:
    suffix = suffix_of(path)
    if suffix not in _EXTRACTORS:
        raise ValueError(f"nothing is registered to read '{suffix}' files, but {', '.join(sorted(_EXTRACTORS))}")
    return _EXTRACTORS[suffix]


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _plain(data: bytes) -> list[str]:
    return [data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")]


def _pdf(data: bytes) -> list[str]:
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("PDF files need a PDF library; register an extractor for .pdf") from e
    with fitz.open(stream=data, filetype="pdf") as pdf:
        return [page.get_text("text") for page in pdf]


def _image(data: bytes) -> list[str]:
    try:
        import io

        import pytesseract
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("Images need an OCR engine; register an extractor for them") from e
    return [pytesseract.image_to_string(Image.open(io.BytesIO(data)))]


register_extractor(".txt", _plain)
register_extractor(".pdf", _pdf)
for _suffix in (".png", ".jpg", ".jpeg"):
    register_extractor(_suffix, _image)


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of the paths that have an extractor, as Spark's binary source shows them; others are passed over by name, unread.

    A path that isn't there raises, and so does a file without an extractor.
    """
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for p in dict.fromkeys(paths):
        where = jvm.org.apache.hadoop.fs.Path(p)
        found = where.getFileSystem(hadoop).globStatus(where)
        if not found:
            raise FileNotFoundError(p)
        for one in found:
            if one.isFile():
                extractor_for(one.getPath().getName())
    # Paths within one another would give a file twice.
    inner = [p for p in dict.fromkeys(paths) if not any(p != q and p.startswith(q.rstrip("/") + "/") for q in paths)]
    known = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix) for suffix in _EXTRACTORS)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    return reader.option("pathGlobFilter", f"*{{{known}}}").load(inner)


def _listed(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, length) of all files, empty ones too: the driver lists them in any case."""
    empty = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "name string").distinct()
    lengths = files.select("path", "length").distinct()
    # Rows of files with bytes spell a path as the listing does but for its slashes and escapes.
    name = F.regexp_replace("path", "^file:/+", "file:/")
    both = empty.withColumn("name", F.regexp_replace("name", "^file:/+", "file:/")).join(lengths, F.col("name") == name, "left")
    return both.select(F.coalesce("path", "name").alias("path"), F.coalesce("length", F.lit(0)).alias("length"))


def discover(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length): registered files of the paths, directories searched to any depth, each once.

    A file that is named and has no extractor raises; in a directory it is passed over.
    """
    return _listed(spark, _files(spark, paths))


discover_pdf_files = discover

# Fixed value: what is said of a file without text.
NO_TEXT = "No text was found."


def read_pages(spark: SparkSession, paths: list[str], most: int = MOST) -> DataFrame:
    """(path, page_no, text, warning, error) of all pages; a file that fails gives one row with its error.

    Content is read of files that have an extractor and 1 to ``most`` bytes.  A file of no
    bytes is one page of no text, with a warning, if it is a text file, else an error; a longer one, and one that the store
    fails to give, is an error row.  The pages are written once.
    """
    extractors = dict(_EXTRACTORS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                suffix = suffix_of(path)
                try:
                    pages = extractors[suffix](bytes(content))
                    if not pages:
                        raise ValueError("it has no pages")
                except Exception as e:  # a file's failure is a row, not the job's end
                    rows.append((path, None, None, None, str(e)))
                    continue
                size = len("".join(pages).strip())
                warning = NO_TEXT if not size else "Little text; the file may need OCR." if suffix == ".pdf" and size < 20 * len(pages) else None
                rows += [(path, i, t, warning, None) for i, t in enumerate(pages)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "warning", "error"]).astype({"page_no": "Int32"})

    files = _files(spark, paths)
    listed = stored(_listed(spark, files), "listing")
    pages = stored(files.where(F.col("length") <= most).select("path", "content").mapInPandas(run, PAGES), "pages")
    # What a task cannot name by its content: empty, long and unreadable files.
    none = F.lit(None).cast("string")
    rest = listed.join(pages.select("path").distinct(), "path", "left_anti").where("length > 0")
    failed = rest.select("path", F.lit(None).cast("int").alias("page_no"), none.alias("text"), none.alias("warning"), F.when(F.col("length") > most, F.format_string("it has %d bytes, more than are read", "length")).otherwise("the store failed to give it").alias("error"))
    empty = listed.where("length = 0").select("path", F.lit(b"").alias("content")).mapInPandas(run, PAGES)
    return pages.unionByName(failed).unionByName(empty)


def read_context(spark: SparkSession, path: str) -> str:
    """One file's text, its pages joined by blank lines; a file that can't be read raises."""
    rows = sorted(read_pages(spark, [path]).collect(), key=lambda r: r["page_no"] or 0)
    for r in rows:
        if r["error"]:
            raise RuntimeError(r["error"])
    return "\n\n".join(r["text"] or "" for r in rows)


# Named sources, (name, repository, configuration, split, text column).
PRESETS = (
    ("Custom...", None, None, None, None),
    ("TinyStories (roneneldan/TinyStories)", "roneneldan/TinyStories", "", "train", "text"),
    ("WikiText-103 raw (wikitext)", "wikitext", "wikitext-103-raw-v1", "train", "text"),
    ("OpenWebText (Skylion007/openwebtext)", "Skylion007/openwebtext", "", "train", "text"),
    ("BookCorpus (bookcorpus)", "bookcorpus", "", "train", "text"),
    ("C4 English, streamed subset (allenai/c4)", "allenai/c4", "en", "train", "text"),
    ("Wikipedia English (wikimedia/wikipedia)", "wikimedia/wikipedia", "20231101.en", "train", "text"),
)


def presets(spark: SparkSession) -> DataFrame:
    """(name, repo_id, config_name, split, text_field) of the named sources."""
    return spark.createDataFrame(list(PRESETS), "name string, repo_id string, config_name string, split string, text_field string")


def preset(name: str) -> tuple[str, str | None, str, str]:
    """(repository, configuration, split, text column) of a named source; an unknown name raises."""
    for known, *rest in PRESETS:
        if known == name and rest[0]:
            return tuple(rest)
    raise ValueError(f"no preset is named '{name}', but {', '.join(p[0] for p in PRESETS if p[1])}")


def read_preset(spark: SparkSession, name: str, root: str, order: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """Rows with text of a named source's copy under ``root``: a table at repository/configuration/split, in Parquet."""
    repository, configuration, split, text = preset(name)
    where = "/".join(x for x in (root.rstrip("/"), repository, configuration, split) if x)
    return read_table(spark.read.parquet(where), text, order, max_rows)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line_no, value): the lines of text files and their numbers from 0, blank ones too.

    A split's lines come in order and get ids one after another; its first number is the
    sum of the lines of the splits before it, of which there is a small row each.
    """
    raw = spark.read.format("text").load(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = raw.groupBy("path", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(splits.select("path", "_start", (before - F.col("_first")).alias("_base")), ["path", "_start"]).select("path", (F.col("_id") + F.col("_base")).alias("line_no"), "value")


def read_corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line_no, text): ``text``, or else ``content``, of JSON lines with their numbers; other files as one text each.

    Blank and malformed lines and empty values are passed over; a value that isn't an
    object counts as its JSON text.
    """
    if not paths:
        raise ValueError("no files are named")
    lines = [p for p in paths if p.lower().endswith(".jsonl")]
    whole = [p for p in paths if p not in lines]
    out = []
    if lines:
        raw = numbered_lines(spark, lines).select("path", "line_no", F.try_parse_json("value").alias("v"))
        pick = [F.nullif(F.try_variant_get("v", f"$.{k}", "string"), F.lit("")) for k in ("text", "content")]
        scalar = F.when(~F.schema_of_variant("v").startswith("OBJECT"), F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v")))
        out.append(raw.where("v is not null").select("path", "line_no", F.coalesce(*pick, scalar).alias("text")))
    if whole:
        raw = spark.read.format("text").option("wholetext", True).load(whole)
        out.append(raw.select(F.col("_metadata.file_path").alias("path"), F.lit(0).cast("long").alias("line_no"), F.col("value").alias("text")))
    df = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return df.where("text <> ''")


def read_table(df: DataFrame, text_field: str = "text", order: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """Rows of a table with text in ``text_field``.  ``max_rows`` is taken in order, before blank rows go; 0 or None takes all."""
    if text_field not in df.columns:
        raise ValueError(f"there is no column '{text_field}' among {df.columns}")
    if max_rows:
        df = (df.orderBy(*order) if order else df).limit(max_rows)
    text = F.btrim(F.col(text_field).cast("string"), F.lit("".join(c for c in SPACES if not "\x1c" <= c <= "\x1f")))
    return df.withColumn("text", text).where("text <> ''")


def spread(df: DataFrame, per_task: int = 32 << 20) -> DataFrame:
    """``df`` dealt over all cores if it is small: its files' row groups may be fewer than the cores.

    Tables of ``per_task`` bytes a core and more have splits enough and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * per_task else df


def list_datasets(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, length) of .txt and .jsonl files of folders, not below them; by folder, then path, each once."""
    out = None
    for i, folder in enumerate(folders):
        one = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder).select(F.lit(i).alias("folder"), "path", "length")
        out = one if out is None else out.union(one)
    kept = out.where(F.lower("path").rlike(r"\.(txt|jsonl)$"))
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("folder"))).where("_n = 1")
    return first.drop("_n").orderBy("folder", "path")
