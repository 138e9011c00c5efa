"""Sinks: JSON lines and cleaned texts; nothing empty is written, and nothing is seen before it is whole and checked."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dataset_name(name: str | None, default: str | None = None) -> str:
    """The file name with its suffix; slashes of a default's name become two underscores."""
    name = (name or "").strip() or (default or "").replace("/", "__")
    if not name:
        raise ValueError("a dataset needs a name")
    return name if name.lower().endswith(".jsonl") else f"{name}.jsonl"


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def published(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside ``path`` to write to; it takes the path's place if nothing is raised, else it goes and the old one stays.

    The old table is moved aside before and deleted after, so that a failed move puts it back.
    """
    name = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    staged, old = f"{name}.staged", f"{name}.old"
    target, fs = _folder(spark, path.rstrip("/"))
    try:
        yield staged
        before = fs.exists(target)
        if before and not fs.rename(target, _folder(spark, old)[0]):
            raise RuntimeError(f"{path} can't be moved aside")
        if not fs.rename(_folder(spark, staged)[0], target):
            if before:
                fs.rename(_folder(spark, old)[0], target)
            raise RuntimeError(f"{path} can't be put in place")
        fs.delete(_folder(spark, old)[0], True)
    finally:
        fs.delete(_folder(spark, staged)[0], True)


def join_parts(spark: SparkSession, folder: str, suffix: str = ".json") -> None:
    """A folder's parts, in the order of their names, as one: bytes are copied one part after another, none is held."""
    where, fs = _folder(spark, folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
    whole = _folder(spark, f"{folder}/part-whole{suffix}")[0]
    out = fs.create(whole)
    try:
        for p in parts:
            come = fs.open(_folder(spark, p)[0])
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(come, out, conf, False)
            finally:
                come.close()
    finally:
        out.close()
    for p in parts:
        fs.delete(_folder(spark, p)[0], False)


def sound(line: Column) -> Column:
    """Whether a line is a JSON object with a text."""
    return F.get_json_object(line, "$.text").isNotNull()


def write_jsonl(chunks: DataFrame, path: str, single_file: bool = False, check: Callable[[Column], Column] = sound) -> str:
    """``{"text": ...}`` lines, each read back and checked before any is seen under ``path``.

    Parts are written in parallel; for a single file their bytes are joined then.  A line
    that fails the check raises and leaves what was there before, and so does an empty dataset.
    """
    rows, spark = chunks.select("text").where("text <> ''"), chunks.sparkSession
    with published(spark, path) as staged:
        rows.write.json(staged)
        found = spark.read.format("text").load(staged).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(check(F.col("value")), F.lit(False))).alias("bad")).first()
        if not found["n"]:
            raise RuntimeError("there is no example, so no dataset is written")
        if found["bad"]:
            raise RuntimeError(f"{found['bad']} of {found['n']} lines for {path} fail the check, so no dataset is written")
        if single_file:
            join_parts(spark, staged)
    return path


def write_text_files(docs: DataFrame, folder: str, key: str = "path") -> str:
    """A directory ``name=<base name>`` with the cleaned text of each document that isn't blank; equal base names share one."""
    base = F.regexp_replace(F.element_at(F.split(F.col(key).cast("string"), "/"), -1), r"\.[^.]*$", "")
    with published(docs.sparkSession, folder) as staged:
        docs.where(F.trim("text") != "").select(F.concat(base, F.lit(".txt")).alias("name"), "text").write.partitionBy("name").text(staged)
    return folder


def write_texts(docs: DataFrame, path: str, key: str = "doc_id") -> str:
    """Cleaned texts that aren't blank, a directory for each bucket of keys, so that equal base names never collide."""
    kept = docs.where(F.trim("text") != "").select(F.pmod(F.xxhash64(key), F.lit(256)).alias("bucket"), F.col(key).cast("string").alias("key"), "text")
    kept.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return path
