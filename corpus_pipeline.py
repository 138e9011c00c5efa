"""A corpus pipeline over ``documents``: five stages, each written and read again as the next one's input.

1. quality: documents that the line field rejects go.
2. near_duplicates: of each group of n-gram near-duplicates the least doc_id stays.
3. decontaminate: documents with a window of a benchmark item go.
4. secrets: secrets are masked in the text, and n_chars follows.
5. pieces: the texts are encoded, decoded again and digested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import decontaminate as leaks
from millrace.llm import ngram_join, pieces, quality_crf
from millrace.llm import secrets as scan
from millrace.llm.store import cut, spare

#: Near-duplicates here: word 5-grams at a Jaccard similarity of 0.8.
WIDTH, PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more; rows without a doc_id go too, since no later stage can name them."""
    model = quality_crf.train(docs, _table(spark, sf_dir, "labels"))
    score = spare(docs, "score")
    kept = quality_crf.scored(docs.where("doc_id is not null"), model, score).where(F.col(score) >= 0.5)
    return kept.select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without some ids (8 bytes each): broadcast up to a million, joined by a shuffle beyond."""
    return docs.join(F.broadcast(gone) if gone.count() <= 1_000_000 else gone, "doc_id", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group; of rows that share its doc_id one with the largest text.  Rows without a doc_id go."""
    groups = cut(ngram_join.ngram_jaccard_join(docs, width=WIDTH, percent=PERCENT), "groups")
    kept = _without(docs.where("doc_id is not null"), groups.where("doc_id <> component_id").select("doc_id"))
    if not docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").isEmpty():
        place = spare(kept, "place")
        first = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("text"))
        kept = kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = cut(leaks.contaminated(docs, _table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return _without(docs, found)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return scan.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256) of all documents."""
    return pieces.encoded_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the fitted field nor the lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
