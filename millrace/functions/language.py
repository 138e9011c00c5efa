"""A language identifier: profiles of character trigrams, counted by Spark from texts of known language.

A trigram's code points give its bucket by a fixed rule, so a profile is an array of
BUCKETS log-probabilities, whatever the texts.  A text's share for a language is what
naive Bayes with equal priors says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

from .text import Detector, strip

#: Buckets of trigrams, and languages at most, so that a model stays below 8 MB.
BUCKETS, LANGUAGES = 16381, 64
#: Characters that are looked at once.
PIECE = 1 << 19


@dataclass(frozen=True)
class Profiles:
    """Languages in order, and a row of log-probabilities for each."""

    languages: tuple[str, ...]
    logs: np.ndarray


def buckets(text: str) -> np.ndarray:
    """The buckets of a text's trigrams, with A-Z in lower case."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    c = np.where((c >= 65) & (c <= 90), c + 32, c)
    return (c[:-2] * 10007 + c[1:-1] * 101 + c[2:]) % BUCKETS


def _pieces(text: str) -> Iterator[np.ndarray]:
    for i in range(0, len(text) - 2, PIECE):
        yield buckets(text[i : i + PIECE + 2])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            if len(counts) > LANGUAGES:
                raise ValueError(f"more than {LANGUAGES} languages")
            for piece in _pieces(text):
                own += np.bincount(piece, minlength=BUCKETS)
    for lang, own in counts.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(own[some])], ["lang", "bucket", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of all rows with a text and a language; each task sums its own and sends at most BUCKETS rows a language."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), strip(F.col(text)).alias("text"))
    sums = known.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(sums["lang"])))
    if not languages or len(languages) > LANGUAGES:
        raise ValueError(f"profiles need 1 to {LANGUAGES} languages with texts, not {len(languages)}")
    counts = np.zeros((len(languages), BUCKETS))
    counts[pd.Categorical(sums["lang"], languages).codes, sums["bucket"]] = sums["n"]
    return Profiles(languages, np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + BUCKETS)))


def shares(profiles: Profiles, text: str) -> np.ndarray | None:
    """Each language's share; None for a text of fewer than three characters."""
    if len(text) < 3:
        return None
    scores = sum(profiles.logs[:, piece].sum(axis=1) for piece in _pieces(text))
    odds = np.exp(scores - scores.max())
    return odds / odds.sum()


def profile_detector(profiles: Profiles) -> Detector:
    """A detector by profiles, for ``english_probability`` and the filters; null for null and for texts too short."""

    @F.pandas_udf(MapType(StringType(), DoubleType()))
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found = [None if t is None else shares(profiles, t) for t in part]
            yield pd.Series([None if s is None else dict(zip(profiles.languages, s.tolist())) for s in found], dtype=object)

    return judged


def identified(text: Column, profiles: Profiles) -> Column:
    """The language with the largest share, of equal ones the first by name; null where there is none."""
    some = F.map_entries(profile_detector(profiles)(strip(text)))
    return F.array_sort(F.transform(some, lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))[0]["k"]
