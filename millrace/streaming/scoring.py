"""Row-wise steps over streams; an addition, since they keep no state between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import cleaning, quality


def score_stream(stream: DataFrame, column: str = "text", **rules) -> DataFrame:
    """A streaming DataFrame of documents, cleaned, scored and classified."""
    return quality.classify(quality.score(cleaning.clean_text(stream, column), column), **rules)
