"""English stop words for word lists of open answers."""

from __future__ import annotations

from functools import cache

from pyspark.ml.feature import StopWordsRemover


@cache
def english() -> list[str]:
    """Spark's own default list; a session must be running."""
    return StopWordsRemover.loadDefaultStopWords("english")
