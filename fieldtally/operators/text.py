"""Counts of words and word triples in open answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import kept_words, not_in, trigrams
from fieldtally.functions.text import EXTRA_STOP_WORDS
from fieldtally.session import settle

# Hash buckets of triples, and how many times k of the largest are counted exactly at first.
TRIPLE_BUCKETS, LARGEST = 1 << 18, 4


def _dealt(answers: DataFrame, parts: int | None) -> DataFrame:
    return answers if parts is None else answers.repartition(parts)


def word_counts(
    answers: DataFrame,
    text: str,
    stop_words: DataFrame | Sequence[str],
    extra: Sequence[str] = EXTRA_STOP_WORDS,
    compat: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """(word, n) over all answers without stop words.

    ``parts`` deals the answers out first, for a table that comes as one row
    group and would be read by one task; leave it out for a table of many.
    Stop words are taken out of the counted vocabulary and not of the running
    text: the same result with one test per word instead of one per occurrence.
    """
    counted = (
        _dealt(answers, parts).select(F.explode(kept_words(text, compat=compat)).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    if isinstance(stop_words, DataFrame):
        counted = counted.join(stop_words, "word", "left_anti")
    else:
        counted = counted.filter(not_in("word", stop_words))
    return counted.filter(not_in("word", extra))


def trigram_counts(answers: DataFrame, text: str, compat: bool = False, parts: int | None = None) -> DataFrame:
    """(words, n) of neighbouring word triples; answers under three words add none. ``parts`` as in ``word_counts``."""
    # The words get a column of their own, else the text would be split again
    # for every triple taken from it.
    tokens = _dealt(answers, parts).select(kept_words(text, compat=compat).alias("tokens"))
    return (
        tokens.select(F.explode(trigrams("tokens")).alias("words"))
        .groupBy("words")
        .agg(F.count("*").alias("n"))
    )


def top_trigrams(
    answers: DataFrame, text: str, k: int, compat: bool = False, parts: int | None = None, buckets: int = TRIPLE_BUCKETS
) -> DataFrame:
    """The k most frequent word triples, ties in order of the words, without shuffling every triple there is.

    A first pass counts triples by a hash, ``buckets`` numbers a task: a bucket's
    count is an upper bound of each triple in it. The triples of the largest
    buckets are counted exactly, and the k-th of them is a lower bound of the
    result's last count. Buckets under it can hold nothing of the result and
    are dropped; what is left is counted exactly. Where that is most of the
    triples, because their counts are too much alike, all are counted. Small
    numbers decide this, so the first two passes run while the plan is built.
    """
    tokens = _dealt(answers, parts).select(kept_words(text, compat=compat).alias("tokens"))
    triples = tokens.select(F.explode(trigrams("tokens")).alias("words"))
    bucket = F.pmod(F.xxhash64("words"), F.lit(buckets)).cast("int")
    hashed = triples.withColumn("__bucket", bucket)
    sizes = settle(hashed.groupBy("__bucket").agg(F.count("*").alias("__most")), "triple-buckets")
    largest = settle(sizes.orderBy(F.desc("__most"), "__bucket").limit(LARGEST * k), "triple-largest")

    def counted(some: DataFrame) -> DataFrame:
        return hashed.join(some, "__bucket", "left_semi").groupBy("words").agg(F.count("*").alias("n"))

    first = settle(most_common(counted(largest), "words", k), "triple-first")
    found = first.agg(F.count("*").alias("found"), F.min("n").alias("kth")).first()
    kth = found["kth"] if found["found"] == k else 0
    within = F.col("__most") >= kth
    able = sizes.where(within)
    state = sizes.agg(F.sum(F.when(within, F.col("__most"))).alias("able"), F.sum("__most").alias("all")).first()
    if not state["all"]:
        return first
    if able.join(largest, "__bucket", "left_anti").isEmpty():
        return first
    if 2 * state["able"] > state["all"]:
        return most_common(trigram_counts(answers, text, compat, parts), "words", k)
    return most_common(counted(able), "words", k)


def most_common(counts: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent, ties in order of the key."""
    return counts.orderBy(F.desc("n"), F.asc(key)).limit(k)
