"""Column functions against plain Python on generated values."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtally.functions import (
    AGE_BANDS_HOUSEHOLD,
    band,
    clean_answer,
    duration_seconds,
    kept_words,
    percent_text,
    trigrams,
    words,
)
from fieldtally.functions.text import FILLER_WORDS

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}_]*(?:['’][\p{L}\p{M}\p{N}_]+)*")
RUN = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
# Letters whose lower case is one letter everywhere, marks, digits and separators.
TEXTS = st.lists(st.text(alphabet="abnot hesiéñüЖж中0123'’_-.,!\u0301\t", max_size=60), min_size=20, max_size=60)


def column(spark, data, kind, expr):
    return [r[0] for r in spark.createDataFrame([(v,) for v in data], f"v {kind}").select(expr).collect()]


@few
@given(data=st.lists(st.integers(0, 10**6), min_size=30, max_size=100))
def test_percent_text(spark, data):
    shares = [n / 10**6 for n in data]
    expected = []
    for p in shares:
        # Spark rounds the shortest decimal that reads back as the number.
        rounded = Decimal(repr(p * 100)).quantize(Decimal("0.1"), ROUND_HALF_EVEN)
        expected.append(f"{rounded.to_integral() if rounded == rounded.to_integral() else rounded}%")
    assert column(spark, shares, "double", percent_text("v")) == expected


@few
@given(data=TEXTS)
def test_words_and_triples(spark, data):
    expected = [WORD.findall(t.lower()) for t in data]
    assert column(spark, data, "string", words("v")) == expected
    df = spark.createDataFrame([(t,) for t in data], "v string").select(words("v").alias("w"))
    triples = [[" ".join(w[i : i + 3]) for i in range(len(w) - 2)] for w in expected]
    assert [r[0] for r in df.select(trigrams("w")).collect()] == triples


@few
@given(data=TEXTS)
def test_cleaning_deletes_whole_filler_words(spark, data):
    def plain(t):
        out, end = [], 0
        for m in RUN.finditer(t):
            out.append(t[end : m.start()])
            last = m.end() == len(t)
            drop = m.group().lower() in FILLER_WORDS or (last and m.group().lower() == "no")
            out.append("" if drop else m.group())
            end = m.end()
        return "".join([*out, t[end:]])

    assert column(spark, data, "string", clean_answer("v")) == [plain(t) for t in data]


FILLED = st.lists(
    st.lists(st.sampled_from([*FILLER_WORDS[:12], "No", "no", "x", "été", "'", "’", " ", "-", "_", "\u0301", "##N/A##", "##", "\n"]), max_size=14)
    .map("".join),
    min_size=150,
    max_size=300,
)


@settings(few, max_examples=12)
@given(data=FILLED)
def test_words_in_one_pass_equal_those_of_the_cleaned_text(spark, data):
    df = spark.createDataFrame([(t,) for t in data], "v string")
    differing = df.select("v", kept_words("v").alias("a"), words(clean_answer("v")).alias("b")).filter("a <> b")
    assert differing.collect() == []


@few
@given(data=st.lists(st.tuples(st.integers(0, 99), st.integers(0, 23), st.integers(0, 59), st.integers(0, 59)), min_size=30))
def test_durations(spark, data):
    texts = [f"{d:02d}.{h:02d}:{m:02d}:{s:02d}" for d, h, m, s in data]
    assert column(spark, texts, "string", duration_seconds("v")) == [
        d * 86400 + h * 3600 + m * 60 + s for d, h, m, s in data
    ]


@few
@given(data=st.lists(st.integers(-5, 130) | st.none(), min_size=30))
def test_age_bands(spark, data):
    def label(age):
        if age is None or age < 0:
            return None
        return next(name for low, name in [(50, "50+"), (35, "35-49"), (18, "18-34"), (5, "5-17"), (0, "0-4")] if age >= low)

    assert column(spark, data, "int", band("v", AGE_BANDS_HOUSEHOLD)) == [label(a) for a in data]
    assert column(spark, [0.5, 4.0, 16.5], "double", band(F.col("v"), AGE_BANDS_HOUSEHOLD, fractional=True)) == [None, "0-4", None]
