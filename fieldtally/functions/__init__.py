"""Column functions: everything here returns a Column and stays inside the JVM."""

from fieldtally.functions.recode import (
    AGE_BANDS_CHILD_FIRST,
    AGE_BANDS_HOUSEHOLD,
    AGE_BANDS_YOUTH,
    band,
    collapse,
    duration_seconds,
    education_attained,
    keep_or_other,
    level_index,
    only_levels,
    replace_value,
    worker_group,
)
from fieldtally.functions.scalars import (
    as_number,
    in_range,
    local_time,
    not_in,
    paste,
    percent_text,
    percent_with_count,
    ratio,
    review_link,
    strip_prefix,
)
from fieldtally.functions.text import clean_answer, kept_words, trigrams, words

__all__ = [
    "AGE_BANDS_CHILD_FIRST",
    "AGE_BANDS_HOUSEHOLD",
    "AGE_BANDS_YOUTH",
    "as_number",
    "band",
    "clean_answer",
    "collapse",
    "duration_seconds",
    "education_attained",
    "in_range",
    "keep_or_other",
    "kept_words",
    "level_index",
    "local_time",
    "not_in",
    "only_levels",
    "paste",
    "percent_text",
    "percent_with_count",
    "ratio",
    "replace_value",
    "review_link",
    "strip_prefix",
    "trigrams",
    "words",
    "worker_group",
]
