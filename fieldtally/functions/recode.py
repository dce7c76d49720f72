"""Derivations of reporting groups from coded answers.

Rules are held as data and evaluated in order, the first that holds wins; each
becomes one branch of a single CASE expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions.scalars import _col, in_range

# Age bands of the household report (first match wins, the last
# two overlap on purpose), of its first draft, and of the youth report.
# (lowest age, highest age or None for open, label)
AGE_BANDS_HOUSEHOLD = [
    (50, None, "50+"),
    (35, 49, "35-49"),
    (18, 34, "18-34"),
    (5, 17, "5-17"),
    (0, 15, "0-4"),
]
AGE_BANDS_CHILD_FIRST = [
    (50, None, "50+"),
    (36, 49, "36-49"),
    (18, 35, "18-35"),
    (5, 17, "5-17"),
    (0, 15, "0-4"),
]
AGE_BANDS_YOUTH = [
    (26, None, "26-29"),
    (22, None, "22-25"),
    (18, None, "18-21"),
    (14, None, "14-17"),
]

# School level codes to attainment, apart for those attending
# now (current level) and those who left (last level).
LEVELS_CURRENT = [
    (0, 8, "None/Some Primary"),
    (9, 12, "Primary"),
    (17, 17, "Secondary"),
    (18, 19, "Tertiary"),
]
LEVELS_LAST = [
    (0, 7, "None/Some Primary"),
    (8, 11, "Primary"),
    (12, 12, "Secondary"),
    (17, 19, "Tertiary"),
]
LEVEL_NEVER_ATTENDED = 21
LEVEL_PRESCHOOL_ONLY = 20
CODE_NOT_STATED = 999999
CODE_OTHER = 888888
EDUCATION_ORDER = [
    "Primary",
    "Secondary",
    "Tertiary",
    "None/Some Primary",
    "Never Attended",
    "Not Stated",
]
# Worker type codes to groups.
WORKER_CODES = [
    (1, 2, "Self Employed"),
    (3, 4, "Employee"),
    (5, CODE_OTHER, "Other"),
    (CODE_NOT_STATED, CODE_NOT_STATED, "Not Stated"),
]
WORKER_ORDER = ["Employee", "Self Employed", "Other", "Not Employed", "Not Stated"]


def first_match(rules: Sequence[tuple[Column, str]], otherwise: Column | str | None = None) -> Column:
    """CASE over (condition, label) pairs."""
    (cond, label), *rest = rules
    out = reduce(lambda acc, r: acc.when(r[0], r[1]), rest, F.when(cond, label))
    if otherwise is None:
        return out
    return out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def band(
    c: Column | str, bands: Sequence[tuple], otherwise: str | None = None, fractional: bool = False
) -> Column:
    """Label of the first band holding the value; NULL (or ``otherwise``) for none."""
    c = _col(c)
    rules = [(c >= low if high is None else in_range(c, low, high, fractional), label) for low, high, label in bands]
    return first_match(rules, otherwise)


def education_attained(
    attending: Column | str, current: Column | str, last: Column | str, by_attendance: bool = True
) -> Column:
    """Highest level attained.

    ``by_attendance`` reads the current level only for those attending (code 1)
    and the last level only for those who left (code 2); otherwise either level
    counts, and whoever is left over is Not Stated and not Other.
    """
    attending, current, last = _col(attending), _col(current), _col(last)
    now = attending == 1 if by_attendance else F.lit(True)
    left = attending == 2 if by_attendance else F.lit(True)
    rules = [(now & in_range(current, lo, hi), label) for lo, hi, label in LEVELS_CURRENT]
    rules += [(left & in_range(last, lo, hi), label) for lo, hi, label in LEVELS_LAST]
    rules += [
        (last == LEVEL_NEVER_ATTENDED, "Never Attended"),
        (last == LEVEL_PRESCHOOL_ONLY, "None/Some Primary"),
        ((last == CODE_NOT_STATED) | (current == CODE_NOT_STATED), "Not Stated"),
        (attending.isNotNull(), "Other" if by_attendance else "Not Stated"),
    ]
    return first_match(rules)


def worker_group(worker_type: Column | str, employed: Column | str | None = None) -> Column:
    """Worker group by type code.

    With ``employed`` only code 2 there makes Not Employed and the rest stay
    NULL; without it everyone lacking a type is Not Employed.
    """
    c = _col(worker_type)
    rules = [(in_range(c, lo, hi), label) for lo, hi, label in WORKER_CODES]
    if employed is None:
        return first_match(rules, "Not Employed")
    return first_match([*rules, (_col(employed) == 2, "Not Employed")])


def keep_or_other(c: Column | str, kept: Sequence[str], other: str = "Other") -> Column:
    """Keep the listed values, call everything else, NULL included, ``other``."""
    c = _col(c)
    return F.when(c.isin(list(kept)), c).otherwise(F.lit(other))


def collapse(c: Column | str, groups: Mapping[str, Sequence[str]]) -> Column:
    """Give every listed old value its new name; the rest keep theirs.

    Covers renaming one level as well as merging several into one.
    """
    c = _col(c)
    return first_match([(c.isin(list(old)), new) for new, old in groups.items()], c)


def replace_value(c: Column | str, old, new) -> Column:
    """Overwrite one value."""
    c = _col(c)
    return F.when(c == old, F.lit(new)).otherwise(c)


def level_index(c: Column | str, levels: Sequence[str]) -> Column:
    """Position of the value in ``levels`` from 1; NULL outside of them."""
    c = _col(c)
    return first_match([(c == level, F.lit(i)) for i, level in enumerate(levels, start=1)])


def only_levels(c: Column | str, levels: Sequence[str]) -> Column:
    """The value where it is one of ``levels``, else NULL."""
    c = _col(c)
    return F.when(c.isin(list(levels)), c)


def duration_seconds(c: Column | str, include_days: bool = True) -> Column:
    """Seconds of a ``dd.hh:mm:ss`` text. Without days the dd part is left out."""
    c = _col(c)

    def part(start: int) -> Column:
        return F.substring(c, start, 2).try_cast("int")

    seconds = part(4) * 3600 + part(7) * 60 + part(10)
    return seconds + part(1) * 86400 if include_days else seconds
