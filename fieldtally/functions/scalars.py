"""Scalar helpers whose NULL, rounding and printing rules differ from plain SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_in(c: Column | str, values: Sequence) -> Column:
    """True unless ``c`` is listed. A NULL is not listed, so it is kept."""
    return ~F.coalesce(_col(c).isin(list(values)), F.lit(False))


def in_range(c: Column | str, low: int, high: int, fractional: bool = False) -> Column:
    """Membership of the whole numbers low..high.

    For a column that can hold fractions say so: 17.5 is then in neither 5..17
    nor 18..34. Whole-number columns spare the test.
    """
    c = _col(c)
    within = c.between(low, high)
    return within & (c == F.floor(c)) if fractional else within


def as_number(c: Column | str, to: str = "double") -> Column:
    """Number held as text; text that is no number becomes NULL instead of an error."""
    return _col(c).try_cast(to)


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as a double, NULL when the whole is zero."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def percent_text(share: Column | str, digits: int = 1, keep_zero: bool = False) -> Column:
    """Share 0.511 as ``51.1%``, half-even. ``50.0`` prints ``50%`` unless ``keep_zero``."""
    scaled = F.bround(_col(share) * 100, digits)
    text = scaled.cast(f"decimal(18,{digits})").cast("string")
    if digits and not keep_zero:
        text = F.regexp_replace(text, r"\.?0+$", "") if digits > 1 else F.regexp_replace(text, r"\.0$", "")
    return F.concat(text, F.lit("%"))


def percent_with_count(
    share: Column | str, n: Column | str, digits: int = 1, gap: str = " ", keep_zero: bool = False
) -> Column:
    """``51.1% (294)``; the count is rounded up to a whole number first."""
    count = F.ceil(_col(n)).cast("bigint").cast("string")
    return F.concat(percent_text(share, digits, keep_zero), F.lit(f"{gap}("), count, F.lit(")"))


def paste(*parts: Column | str, missing: str = "NA") -> Column:
    """Concatenate text; a NULL part prints as ``missing`` and does not blank the result."""
    return F.concat(*[F.coalesce(_col(p).cast("string"), F.lit(missing)) for p in parts])


def strip_prefix(c: Column | str, prefix: str) -> Column:
    """Remove ``prefix`` at the start of the value only."""
    return F.regexp_replace(_col(c), "^" + re.escape(prefix), "")


def review_link(base_url: str, interview_id: Column | str) -> Column:
    """Link to an interview's review page; NULL without an interview."""
    return F.concat(F.lit(base_url.rstrip("/") + "/"), _col(interview_id).cast("string"))


def local_time(utc: Column | str, zone: str) -> Column:
    """UTC timestamp as wall-clock time of ``zone``."""
    return F.from_utc_timestamp(_col(utc), zone)
