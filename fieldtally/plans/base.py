"""The household survey over a folder of tables, and tables several queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.linkage import repeated
from fieldtally.plans.household import DIMENSIONS, HouseholdSurvey, demographics
from fieldtally.sources.views import SurveyTables

__all__ = ["DIMENSIONS", "analysis_base", "counted_base", "demographics", "rating_base", "share6", "survey_of", "weighted_heads"]


def share6(c: str | Column) -> Column:
    """A share rounded for comparison between engines."""
    return F.bround((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def survey_of(t: SurveyTables, placed: bool = False) -> HouseholdSurvey:
    """The folder's interviews, rosters and weights as one survey; ``placed`` interviews have their place."""
    return HouseholdSurvey(
        t.households if placed else t.interviews,
        t.roster,
        t.ratings,
        t.weights,
        key="interview_key",
        result="result_code",
        weight="ind_weight",
        rated_item="rated_item",
        rate="rate",
    )


def analysis_base(t: SurveyTables, weighted: bool = True) -> DataFrame:
    """Completed interviews with head demographics, weights if wanted, and place.

    The place is looked up by address first, on the interviews alone; heads,
    weights and whatever follows then meet on the interview key in one
    partitioning. Only at the end equal heads become rows.
    """
    return repeated(counted_base(t, weighted))


def counted_base(t: SurveyTables, weighted: bool = True) -> DataFrame:
    """The same before equal heads become rows: a row stands for ``times`` of them."""
    survey = survey_of(t, placed=True)
    return survey.weighted if weighted else survey.linked


def rating_base(t: SurveyTables) -> DataFrame:
    """Ratings of completed interviews with the same demographics and weights."""
    wanted = ["interview_key", *DIMENSIONS, "ind_weight", "times"]
    return survey_of(t).rated_by(counted_base(t).select(*wanted))


def weighted_heads(t: SurveyTables) -> DataFrame:
    """Heads of completed interviews with weights and community."""
    return survey_of(t, placed=True).weighted_heads("community")
