"""Household survey with head demographics and weights: tables ready to tabulate and the report's tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import (
    AGE_BANDS_HOUSEHOLD,
    band,
    collapse,
    education_attained,
    keep_or_other,
    only_levels,
    percent_text,
    percent_with_count,
    worker_group,
)
from fieldtally.functions.recode import EDUCATION_ORDER
from fieldtally.operators import monitor, multiselect, rating, tabulate
from fieldtally.operators.banner import banner, banner_wide
from fieldtally.operators.linkage import (
    attach_many,
    attach_matching,
    attach_one,
    counted,
    drop_listed,
    heads_of,
    repeated,
)
from fieldtally.operators.weights import copies, times
from fieldtally.session import settle

DIMENSIONS = ["strata", "age_group", "ethnicity", "education", "workertype_group"]
HEAD_COLUMNS = ["sex", "age_group", "ethnicity_group", "ed_attainment", "employed", "workertype_group"]

# Ethnic groups reported on their own for members and in banners.
MEMBER_GROUPS = ["Mestizo/Hispanic/Latino", "Creole", "Mennonite"]
BANNER_GROUPS = ["Creole", "Mestizo/Hispanic/Latino"]


def demographics(
    members: DataFrame, age_bands: Sequence[tuple] = AGE_BANDS_HOUSEHOLD, groups: Sequence[str] = MEMBER_GROUPS
) -> DataFrame:
    """Roster with the derived reporting groups of every member."""
    attained = education_attained("ed_attending", "ed_clevel", "ed_llevel")
    return members.withColumns(
        {
            "age_group": band("age", age_bands),
            "ethnicity_group": keep_or_other("ethnicity", groups),
            "ed_attainment": only_levels(attained, EDUCATION_ORDER),
            "workertype_group": worker_group("workertype", "employed"),
        }
    )


def with_reporting_groups(df: DataFrame, groups: Sequence[str] = BANNER_GROUPS) -> DataFrame:
    """The shorter education and ethnicity groups banners use."""
    education = collapse("ed_attainment", {"Secondary or Higher": ["Secondary", "Tertiary"]})
    return df.withColumns(
        {
            "education": keep_or_other(education, ["Primary", "Secondary or Higher"]),
            "ethnicity": keep_or_other("ethnicity_group", groups),
        }
    )


@dataclass
class HouseholdSurvey:
    """Interviews, members, ratings and weights of one survey.

    ``strata`` maps a stratum to its communities, everything else being
    ``other_stratum``; leave it empty when the interviews carry a stratum.
    ``unique_heads`` states that no interview has two heads, which spares
    counting equal ones.
    """

    base: DataFrame
    members: DataFrame
    ratings: DataFrame
    weights: DataFrame
    key: str = "interview__key"
    community: str = "ctv"
    result: str = "result"
    completed_code: int = 1
    weight: str = "ind_weights"
    rated_item: str = "k2_roster__id"
    rate: str = "k2_rate"
    excluded: Sequence[str] | DataFrame = ()
    strata: Mapping[str, Sequence[str]] = field(default_factory=dict)
    other_stratum: str = "Other"
    dimensions: Sequence[str] = tuple(DIMENSIONS)
    unique_heads: bool = False

    @cached_property
    def interviews(self) -> DataFrame:
        """All interviews but the excluded ones, with their stratum."""
        kept = self.base
        if isinstance(self.excluded, DataFrame) or self.excluded:
            kept = drop_listed(kept, self.key, self.excluded)
        if not self.strata:
            return kept
        named = keep_or_other(collapse(self.community, self.strata), list(self.strata), self.other_stratum)
        return kept.withColumn("strata", named)

    @cached_property
    def completed(self) -> DataFrame:
        return self.interviews.filter(F.col(self.result) == self.completed_code)

    def _cover(self, *columns: str) -> DataFrame:
        return self.completed.select(self.key, *columns)

    def all_members(self, *cover: str) -> DataFrame:
        """Members of completed interviews with the named cover columns; empty households keep a row."""
        return attach_many(self._cover(*cover), demographics(self.members), [self.key])

    @cached_property
    def heads(self) -> DataFrame:
        """Demographics of heads, one row per head."""
        return heads_of(demographics(self.members), [self.key, *HEAD_COLUMNS])

    def weighted_heads(self, *cover: str) -> DataFrame:
        """Heads of completed interviews with weights and the named cover columns."""
        return attach_one(attach_matching(self.heads, self._cover(*cover), [self.key]), self.weights, [self.key])

    @cached_property
    def linked(self) -> DataFrame:
        """Completed interviews with head demographics and reporting groups; a row stands for ``times`` equal heads.

        Equal heads are counted before they are shuffled, so an interview has
        no more rows than it has different heads, and one left join links both
        tables in one reading of each. An interview without a head counts once.
        """
        heads = self.heads.withColumn("times", F.lit(1).cast("bigint")) if self.unique_heads else counted(self.heads)
        met = attach_one(self.completed, heads, [self.key]).na.fill(1, subset=["times"])
        return with_reporting_groups(met)

    @cached_property
    def weighted(self) -> DataFrame:
        """The same with weights."""
        return attach_one(self.linked, self.weights, [self.key])

    @cached_property
    def described(self) -> DataFrame:
        """Completed interviews with head demographics and reporting groups, a row per head, without weights."""
        return repeated(self.linked)

    @cached_property
    def households(self) -> DataFrame:
        """The same with weights."""
        return repeated(self.weighted)

    def rated_by(self, households: DataFrame) -> DataFrame:
        """Ratings with the columns of the given households, which have a column ``times``.

        Every rating meets every different head of its household once; a row
        stands for ``times`` pairs of the rating and a head.
        """
        ratings = self.ratings.select(self.key, self.rated_item, self.rate)
        return attach_matching(ratings, households, [self.key])

    @cached_property
    def rated(self) -> DataFrame:
        """Ratings of completed interviews with demographics and weights."""
        carried = [*self.dimensions, "times", *[c for c in self.weights.columns if c != self.key]]
        return self.rated_by(self.weighted.select(self.key, *carried))

    def stored(self) -> HouseholdSurvey:
        """Write the linked tables to the shared folder once; every table made after that only scans them.

        Worth it for a report of many tables. Without it each table links anew.
        """
        self.weighted = settle(self.weighted, "households")
        self.linked = self.weighted
        self.households = repeated(self.weighted)
        self.described = self.households
        self.rated = settle(self.rated, "ratings")
        return self

    @property
    def _rated_weight(self) -> Column:
        return times(self.weight, "times")

    @property
    def _copies(self) -> Column:
        """Whole copies all the equal heads of a row stand for."""
        return copies(self.weight) * F.col("times")

    # Tables of the report.

    def single(self, *questions: str, weighted: bool = True, **options) -> DataFrame:
        """Banner of one or more single-answer questions."""
        rows = self.weighted if weighted else self.linked
        return banner(rows, questions, self.dimensions, self.weight if weighted else None, times="times", **options)

    def single_printed(self, question: str, answers: Sequence[str]) -> DataFrame:
        """Banner of one question as printed."""
        total = percent_with_count("prop", "n")
        return banner_wide(self.single(question), answers, percent_text("prop"), total)

    def multi(self, prefix: str, weighted: bool = True, **options) -> DataFrame:
        """Banner of a multi-select question by its column prefix."""
        rows = self.weighted if weighted else self.linked
        columns = multiselect.option_columns(rows, prefix)
        return multiselect.banner_multi(rows, columns, self.dimensions, self.weight if weighted else None, times="times", **options)

    def item_shares(self, labels: Mapping[str, str]) -> DataFrame:
        """Yes and No per option of a multi-select question, options named by ``labels``."""
        weighted = self.weighted.filter(F.col(self.weight).isNotNull())
        return multiselect.item_shares(weighted, list(labels), labels, self._copies)

    def rating_table(self) -> DataFrame:
        """Distribution of every rated item."""
        return rating.distribution(self.rated, self.rated_item, self.rate, self.dimensions, self._rated_weight)

    def rating_means(self) -> DataFrame:
        """Weighted mean of every rated item."""
        return rating.means(self.rated, self.rated_item, self.rate, self.dimensions, self._rated_weight)

    def likert(self, group: str | None = None) -> DataFrame:
        """Share of every rating per item, overall or by one demographic."""
        return rating.likert(self.rated, self.rated_item, self.rate, group, self._copies)

    def item_likert(self, items: Mapping[str, str], not_stated: str, group: str | None = None) -> DataFrame:
        """Likert table of question columns (named by ``items``) over interviews that stated all of them."""
        stated = self.weighted
        for c in items:
            stated = stated.filter(F.col(c) != not_stated)
        keep = [group] if group else []
        wide = stated.select(*keep, self._copies.alias("copies"), *[F.col(c).alias(n) for c, n in items.items()])
        long = wide.unpivot([*keep, "copies"], list(items.values()), "concern", "level")
        return rating.likert(long, "concern", "level", group, "copies")

    def share_of(self, question: str, answer: str, rest: str = "No or DK", asked: Column | None = None) -> DataFrame:
        """One answer against all others, a missing answer among them, weighted."""
        rows = self.weighted if asked is None else self.weighted.filter(asked)
        rows = rows.withColumns({"__answer": keep_or_other(question, [answer], rest), "__copies": self._copies})
        return banner(rows, "__answer", [], "__copies").select("answer", "n", "total", "prop")

    def describe_members(self, variables: Mapping[str, str], *cover: str, levels: Mapping[str, int] | None = None) -> DataFrame:
        """Stacked one-way tables of all members."""
        return tabulate.descriptives(self.all_members(*cover), variables, levels=levels)

    def describe_heads(self, variables: Mapping[str, str], *cover: str, levels: Mapping[str, int] | None = None) -> DataFrame:
        """Stacked weighted one-way tables of heads."""
        return tabulate.descriptives(self.weighted_heads(*cover), variables, self.weight, levels)

    def submissions(self, frame: DataFrame, by: Sequence[str], strict: bool = False) -> DataFrame:
        """Sampled, submitted and completed interviews per area."""
        named = self.interviews.withColumn(
            "__result", F.when(F.col(self.result) == self.completed_code, monitor.COMPLETED)
        )
        return monitor.submissions(frame, named, by, "__result", strict)
