"""Unweighted respondent survey reported by district and constituency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import AGE_BANDS_YOUTH, as_number, band, collapse, keep_or_other, replace_value
from fieldtally.operators import multiselect, tabulate, text
from fieldtally.operators.linkage import attach_one, drop_listed

MISSING = "missing"


@dataclass
class RespondentSurvey:
    """One row per respondent, answers as labels, ``missing`` being a label of its own.

    ``recodes`` maps a column to the new names of its levels, ``areas`` an area
    to its constituencies, ``ages`` an age to the one it should be.
    """

    base: DataFrame
    key: str = "interview__key"
    district: str = "district"
    constituency: str = "constituency"
    result: str = "HH_FINALRESULT"
    answered: str = "disability"
    youngest: int = 14
    excluded: Sequence[str] | DataFrame = ()
    recodes: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=dict)
    areas: Mapping[str, Sequence[str]] = field(default_factory=dict)
    ages: Mapping[int, int] = field(default_factory=dict)

    @cached_property
    def respondents(self) -> DataFrame:
        """Respondents to report on, with age group and area."""
        kept = drop_listed(self.base, self.key, self.excluded) if self._excludes() else self.base
        kept = kept.withColumn("age", as_number(F.col("age").cast("string"), "int"))
        kept = kept.filter((F.col(self.result) == "Complete") | F.col(self.answered).isNotNull())
        for c in (self.district, self.constituency, "gender"):
            kept = kept.filter(F.col(c) != MISSING)
        kept = kept.filter(F.col("age") >= self.youngest)
        for old, new in self.ages.items():
            kept = kept.withColumn("age", replace_value("age", old, new))
        area = keep_or_other(collapse(self.constituency, self.areas), list(self.areas)) if self.areas else F.lit("Other")
        kept = kept.withColumns({"age_group": band("age", AGE_BANDS_YOUTH, "Missing"), "area": area})
        return kept.withColumns({c: collapse(c, groups) for c, groups in self.recodes.items()})

    def _excludes(self) -> bool:
        return isinstance(self.excluded, DataFrame) or bool(self.excluded)

    def describe(self, variables: Mapping[str, str]) -> DataFrame:
        """Stacked one-way tables."""
        return tabulate.descriptives(self.respondents, variables)

    def by_constituency(self, item: str) -> DataFrame:
        """Constituency by answer with margins and row shares, in order of the district."""
        answered = self.respondents.filter(F.col(item) != MISSING)
        # One pass: the reduced cells give the table and the district of each constituency in it.
        cells = answered.groupBy(
            F.col(self.constituency).cast("string").alias("row"),
            F.col(item).cast("string").alias("col"),
            F.col(self.district).alias("region"),
        ).agg(F.count("*").alias("n"))
        table = tabulate.formatted(tabulate.with_margins(cells.groupBy("row", "col").agg(F.sum("n").alias("n"))), keep_zero=True)
        regions = cells.select("row", "region").distinct()
        return attach_one(table, regions, ["row"]).orderBy(F.asc_nulls_last("region"), "row", "col")

    def by_constituency_printed(self, item: str, answers: Sequence[str]) -> DataFrame:
        """The same as printed, one column per chosen answer and the Total."""
        table = self.by_constituency(item)
        printed = tabulate.wide_margins(table, ["region", "row", "is_total"], answers, "cell")
        return printed.orderBy(F.asc_nulls_last("region"), "row")

    def multi_printed(self, prefix: str, by: Sequence[str]) -> DataFrame:
        """Share of all respondents per option as printed, one column per option."""
        options = self._options(prefix)
        return multiselect.printed_by_region(multiselect.multi_by_region(self.respondents, options, by), by, options)

    def by_district(self, item: str) -> DataFrame:
        """District by answer with margins and row shares."""
        return self._crosstab(self.district, item)

    def _crosstab(self, row: str, item: str) -> DataFrame:
        answered = self.respondents.filter(F.col(item) != MISSING)
        return tabulate.formatted(tabulate.with_margins(tabulate.crosstab(answered, row, item)), keep_zero=True)

    def multi_by_district(self, prefix: str, labels: Mapping[str, str] | None = None) -> DataFrame:
        """Share of all respondents per option, by district and nationwide."""
        table = multiselect.multi_by_region(self.respondents, self._options(prefix), [self.district], "National")
        return multiselect.label_options(table, labels) if labels else table

    def multi_by_constituency(self, prefix: str, labels: Mapping[str, str] | None = None) -> DataFrame:
        """Share of all respondents per option, by district and constituency."""
        by = [self.district, self.constituency]
        table = multiselect.multi_by_region(self.respondents, self._options(prefix), by)
        return multiselect.label_options(table, labels) if labels else table

    def mention_shares(self, prefix: str, by: str) -> DataFrame:
        """Share of each option among all options ticked."""
        return multiselect.banner_multi(
            self.respondents, self._options(prefix), [by], base="mentions", ceil_counts=False
        )

    def _options(self, prefix: str) -> list[str]:
        return multiselect.option_columns(self.respondents, prefix)

    def words(self, column: str, stop_words: DataFrame | Sequence[str], k: int = 100) -> DataFrame:
        """Most frequent words of an open answer."""
        return text.most_common(text.word_counts(self.respondents, column, stop_words), "word", k)

    def triples(self, column: str, k: int = 15) -> DataFrame:
        """Most frequent word triples of an open answer."""
        return text.most_common(text.trigram_counts(self.respondents, column), "words", k)

    def facet_counts(self, *columns: str | Column) -> DataFrame:
        """Bar heights by any columns."""
        return self.respondents.groupBy(*columns).agg(F.count("*").alias("n"))
