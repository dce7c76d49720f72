"""Frequencies, cross-tabs and chart frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import percent_text
from fieldtally.operators import monitor, tabulate
from fieldtally.operators.linkage import attach_one
from fieldtally.plans.base import demographics, share6, weighted_heads
from fieldtally.plans.preparation import PRIORITIES
from fieldtally.sources.views import SurveyTables

RESULT_LEVELS = ["Completed", "Partial", "Refused"]
MEMBER_VARIABLES = {
    "sex": "Sex",
    "age_group": "Age",
    "ethnicity_group": "Ethnicity",
    "ed_attainment": "Education",
    "employed": "Employment",
    "workertype_group": "Worker type",
}


# Levels of the variables above: what their code lists and bands have.
MEMBER_LEVELS = {"sex": 2, "age_group": 6, "ethnicity_group": 4, "ed_attainment": 4, "employed": 2, "workertype_group": 4}


def freq_counts(t: SurveyTables) -> DataFrame:
    """Interviews by community and enumeration district."""
    counted = tabulate.frequency(t.households, ["community", "ed"])
    return counted.withColumn("ed", F.col("ed").cast("bigint"))


def weighted_freq(t: SurveyTables) -> DataFrame:
    """Weighted description of household heads: whole counts and percent per variable."""
    table = tabulate.descriptives(
        weighted_heads(t), {**MEMBER_VARIABLES, "community": "Community"}, weight="ind_weight", levels=MEMBER_LEVELS
    )
    return table.select(
        "dimension",
        "item",
        F.bround("n", 0).cast("bigint").alias("count"),
        F.col("n").cast("double").alias("n"),
        percent_text("prop", 1).alias("percent"),
        share6("prop").alias("prop"),
    )


def oneway_table(t: SurveyTables) -> DataFrame:
    """Members by age group, those without an age included."""
    table = tabulate.oneway(demographics(t.roster), "age_group")
    return table.withColumn("prop", share6("prop"))


def descriptives(t: SurveyTables) -> DataFrame:
    """All members by every variable of the report, one pass."""
    table = tabulate.descriptives(demographics(t.roster), MEMBER_VARIABLES, levels=MEMBER_LEVELS)
    return table.select("dimension", "item", "n", "total", percent_text("prop").alias("percent"))


def crosstab(t: SurveyTables) -> DataFrame:
    """Community by result, one column per result, empty cells 0."""
    pairs = tabulate.crosstab(t.households, "community", "result", show_missing=False)
    return tabulate.wide(pairs, ["row"], "col", RESULT_LEVELS, "n", fill=0).withColumnsRenamed({"row": "community"})


def crosstab_margins(t: SurveyTables) -> DataFrame:
    """Community by q1 with both margins and row shares, missing answers included."""
    table = tabulate.with_margins(tabulate.crosstab(t.households, "community", "q1"))
    printed = tabulate.formatted(table, keep_zero=True)
    return printed.select("row", "col", "is_total", "is_total_col", "n", share6("prop").alias("prop"), "cell")


def cell_share(t: SurveyTables) -> DataFrame:
    """Weighted strata by age group, each cell as share of everything."""
    heads = weighted_heads(t)
    table = tabulate.cell_share(heads, "community", "age_group", "ind_weight")
    return table.select("row", "col", F.col("n").cast("double").alias("n"), share6("prop").alias("prop"))


def wide_counts(t: SurveyTables) -> DataFrame:
    """Members per result, one column per age group; no count stays NULL."""
    members = attach_one(
        demographics(t.roster).select("interview_key", "age_group"),
        t.interviews.select("interview_key", "result"),
        ["interview_key"],
    )
    counted = tabulate.frequency(members, ["result", "age_group"])
    return tabulate.wide(counted, ["result"], "age_group", ["0-4", "5-17", "18-34", "35-49", "50+"], "n")


def crosstab_region(t: SurveyTables) -> DataFrame:
    """Community by q1 in order of the district looked up for each; the Total row has none."""
    table = tabulate.with_margins(tabulate.crosstab(t.households.filter("q1 <> '4-NOT SPECIFIED'"), "community", "q1"))
    regions = t.places.filter("community IS NOT NULL").select(F.col("community").alias("row"), "district").distinct()
    placed = attach_one(table, regions, ["row"])
    return (
        tabulate.formatted(placed, keep_zero=True)
        .select("district", "row", "col", "is_total", "is_total_col", "n", share6("prop").alias("prop"), "cell")
        .orderBy(F.asc_nulls_last("district"), "row", "col")
    )


def crosstab_district(t: SurveyTables) -> DataFrame:
    """District by q1, one printed column per answer and the Total."""
    answered = t.households.filter("q1 IS NOT NULL")
    table = tabulate.formatted(
        tabulate.with_margins(tabulate.crosstab(answered, "district", "q1")), keep_zero=True
    )
    printed = tabulate.wide_margins(table, ["row", "is_total"], PRIORITIES, "cell")
    return printed.withColumnsRenamed({"row": "district"})


def crosstab_constituency(t: SurveyTables) -> DataFrame:
    """Community by chosen answers to q1 as printed, with the Total, in order of the district."""
    answered = t.households.filter("q1 IS NOT NULL")
    table = tabulate.formatted(tabulate.with_margins(tabulate.crosstab(answered, "community", "q1")), keep_zero=True)
    printed = tabulate.wide_margins(table, ["row", "is_total"], PRIORITIES[:2], "cell")
    regions = t.places.filter("community IS NOT NULL").select(F.col("community").alias("row"), "district").distinct()
    placed = attach_one(printed, regions, ["row"]).withColumnsRenamed({"row": "community"})
    return placed.orderBy(F.asc_nulls_last("district"), "is_total", "community")


def chart_counts(t: SurveyTables) -> DataFrame:
    """Bars of five charts in one pass."""
    return monitor.chart_counts(
        t.households,
        {
            "by community": (F.col("community"), None),
            "by result": (F.col("result"), None),
            "by answer": (F.col("q2"), None),
            "by interviewer and result": (F.col("responsible"), F.col("result")),
            "by district and answer": (F.col("district"), F.col("q2")),
        },
    )


def chart_shares(t: SurveyTables) -> DataFrame:
    """Filled bars of q1 by district; labels only where the chart shows them."""
    shown = {"AFRICA": ["1-URGENT", "2-HIGH"], "ASIA": ["1-URGENT"], "EUROPE": PRIORITIES}
    table = monitor.chart_shares(t.households.filter("q1 IS NOT NULL"), "district", "q1", shown)
    return table.select("x", "fill", "n", share6("prop").alias("prop"), "label")


def conditional_counts(t: SurveyTables) -> DataFrame:
    """Per community how many interviews are complete, lack a result, answered q2 and said yes."""
    return tabulate.conditional_counts(
        t.households,
        ["community"],
        {
            "completed": F.col("result") == "Completed",
            "no_result": F.col("result").isNull(),
            "answered": F.col("q2").isNotNull(),
            "yes": F.col("q2") == "Yes",
        },
    )


def age_by_sex(t: SurveyTables) -> DataFrame:
    """Members by single year of age and sex."""
    counted = tabulate.frequency(t.roster, ["age", "sex"])
    return counted.withColumns({c: F.col(c).cast("bigint") for c in ("age", "sex")})


QUERIES = [
    freq_counts, weighted_freq, oneway_table, descriptives, crosstab, crosstab_margins, cell_share, wide_counts,
    crosstab_region, crosstab_district, crosstab_constituency, chart_counts, chart_shares, conditional_counts,
    age_by_sex,
]
