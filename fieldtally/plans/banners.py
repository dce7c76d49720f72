"""Banner tables, multi-select questions and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import keep_or_other, percent_text, percent_with_count, strip_prefix
from fieldtally.operators import banner, multiselect, rating
from fieldtally.operators.tabulate import wide
from fieldtally.operators.weights import copies, times
from fieldtally.plans.base import DIMENSIONS, counted_base, rating_base, share6
from fieldtally.plans.preparation import PRIORITIES
from fieldtally.sources.views import CONCERN_LEVELS, CONCERNS, OPTIONS, SurveyTables

# All answers of the questions of the report.
LEVELS = {"q1": PRIORITIES, "q2": ["Yes", "No", "DK"], **{c: [*CONCERN_LEVELS, "Not stated"] for c in CONCERNS}}
OPTION_LABELS = {"m__1": "Report", "m__2": "Scare", "m__3": "Hunt", "m__4": "No action", "m__5": "Other"}


def _numbers(table: DataFrame, *names: str) -> DataFrame:
    out = table.withColumn("prop", share6("prop"))
    return out.withColumns({c: F.col(c).cast("double") for c in names})


def banner_single(t: SurveyTables) -> DataFrame:
    """Weighted answers to q1 by five demographics and in total."""
    table = banner.banner(counted_base(t), "q1", DIMENSIONS, "ind_weight", times="times")
    return _numbers(table, "n", "total").drop("question")


def banner_missing(t: SurveyTables) -> DataFrame:
    """The same with missing answers as an answer of their own."""
    table = banner.banner(counted_base(t), "q2", DIMENSIONS, "ind_weight", drop_null_answer=False, times="times")
    return _numbers(table, "n", "total").drop("question")


def banner_report(t: SurveyTables) -> DataFrame:
    """All single-answer questions of the report from one pass over the interviews."""
    table = banner.banner(counted_base(t), list(LEVELS), DIMENSIONS, "ind_weight", times="times", levels=LEVELS)
    return _numbers(table, "n", "total")


def banner_unweighted(t: SurveyTables) -> DataFrame:
    """Unweighted answers with counts, printed; heads lacking a demographic are not shown under it."""
    table = banner.banner(counted_base(t, weighted=False), "q1", DIMENSIONS, drop_null_item=True, times="times")
    printed = table.withColumn("cell", percent_with_count("prop", "n", keep_zero=True))
    return _numbers(printed).drop("question")


def banner_printed(t: SurveyTables) -> DataFrame:
    """Banner as printed: percentages by item, count added in the Total row, blanks filled."""
    table = banner.banner(counted_base(t), "q1", DIMENSIONS, "ind_weight", times="times")
    return banner.banner_wide(table, PRIORITIES, percent_text("prop"), percent_with_count("prop", "n"))


def banner_multi(t: SurveyTables) -> DataFrame:
    """Weighted multi-select table, share of those who answered, counts rounded up."""
    table = multiselect.banner_multi(counted_base(t), OPTIONS, DIMENSIONS, "ind_weight", times="times")
    return _numbers(table, "selected", "total")


def multi_printed(t: SurveyTables) -> DataFrame:
    """The same printed, one column per option."""
    table = multiselect.banner_multi(counted_base(t), OPTIONS, DIMENSIONS, "ind_weight", times="times")
    cells = table.select(
        "dimension",
        "item",
        strip_prefix("option", "m__").alias("option"),
        percent_with_count("prop", "selected", gap="").alias("cell"),
    )
    codes = [o.removeprefix("m__") for o in OPTIONS]
    spread = wide(cells, ["dimension", "item"], "option", codes, "cell")
    return spread.withColumnsRenamed({c: f"option_{c}" for c in codes})


def multi_unweighted(t: SurveyTables) -> DataFrame:
    """Unweighted: selected over answered."""
    table = multiselect.banner_multi(counted_base(t, weighted=False), OPTIONS, DIMENSIONS, ceil_counts=False, times="times")
    return _numbers(table, "selected", "total")


def multi_mention_share(t: SurveyTables) -> DataFrame:
    """Share of each option among all options ticked."""
    table = multiselect.banner_multi(t.households, OPTIONS, ["district"], base="mentions", ceil_counts=False)
    return _numbers(table, "selected", "total")


def multi_mentions(t: SurveyTables) -> DataFrame:
    """How often options were ticked by strata, and all options together."""
    options = multiselect.option_columns(t.households, "m")
    return multiselect.mentions(t.households, options, "strata")


def multiselect_region(t: SurveyTables) -> DataFrame:
    """Share of all respondents choosing each option by district and overall."""
    table = multiselect.multi_by_region(t.households, OPTIONS, ["district"], overall="National")
    return _numbers(table).drop("is_overall")


def multiselect_constituency(t: SurveyTables) -> DataFrame:
    """The same by district and community."""
    return _numbers(multiselect.multi_by_region(t.households, OPTIONS, ["district", "community"]))


def region_printed(t: SurveyTables) -> DataFrame:
    """Multi-select shares by district and nationwide as printed, one column per option."""
    table = multiselect.multi_by_region(t.households, OPTIONS, ["district"], overall="National")
    return multiselect.printed_by_region(table, ["district", "is_overall"], OPTIONS)


def constituency_printed(t: SurveyTables) -> DataFrame:
    """The same by district and community."""
    by = ["district", "community"]
    return multiselect.printed_by_region(multiselect.multi_by_region(t.households, OPTIONS, by), by, OPTIONS)


def multi_item_share(t: SurveyTables) -> DataFrame:
    """Yes and No share per option among weighted respondents, options by name."""
    base = counted_base(t).filter("ind_weight IS NOT NULL")
    table = multiselect.item_shares(base, OPTIONS, OPTION_LABELS, copies("ind_weight") * F.col("times"))
    return table.select("item", "value", "n", share6("prop").alias("prop"))


def yes_share(t: SurveyTables) -> DataFrame:
    """Yes against No or don't know, weighted, by strata and in total."""
    heard = counted_base(t).withColumns(
        {"heard": keep_or_other("q2", ["Yes"], "No or DK"), "copies": copies("ind_weight") * F.col("times")}
    )
    table = banner.banner(heard, "heard", ["strata"], "copies")
    return table.select("dimension", "item", "answer", "n", "total", share6("prop").alias("prop"))


def _rated_weight() -> Column:
    """Weight of all the pairs a row of the rating base stands for."""
    return times("ind_weight", "times")


def rating_distribution(t: SurveyTables) -> DataFrame:
    """Ratings of every item by demographics, counts rounded up first, missing in the total."""
    table = rating.distribution(rating_base(t), "rated_item", "rate", DIMENSIONS, _rated_weight())
    return _numbers(table, "n", "total").withColumns(
        {c: F.col(c).cast("bigint") for c in ("rated", "answer")}
    )


def rating_wide(t: SurveyTables) -> DataFrame:
    """The same printed, one column per point of the scale."""
    table = rating.distribution(rating_base(t), "rated_item", "rate", DIMENSIONS, _rated_weight())
    printed = table.withColumn("cell", percent_with_count("prop", "n"))
    spread = rating.distribution_wide(printed, "cell").na.fill("0% (0)", subset=["1", "2", "3", "4", "5"])
    return spread.withColumn("rated", F.col("rated").cast("bigint")).withColumnsRenamed(
        {str(p): f"rate_{p}" for p in rating.SCALE}
    )


def rating_means(t: SurveyTables) -> DataFrame:
    """Weighted mean rating by demographics and item."""
    table = rating.means(rating_base(t), "rated_item", "rate", DIMENSIONS, _rated_weight())
    return table.select(F.col("rated").cast("bigint").alias("rated"), "dimension", "item", share6("mean").alias("mean"))


def rating_means_wide(t: SurveyTables) -> DataFrame:
    """Weighted mean rating to two digits as printed, one column per item, blanks as ``0% (0)``."""
    table = rating.means(rating_base(t), "rated_item", "rate", DIMENSIONS, _rated_weight())
    items = [str(i) for i in range(1, 8)]
    rounded = table.select(
        "dimension", "item", F.col("rated").cast("string").alias("rated"), F.format_string("%.2f", F.bround("mean", 2)).alias("mean")
    )
    spread = wide(rounded, ["dimension", "item"], "rated", items, "mean").na.fill("0% (0)", subset=items)
    return spread.withColumnsRenamed({i: f"item_{i}" for i in items})


def weighted_mean(t: SurveyTables) -> DataFrame:
    """Weighted mean rating per item."""
    table = rating.weighted_mean(rating_base(t), ["rated_item"], "rate", _rated_weight())
    return table.select(F.col("rated_item").cast("bigint").alias("rated_item"), F.bround("mean", 2).alias("mean"))


def likert_summary(t: SurveyTables) -> DataFrame:
    """Share of every rating per item and strata among weighted respondents."""
    weight = copies("ind_weight") * F.col("times")
    table = rating.likert(rating_base(t), "rated_item", "rate", "strata", weight)
    return _numbers(table).withColumns({c: F.col(c).cast("bigint") for c in ("rated", "level")})


def likert_overall(t: SurveyTables) -> DataFrame:
    """Concern items: share of each level among weighted complete cases."""
    complete = counted_base(t)
    for c in CONCERNS:
        complete = complete.filter(F.col(c) != "Not stated")
    kept = complete.withColumn("copies", copies("ind_weight") * F.col("times")).select("copies", *CONCERNS)
    long = kept.unpivot(["copies"], CONCERNS, "concern", "level")
    return _numbers(rating.likert(long, "concern", "level", weight="copies"))


def likert_items(t: SurveyTables) -> DataFrame:
    """Counts and shares of the five points per item, most positive first."""
    table = rating.scale_table(t.ratings, "rated_item", "rate")
    shares = [f"{n.lower()}_share" for n in rating.SCALE_NAMES]
    return table.withColumns({c: share6(c) for c in [*shares, "positive_share"]}).withColumn(
        "rated", F.col("rated").cast("bigint")
    )


QUERIES = [
    banner_single, banner_missing, banner_report, banner_unweighted, banner_printed, banner_multi,
    multi_printed, multi_unweighted, multi_mention_share, multi_mentions, multiselect_region,
    multiselect_constituency, region_printed, constituency_printed, multi_item_share, yes_share, rating_distribution, rating_wide, rating_means,
    rating_means_wide, weighted_mean, likert_summary, likert_overall, likert_items,
]
