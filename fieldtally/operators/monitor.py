"""Field monitoring: progress against the frame, response, quality lists.

Frame and interviews meet on an address that can repeat on both sides, and a
missing part of the address matches a missing part. Reports that only count
reduce both sides to one row per address first and multiply the counts: the
same numbers as counting the joined rows, without forming them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import percent_text, ratio, review_link
from fieldtally.operators.linkage import attach_many, attach_one
from fieldtally.operators.packing import packed_counts
from fieldtally.operators.tabulate import TOTAL, crosstab, grand_total, with_margins, with_share

COMPLETED = "Completed"


def frame_join(frame: DataFrame, interviews: DataFrame, address: Sequence[str]) -> DataFrame:
    """Every frame row with every interview at its address, NULL parts matching."""
    return attach_many(frame, interviews, address, null_safe=True)


def frame_counts(
    frame: DataFrame,
    interviews: DataFrame,
    address: Sequence[str],
    frame_key: str,
    frame_community: str,
    community: str = "community",
    result: str = "result",
) -> DataFrame:
    """Per community of the frame: (community, sampled, visited, completed, pending).

    ``sampled`` counts frame households once per interview at their address, as
    the joined table would. ``pending`` are joined rows whose interview names
    no community, first of all those without an interview.
    """
    at_address = interviews.groupBy(*address).agg(
        F.count("*").alias("__found"),
        F.count_if(F.col(result) == COMPLETED).alias("__completed"),
        F.count_if(F.col(community).isNull()).alias("__unplaced"),
    )
    listed = frame.groupBy(frame_community, *address).agg(
        F.count("*").alias("__listed"), F.count(frame_key).alias("__keyed")
    )
    met = attach_one(listed, at_address, address, null_safe=True)
    n, found = F.col("__listed"), F.coalesce("__found", F.lit(0))
    return met.groupBy(frame_community).agg(
        F.sum(F.col("__keyed") * F.greatest(found, F.lit(1))).alias("sampled"),
        F.sum(n * found).alias("visited"),
        F.sum(n * F.coalesce("__completed", F.lit(0))).alias("completed"),
        F.sum(n * F.coalesce("__unplaced", F.lit(1))).alias("pending"),
    )


def progress(counts: DataFrame, community: str) -> DataFrame:
    """Sampled, visited and completed households with percentages, and a Total row."""
    both = F.array(
        F.struct(F.col(community).alias("community"), F.lit(False).alias("is_total")),
        F.struct(F.lit(TOTAL).alias("community"), F.lit(True).alias("is_total")),
    )
    sums = ["sampled", "visited", "completed"]
    table = (
        counts.select(F.explode(both).alias("c"), *sums)
        .groupBy("c.community", "c.is_total")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    return table.withColumns(
        {
            "visited_pct": percent_text(ratio("visited", "sampled")),
            "completed_pct": percent_text(ratio("completed", "sampled")),
        }
    )


def kpis(
    interviews: DataFrame, counts: DataFrame, community: str, result: str = "result", partial: str = "Partial"
) -> DataFrame:
    """One row: submitted, completed, partial, response rate, communities started and completed.

    A missing community counts as one community. Interviews are reduced per
    community first, so that one pass gives both counts and communities.
    """
    per_community = interviews.groupBy(community).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(result) == COMPLETED).alias("c"),
        F.count_if(F.col(result) == partial).alias("p"),
    )
    done = counts.agg(F.count_if(F.col("pending") == 0).alias("communities_completed"))
    totals = per_community.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("submitted"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("completed"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("partial"),
        F.count("*").alias("communities_started"),
    )
    rate = ratio(F.col("completed") + F.col("partial"), "submitted")
    return totals.select(
        "submitted",
        "completed",
        "partial",
        F.bround(rate, 2).alias("response_rate"),
        "communities_started",
        done.scalar().alias("communities_completed"),
    )


def submissions(
    frame: DataFrame, interviews: DataFrame, by: Sequence[str], result: str = "result", strict: bool = False
) -> DataFrame:
    """Sampled, submitted and completed counts per area of the frame, and an All row.

    The areas listed are those of the frame; interviews elsewhere are not shown.
    ``strict`` leaves a sum of the All row NULL when an area has no such count.
    """
    sampled = frame.groupBy(*by).agg(F.count("*").alias("sampled"))
    got = interviews.groupBy(*by).agg(
        F.count("*").alias("submitted"),
        # An area without a completed interview has no such row: NULL, not 0.
        F.nullif(F.count_if(F.col(result) == COMPLETED), F.lit(0)).alias("completed"),
    )
    table = attach_one(sampled, got, by, null_safe=True)
    sums = ["sampled", "submitted", "completed"]
    total = grand_total(table, sums, strict)
    labelled = total.select(*[F.lit("All").alias(b) for b in by], *sums, F.lit(True).alias("is_total"))
    texts = table.select(*[F.col(b).cast("string").alias(b) for b in by], *sums, F.lit(False).alias("is_total"))
    share = F.col("completed") / F.col("sampled")
    # The All row prints whole percents, areas one decimal.
    pct = F.when(F.col("is_total"), percent_text(share, 0)).otherwise(percent_text(share, 1))
    return texts.unionByName(labelled).withColumn("completed_pct", pct)


def response_table(interviews: DataFrame, community: str, result: str = "result") -> DataFrame:
    """Community by result with a Total row, row shares and counts."""
    return with_margins(crosstab(interviews, community, result), rows=True, cols=False)


def address_fanout(frame: DataFrame, interviews: DataFrame, address: Sequence[str]) -> DataFrame:
    """Addresses at which ``frame_join`` lists more than one pair: (address..., listed, found, pairs)."""
    listed = frame.groupBy(*address).agg(F.count("*").alias("listed"))
    found = interviews.groupBy(*address).agg(F.count("*").alias("found"))
    met = attach_one(listed, found, address, null_safe=True).na.fill(0, subset=["found"])
    return met.withColumn("pairs", F.col("listed") * F.col("found")).filter("pairs > 1")


def map_status(joined: DataFrame, community: str | None, base_url: str) -> DataFrame:
    """Marker colour and what a marker tells, of every sampled household (of one community)."""
    rows = joined if community is None else joined.filter(F.col("frame_community") == community)
    colour = (
        F.when(F.col("result") == COMPLETED, "green").when(F.col("result").isNotNull(), "orange").otherwise("white")
    )
    link = F.when(F.col("interview_key").isNotNull(), review_link(base_url, "interview_id"))
    return rows.select(
        "frame_id",
        "interview_key",
        "frame_community",
        colour.alias("colour"),
        F.col("frame_head").alias("head"),
        "result",
        link.alias("link"),
    )


def nonrespondents(interviews: DataFrame, columns: Sequence[str], base_url: str) -> DataFrame:
    """Interviews with a result other than Completed; those without a result are another list."""
    return _quality_list(interviews.filter(F.col("result") != COMPLETED), columns, base_url)


def missing_result(interviews: DataFrame, columns: Sequence[str], base_url: str) -> DataFrame:
    """Interviews without a result."""
    return _quality_list(interviews.filter(F.col("result").isNull()), columns, base_url)


def _quality_list(rows: DataFrame, columns: Sequence[str], base_url: str) -> DataFrame:
    return rows.select(*columns, review_link(base_url, "interview_id").alias("link"))


def missing_info(roster: DataFrame, columns: Sequence[str], required: str = "age") -> DataFrame:
    """Roster rows that lack a required answer."""
    return roster.filter(F.col(required).isNull()).select(*columns)


def chart_counts(
    df: DataFrame, charts: Mapping[str, tuple[Column, Column | None]], levels: Mapping[str, Sequence[int]] | None = None
) -> DataFrame:
    """Bar heights of several charts from one pass: (chart, x, fill, n).

    ``charts`` maps a chart name to its x and, if any, its fill or facet column.
    Charts are counted in groups of few combinations (see ``packing``);
    ``levels`` states, by chart, how many levels its columns have.
    """
    units = {name: [x] if fill is None else [x, fill] for name, (x, fill) in charts.items()}
    counts = packed_counts(df, units, F.count("*"), levels)
    return counts.select(F.col("unit").alias("chart"), F.col("level")[0].alias("x"), F.get("level", F.lit(1)).alias("fill"), "n")


def chart_shares(
    df: DataFrame, x: str, fill: str, labelled: Mapping[str, Sequence[str]] | None = None, weight=None
) -> DataFrame:
    """Filled bars: share of every fill within x, with the label to print.

    ``labelled`` names, per x, the fills that get a label; others print nothing.
    """
    counts = df.groupBy(F.col(x).alias("x"), F.col(fill).alias("fill")).agg(
        (F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))).alias("n")
    )
    shares = with_share(counts, ["x"])
    text = F.concat(
        F.regexp_replace((F.bround("prop", 3) * 100).cast("decimal(9,1)").cast("string"), r"\.0$", ""), F.lit("%")
    )
    if labelled is not None:
        shown = F.lit(False)
        for at, fills in labelled.items():
            shown = shown | ((F.col("x") == at) & F.col("fill").isin(list(fills)))
        text = F.when(F.coalesce(shown, F.lit(False)), text).otherwise("")
    return shares.withColumn("label", text)
