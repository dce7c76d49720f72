"""Linking interviews, rosters, weights, frames and paradata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import as_number, duration_seconds
from fieldtally.operators import linkage
from fieldtally.operators.geo import polygon_centroids, refresh_coordinates
from fieldtally.operators.monitor import frame_join as join_frame
from fieldtally.plans import base
from fieldtally.plans.base import share6
from fieldtally.sources.views import SurveyTables

ADDRESS = ["ed", "building_number", "dwelling_number", "household_number"]


def attach_weights(t: SurveyTables) -> DataFrame:
    """Interviews with their weights; partial ones have none."""
    joined = linkage.attach_one(t.interviews.select("interview_key", "result"), t.weights, ["interview_key"])
    return joined.withColumns({c: F.col(c).cast("double") for c in ("hh_weight", "ind_weight")})


def cover_to_roster(t: SurveyTables) -> DataFrame:
    """Cover page by member; households without members keep one row."""
    cover = t.interviews.select("interview_key", "result")
    members = t.roster.select(
        "interview_key", F.col("rel").cast("bigint").alias("rel"), F.col("age").cast("bigint").alias("age")
    )
    t.spread("orders", "lineitem")
    return linkage.attach_many(cover, members, ["interview_key"])


def full_roster(t: SurveyTables) -> DataFrame:
    """All interviews and all members, matched where possible."""
    cover = t.interviews.select("interview_key", "result")
    members = t.roster.select("interview_key", F.col("rel").cast("bigint").alias("rel"))
    t.spread("orders", "lineitem")
    return linkage.full_outer(cover, members, ["interview_key"])


def head_attributes(t: SurveyTables) -> DataFrame:
    """Interviews with the demographics of their heads."""
    heads = linkage.counted(base.survey_of(t).heads)
    met = linkage.attach_one(t.interviews.select("interview_key", "result"), heads, ["interview_key"])
    joined = linkage.repeated(met.na.fill(1, subset=["times"]))
    return joined.withColumns({c: F.col(c).cast("bigint") for c in ("sex", "employed")})


def frame_join(t: SurveyTables) -> DataFrame:
    """Frame rows with the interviews at their address, missing parts matching."""
    visits = t.households.select(*ADDRESS, "interview_key", "interview_id", "result")
    return join_frame(t.frame.select("frame_id", "frame_community", *ADDRESS), visits, ADDRESS).select(
        "frame_id", "frame_community", "interview_key", "interview_id", "result"
    )


def frame_semi(t: SurveyTables) -> DataFrame:
    """Frame households at whose address somebody was interviewed, missing parts matching as in ``frame_join``."""
    frame = t.frame.select("frame_id", "frame_community", "frame_head", *ADDRESS)
    return linkage.keep_matching(frame, t.households, ADDRESS, null_safe=True).select("frame_id", "frame_community", "frame_head")


def refreshed_frame(t: SurveyTables) -> DataFrame:
    """Frame with the coordinates of its buildings put in anew."""
    points = polygon_centroids(t.polygons)
    frame = t.frame.select("frame_id", "frame_community", "lon", "lat")
    fresh = refresh_coordinates(frame, points, "frame_id", "polygon_id")
    return fresh.withColumns({"lon": share6("lon"), "lat": share6("lat")})


def first_completed(t: SurveyTables) -> DataFrame:
    """First completing action per interview."""
    done = t.actions.filter("action = 'Completed'")
    first = linkage.earliest_per_key(done, ["interview_key"], ["date", "action_id"], ["date", "action_id", "amount"])
    return first.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def paradata_link(t: SurveyTables) -> DataFrame:
    """Interviews with duration, interviewer and the time of first completion."""
    diagnostics = t.diagnostics.select(
        "interview_key", "responsible", duration_seconds("duration").cast("bigint").alias("seconds")
    )
    joined = linkage.attach_one(t.interviews.select("interview_key", "result"), diagnostics, ["interview_key"])
    return linkage.attach_one(joined, first_completed(t).select("interview_key", "date"), ["interview_key"])


def duplicate_keys(t: SurveyTables) -> DataFrame:
    """Frame rows that share their address with another, with how many do."""
    return linkage.duplicate_keys(t.frame.select("frame_id", *ADDRESS), ADDRESS).select("frame_id", "dupe_count")


def numeric_ids(t: SurveyTables) -> DataFrame:
    """Numbers held as text: household number out of a name, coordinates of a frame row."""
    return t.frame.select(
        "frame_id",
        as_number(F.substring("frame_head", 10, 9), "bigint").alias("head_number"),
        as_number("frame_head", "bigint").alias("not_a_number"),
        as_number("lat").alias("lat"),
    )


QUERIES = [
    attach_weights, cover_to_roster, full_roster, head_attributes, frame_join, frame_semi, refreshed_frame,
    first_completed, paradata_link, duplicate_keys, numeric_ids,
]
