"""Reading, filtering, recoding and exporting survey tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions import (
    AGE_BANDS_CHILD_FIRST,
    AGE_BANDS_HOUSEHOLD,
    AGE_BANDS_YOUTH,
    band,
    collapse,
    education_attained,
    keep_or_other,
    level_index,
    not_in,
    only_levels,
    replace_value,
    worker_group,
)
from fieldtally.operators.codebook import codebook, decode, label_of, observed_levels
from fieldtally.operators.linkage import attach_matching, attach_one, drop_listed, repeated
from fieldtally.operators.privacy import anonymise
from fieldtally.operators.tabulate import frequency
from fieldtally.plans.base import analysis_base, counted_base, survey_of
from fieldtally.session import scratch_path
from fieldtally.sources import published, readers, writers
from fieldtally.sources.views import CONCERNS, OPTIONS, RESULTS, SurveyTables

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def scan_survey(t: SurveyTables) -> DataFrame:
    """Interviews with answers decoded, three columns of the base table read."""
    return t.interviews.select(
        "interview_key", "interview_id", "result_code", label_of("result_code", RESULTS).alias("result"), "q1", "q2"
    )


def scan_weights(t: SurveyTables) -> DataFrame:
    """Weights through the CSV source: written as delivered, read with their schema."""
    path = scratch_path(t.spark, "weights")
    writers.write_delimited(t.weights, path)
    weights = readers.read_weights(t.spark, path, t.weights.schema)
    return weights.select(
        "interview_key", F.col("hh_weight").cast("double"), F.col("ind_weight").cast("double")
    )


def assignment_list(t: SurveyTables) -> DataFrame:
    """Assignments of interviewers through the tab-separated sink and source."""
    rows = t.households.select(
        "ed", "building_number", "dwelling_number", "household_number", "head_name", "responsible", "interview_key"
    )
    path = scratch_path(t.spark, "assignments")
    writers.write_tsv(rows, path)
    return readers.read_assignments(t.spark, path, rows.schema)


def sample_frame(t: SurveyTables) -> DataFrame:
    """Sample frame with coordinates as numbers, unreadable ones NULL."""
    columns = ["frame_id", "ed", "frame_head", "frame_community", "household_number", "lat", "lon"]
    return readers.as_frame(t.frame, columns)


def cover_vars(t: SurveyTables) -> DataFrame:
    """Cover page of every interview, renamed for linking."""
    return t.households.select(
        "interview_key", "community", "strata", "ed", "building_number", "household_number", "dwelling_number", "result"
    ).withColumnsRenamed({"community": "ctv"})


def exclude_keys(t: SurveyTables) -> DataFrame:
    """Interviews outside two test communities; those without a community stay.

    Interviews of the interviewers on a list kept as a table are left out too.
    """
    trainees = t.spark.createDataFrame([("interviewer3",), ("interviewer5",)], "name string")
    kept = drop_listed(t.households, "community", ["NATION_3", "NATION_7"])
    return drop_listed(kept, "responsible", trainees, "name").select("interview_key", "community", "responsible")


def eligible_respondents(t: SurveyTables) -> DataFrame:
    """Members of 14 or older in interviews that are complete or answered q2, place known."""
    answered = t.households.filter(
        ((F.col("result") == "Completed") | F.col("q2").isNotNull())
        & F.col("district").isNotNull()
        & (F.col("community") != "NATION_0")
    ).select("interview_key", "district", "community")
    members = t.roster.filter("age >= 14").select("interview_key", "rel", "age")
    return attach_matching(members, answered, ["interview_key"])


def complete_cases(t: SurveyTables) -> DataFrame:
    """Interviews that answered every concern item and have no gap in q1."""
    stated = t.interviews.dropna(subset=["q1"])
    for c in CONCERNS:
        stated = stated.filter(F.col(c) != "Not stated")
    return stated.select("interview_key", *CONCERNS)


def age_bands(t: SurveyTables) -> DataFrame:
    """Every age with its band under the three variants, and how many have it."""
    ages = t.roster.select(replace_value("age", 33, 29).alias("age"))
    banded = ages.select(
        F.col("age").cast("bigint").alias("age"),
        band("age", AGE_BANDS_HOUSEHOLD).alias("household_band"),
        band("age", AGE_BANDS_CHILD_FIRST).alias("draft_band"),
        band("age", AGE_BANDS_YOUTH, "Missing").alias("youth_band"),
    )
    return frequency(banded, ["age", "household_band", "draft_band", "youth_band"])


def derive_education(t: SurveyTables) -> DataFrame:
    """Attainment under both rules for each combination of school codes."""
    codes = ["ed_attending", "ed_clevel", "ed_llevel"]
    derived = t.roster.select(
        *[F.col(c).cast("bigint").alias(c) for c in codes],
        education_attained(*codes).alias("attained"),
        education_attained(*codes, by_attendance=False).alias("attained_head"),
    )
    return frequency(derived, [*codes, "attained", "attained_head"])


def derive_worker(t: SurveyTables) -> DataFrame:
    """Worker group under both rules for each combination of codes."""
    derived = t.roster.select(
        F.col("workertype").cast("bigint").alias("workertype"),
        F.col("employed").cast("bigint").alias("employed"),
        worker_group("workertype", "employed").alias("worker"),
        worker_group("workertype").alias("worker_head"),
    )
    return frequency(derived, ["workertype", "employed", "worker", "worker_head"])


def lump_other(t: SurveyTables) -> DataFrame:
    """Communities and ethnic groups reduced to the reported ones and Other."""
    lumped = t.households.select(
        keep_or_other("community", ["NATION_1", "NATION_2", "NATION_5"]).alias("community_group"),
        keep_or_other("segment", ["BUILDING", "MACHINERY"]).alias("segment_group"),
    )
    return frequency(lumped, ["community_group", "segment_group"])


def standardise_names(t: SurveyTables) -> DataFrame:
    """Frame communities under the names the survey uses."""
    names = {"Lower/New/East": ["NATION_4"], "Progress/Upper": ["NATION_9"]}
    return frequency(t.frame.select(collapse("frame_community", names).alias("community"), "ed"), ["community", "ed"])


def decode_labels(t: SurveyTables) -> DataFrame:
    """Result and district codes of every interview decoded from a codebook table."""
    results = codebook(t.spark, {"result_code": RESULTS})
    eds = t.raw("nation").selectExpr(
        "'ed' AS variable", "CAST(n_nationkey AS BIGINT) AS code", "n_name AS label", "n_nationkey + 1 AS level_order"
    )
    rows = t.households.select("interview_key", "result_code", "ed")
    decoded = decode(rows, results.unionByName(eds), ["result_code", "ed"])
    return decoded.select(
        "interview_key",
        "result_code_label",
        F.col("result_code_order").cast("bigint").alias("result_code_order"),
        "ed_label",
        F.col("ed_order").cast("bigint").alias("ed_order"),
    )


def recode_levels(t: SurveyTables) -> DataFrame:
    """Priorities merged into two groups, one renamed, one left as it is."""
    groups = {"High": ["1-URGENT", "2-HIGH"], "Low": ["5-LOW"], "Unspecified": ["4-NOT SPECIFIED"]}
    return frequency(t.interviews.select("q1", collapse("q1", groups).alias("q1_group")), ["q1", "q1_group"])


def ordered_levels(t: SurveyTables) -> DataFrame:
    """Levels in report order; values outside of the levels become NULL."""
    levels = list(reversed(PRIORITIES[:4]))
    counted = frequency(t.interviews.select(only_levels("q1", levels).alias("level")), ["level"])
    ordered = counted.withColumn("level_order", level_index("level", levels).cast("bigint"))
    return ordered.orderBy(F.asc_nulls_last("level_order"))


def unused_levels(t: SurveyTables) -> DataFrame:
    """Codebook entries that occur in the data, for three variables at once."""
    book = codebook(
        t.spark,
        {
            "result_code": {**RESULTS, 4: "Not at home"},
            "round_code": {i: p for i, p in enumerate([*PRIORITIES, "6-NEVER"], start=1)},
            "ticked": {0: "No", 1: "Yes", 999999: "Not Stated"},
        },
    )
    rows = t.interviews.select(
        "result_code", F.substring("round", 1, 1).cast("bigint").alias("round_code"), F.col("m__1").alias("ticked")
    )
    return observed_levels(rows, book, ["result_code", "round_code", "ticked"]).select(
        "variable", "code", "label", F.col("level_order").cast("bigint").alias("level_order")
    )


def anonymised_export(t: SurveyTables) -> DataFrame:
    """Micro-data without identifiers, written by the export sink and read back."""
    allowed = [
        "interview_key", "community", "strata", "sex", "age_group", "ethnicity_group", "ed_attainment", "employed",
        "workertype_group", "education", "ethnicity", "q1", "q2", *OPTIONS, "ind_weight",
    ]
    base = analysis_base(t).filter("ind_weight IS NOT NULL")
    path = scratch_path(t.spark, "export")
    exported = anonymise(base, allowed, {"ind_weight": "weight", "community": "ctv"})
    writers.export_dataset(exported, path)
    back = readers.read_dataset(t.spark, path, schema=exported.schema)
    return back.withColumns({c: F.col(c).cast("bigint") for c in ["sex", "employed", *OPTIONS]}).withColumn(
        "weight", F.col("weight").cast("double")
    )


def anonymised_ratings(t: SurveyTables) -> DataFrame:
    """Ratings with demographics and weight but without identifiers, written by the export sink and read back."""
    columns = [
        "rated_item", "rate", "interview_key", "community", "strata", "sex", "age_group", "ethnicity", "ethnicity_group",
        "education", "ed_attainment", "employed", "workertype_group", "ind_weight",
    ]
    carried = [c for c in columns if c not in ("rated_item", "rate")]
    rated = repeated(survey_of(t).rated_by(counted_base(t).select(*carried, "times")))
    path = scratch_path(t.spark, "ratings-export")
    exported = anonymise(rated, columns, {"ind_weight": "weight", "community": "ctv"})
    writers.export_dataset(exported, path)
    back = readers.read_dataset(t.spark, path, schema=exported.schema)
    return back.withColumns({c: F.col(c).cast("bigint") for c in ["rated_item", "rate", "sex", "employed"]}).withColumn(
        "weight", F.col("weight").cast("double")
    )


def replaced_table(t: SurveyTables) -> DataFrame:
    """A table of the warehouse after it was replaced: what stood there before is gone."""
    name = f"interview_results_{uuid.uuid4().hex}"
    rows = t.interviews.select("interview_key", "result")
    writers.replace_tables({name: rows.limit(1)})
    writers.replace_tables({name: rows})
    back = readers.read_table(t.spark, name)
    atexit.register(_drop, t.spark, name)
    return back


def replaced_together(t: SurveyTables) -> DataFrame:
    """Interviews and members by result, from both tables of a version that replaced an earlier one at once."""
    target = scratch_path(t.spark, "versions")
    interviews, members = t.interviews.select("interview_key", "result"), t.roster.select("interview_key", "rel")
    published.replace_together(t.spark, target, {"interviews": interviews.limit(1), "members": members.limit(1)})
    published.replace_together(t.spark, target, {"interviews": interviews, "members": members})
    now = published.read_together(t.spark, target)
    sizes = now["members"].where("rel IS NOT NULL").groupBy("interview_key").agg(F.count("*").alias("members"))
    met = attach_one(now["interviews"], sizes, ["interview_key"])
    return met.groupBy("result").agg(F.count("interview_key").alias("interviews"), F.sum(F.coalesce("members", F.lit(0))).alias("members"))


def _drop(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def audit_log(t: SurveyTables) -> DataFrame:
    """Actions on interviews as the audit log holds them, in the local time of the survey."""
    path = scratch_path(t.spark, "log")
    entries = t.actions.select(F.col("date").alias("utc"), F.col("interview_key").cast("string").alias("user"), "action")
    writers.append_entries(entries, path, "America/Belize")
    log = t.spark.read.parquet(path)
    return log.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def first_columns(t: SurveyTables) -> DataFrame:
    """The first five columns of the base table by position, and one by name."""
    return t.interviews.select(*t.interviews.columns[:5], "round")


def not_listed_answers(t: SurveyTables) -> DataFrame:
    """Answers outside a list, NULL answers kept, against plain comparison, which drops them."""
    listed = ["Yes", "DK"]
    return (
        t.interviews.groupBy("result")
        .agg(
            F.count_if(not_in("q2", listed)).alias("not_listed"),
            F.count_if(F.col("q2") != "Yes").alias("other_than_yes"),
            F.count("*").alias("n"),
        )
    )


def place_of_interview(t: SurveyTables) -> DataFrame:
    """Interviews with community and district by address."""
    places = t.places.select("address_id", "community", "district")
    return attach_one(t.interviews.select("interview_key", "address_id"), places, ["address_id"])


QUERIES = [
    scan_survey, scan_weights, assignment_list, sample_frame, cover_vars, exclude_keys, eligible_respondents,
    complete_cases, age_bands, derive_education, derive_worker, lump_other, standardise_names, decode_labels,
    recode_levels, ordered_levels, unused_levels, anonymised_export, anonymised_ratings, replaced_table, replaced_together, audit_log, first_columns, not_listed_answers, place_of_interview,
]
