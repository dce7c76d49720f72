"""Field monitoring, survey design, open answers and live tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import clean_answer, collapse, duration_seconds, only_levels
from fieldtally.operators import geo, monitor, text, weights
from fieldtally.operators.linkage import attach_one
from fieldtally.operators.tabulate import formatted, frequency
from fieldtally.plans.base import share6
from fieldtally.plans.links import ADDRESS
from fieldtally.plans.stopwords import english
from fieldtally.session import scratch_path
from fieldtally.sources import published
from fieldtally.sources.views import SCHEMAS, SurveyTables
from fieldtally.streaming import live, state

REVIEW_URL = "https://survey.example.org/interview/review"
TEAM = {"North": ["interviewer0"], "South": ["interviewer1"], "West": ["interviewer2"], "Coast": ["interviewer4"]}


def _counts(t: SurveyTables) -> DataFrame:
    frame = t.frame.select("frame_id", "frame_community", *ADDRESS)
    visits = t.households.select(*ADDRESS, "community", "result")
    return monitor.frame_counts(frame, visits, ADDRESS, "frame_id", "frame_community")


def kpis(t: SurveyTables) -> DataFrame:
    """Figures on top of the dashboard."""
    return monitor.kpis(t.households, _counts(t), "community")


def pending_by_community(t: SurveyTables) -> DataFrame:
    """Frame households without an interview that names its community."""
    return _counts(t).select("frame_community", "pending")


def communities(t: SurveyTables) -> DataFrame:
    """Communities of the frame and whether work has started there."""
    return _counts(t).select("frame_community", (F.col("visited") > 0).alias("started"))


def progress_table(t: SurveyTables) -> DataFrame:
    """Sampled, visited and completed households per community and in total."""
    return monitor.progress(_counts(t), "frame_community")


def submission_table(t: SurveyTables) -> DataFrame:
    """Sampled, submitted and completed per community and district, and All."""
    frame = t.frame.select(F.col("frame_community").alias("community"), "ed")
    table = monitor.submissions(frame, t.households.select("community", "ed", "result"), ["community", "ed"])
    return table.drop("is_total")


def response_table(t: SurveyTables) -> DataFrame:
    """Community by result with row shares."""
    table = formatted(monitor.response_table(t.households, "community"), digits=0)
    return table.select("row", "col", "is_total", "n", "row_total", "cell")


def map_status(t: SurveyTables) -> DataFrame:
    """Marker of every sampled household."""
    frame = t.frame.select("frame_id", "frame_community", "frame_head", *ADDRESS)
    visits = t.households.select(*ADDRESS, "interview_key", "interview_id", "result")
    return monitor.map_status(monitor.frame_join(frame, visits, ADDRESS), None, REVIEW_URL)


def nonrespondents(t: SurveyTables) -> DataFrame:
    """Interviews that ended in something other than completion."""
    columns = ["interview_key", "head_name", "community", "result", "responsible"]
    return monitor.nonrespondents(t.households, columns, REVIEW_URL)


def missing_result(t: SurveyTables) -> DataFrame:
    """Interviews without a result."""
    columns = ["interview_key", "head_name", "community", "responsible"]
    return monitor.missing_result(t.households, columns, REVIEW_URL)


def missing_info(t: SurveyTables) -> DataFrame:
    """Members without an age."""
    rows = monitor.missing_info(t.roster, ["interview_key", "rel", "sex"])
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("rel", "sex")})


def interviews_by_interviewer(t: SurveyTables) -> DataFrame:
    """Interviews per interviewer name; accounts without a name are one group."""
    name = only_levels(collapse("responsible", TEAM), list(TEAM))
    return frequency(t.interviews.select(name.alias("interviewer")), ["interviewer"])


def duration_of_interviews(t: SurveyTables) -> DataFrame:
    """Interview length in seconds, with and without the day part."""
    return t.diagnostics.select(
        "interview_key",
        duration_seconds("duration").cast("bigint").alias("seconds"),
        duration_seconds("duration", include_days=False).cast("bigint").alias("seconds_of_day"),
    )


def sample_size(t: SurveyTables) -> DataFrame:
    """Interviews needed per community, with one in ten households not responding."""
    size = frequency(t.frame, ["frame_community"])
    return size.select(
        "frame_community",
        F.col("n").alias("households"),
        share6(weights.sample_size("n")).alias("needed"),
        share6(weights.sample_size("n", nonresponse=1.1)).alias("needed_adjusted"),
    )


def design_weights(t: SurveyTables) -> DataFrame:
    """Weights of completed interviews from frame, sample and number of adults."""
    completed = t.households.filter("result = 'Completed'").select("interview_key", "community")
    adults = t.roster.groupBy("interview_key").agg(F.count_if(F.col("age") >= 18).alias("adults"))
    frame = t.frame.select(F.col("frame_community").alias("community"))
    table = weights.design_weights(frame, completed, adults, "community", "interview_key")
    return table.withColumns({c: share6(c) for c in ("hh_weight", "ind_weight")})


def systematic_sample(t: SurveyTables) -> DataFrame:
    """Twenty households of each community at even steps."""
    return weights.systematic_sample(t.frame, "frame_community", "frame_id", 20)


def expand_by_weight(t: SurveyTables) -> DataFrame:
    """Interviews copied by their rounded person weight."""
    return weights.expand_by_weight(t.weights, "ind_weight").select(
        "interview_key", F.col("ind_weight").cast("double").alias("ind_weight")
    )


def polygon_centroids(t: SurveyTables) -> DataFrame:
    """Centre of every building."""
    points = geo.polygon_centroids(t.polygons)
    return points.select("polygon_id", share6("lon").alias("lon"), share6("lat").alias("lat"))


def _parts(t: SurveyTables) -> int:
    """The folder's answers are one row group: deal them out to as many tasks as a shuffle has."""
    return int(t.spark.conf.get("spark.sql.shuffle.partitions"))


def open_text_clean(t: SurveyTables) -> DataFrame:
    """Answers without filler words, whole texts."""
    return t.answers.select("answer_id", clean_answer("answer").alias("cleaned"))


def open_text_words(t: SurveyTables) -> DataFrame:
    """The hundred most frequent words."""
    return text.most_common(text.word_counts(t.answers, "answer", english(), parts=_parts(t)), "word", 100)


def open_text_vocabulary(t: SurveyTables) -> DataFrame:
    """Every word with its count, stop words given as a table."""
    stop = t.spark.createDataFrame([(w,) for w in english()], "word string")
    return text.word_counts(t.answers, "answer", stop, parts=_parts(t))


def open_text_trigrams(t: SurveyTables) -> DataFrame:
    """The thirty most frequent word triples."""
    return text.most_common(text.trigram_counts(t.answers, "answer", parts=_parts(t)), "words", 30)


def open_text_top_triples(t: SurveyTables) -> DataFrame:
    """The same by bounds first: triples in hash buckets that can hold none of the thirty are never shuffled."""
    return text.top_trigrams(t.answers, "answer", 30, parts=_parts(t))


LIVE_ORDER = ["ts", "event_id"]
LIVE_COLUMNS = ["ts", "event_id", "event_type", "value"]


def refresh_latest(t: SurveyTables) -> DataFrame:
    """Latest record per interview from a stream run over the folder, kept in buckets and compacted."""
    target, checkpoint = scratch_path(t.spark, "latest"), scratch_path(t.spark, "latest-progress")
    stream = live.landing_stream(t.spark, t.folder, SCHEMAS["events"], "events.parquet")
    kept = state.State.of(stream, target, "user_id", LIVE_ORDER, LIVE_COLUMNS, buckets=_parts(t))
    kept.follow(stream, checkpoint).awaitTermination()
    kept.compact()
    return kept.read().withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def present_status_counts(t: SurveyTables) -> DataFrame:
    """Interviews by community and present status: each counts once, where its latest record stands.

    The folder's events arrive in four batches, so interviews move between states.
    """
    scratch = scratch_path(t.spark, "present")
    records = t.raw("events").select("event_id", "ts", F.col("user_id").alias("address_id"), F.col("event_type").alias("status"))
    for i in range(4):
        # In an order that is not that of time: late records change nothing.
        records.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).write.mode("append").parquet(f"{scratch}/landing/{i}")
    files = len(published.listed(t.spark, scratch, "landing/*/part-*"))
    stream = live.landing_stream(t.spark, f"{scratch}/landing/*", records.schema, files_per_batch=-(-files // 4))
    placed = attach_one(stream, t.places.select("address_id", "community"), ["address_id"])
    kept = state.State.of(placed, f"{scratch}/latest", "address_id", LIVE_ORDER, ["community", "status"], buckets=_parts(t))
    state.count_present(placed, kept, f"{scratch}/counts", f"{scratch}/progress", ["community", "status"]).awaitTermination()
    return state.read_present(t.spark, f"{scratch}/counts", ["community", "status"])


def stream_status_counts(t: SurveyTables) -> DataFrame:
    """Running counts of status by community from a stream run over the folder.

    The community is looked up in the stored places as records arrive.
    """
    target, checkpoint = scratch_path(t.spark, "status"), scratch_path(t.spark, "status-progress")
    stream = live.landing_stream(t.spark, t.folder, SCHEMAS["events"], "events.parquet")
    records = stream.select(F.col("user_id").alias("address_id"), F.col("event_type").alias("status"))
    placed = attach_one(records, t.places.select("address_id", "community"), ["address_id"])
    live.count_status(placed, target, checkpoint, ["community", "status"]).awaitTermination()
    return live.read_status(t.spark, target, ["community", "status"])


QUERIES = [
    kpis, pending_by_community, communities, progress_table, submission_table, response_table, map_status, nonrespondents,
    missing_result, missing_info, interviews_by_interviewer, duration_of_interviews, sample_size, design_weights,
    systematic_sample, expand_by_weight, polygon_centroids, open_text_clean, open_text_words, open_text_vocabulary,
    open_text_trigrams, open_text_top_triples, refresh_latest, present_status_counts, stream_status_counts,
]
