"""Properties the plans must keep to run on tables of any size."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from fieldtally import session
from fieldtally.operators import linkage, tabulate
from fieldtally.plans import catalog
from fieldtally.plans.base import DIMENSIONS, analysis_base
from fieldtally.operators.banner import banner
from fieldtally.sources.views import SurveyTables

QUERIES = catalog.queries()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_python(name, spark, folder):
    plan = physical(QUERIES[name](spark, folder))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan


@pytest.mark.parametrize("name", ["banner_single", "banner_report", "banner_multi", "yes_share"])
def test_banner_reads_each_table_no_more_often_for_more_dimensions(name, spark, folder):
    base = SurveyTables(spark, folder)
    few = physical(banner(analysis_base(base), "q1", DIMENSIONS[:1], "ind_weight"))
    all_five = physical(banner(analysis_base(base), "q1", DIMENSIONS, "ind_weight"))
    assert few.count("FileScan") == all_five.count("FileScan")


def test_scan_reads_only_the_columns_used(spark, folder):
    plan = physical(QUERIES["freq_counts"](spark, folder))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sorted(schemas) == [
        "c_custkey:bigint,c_nationkey:int",
        "n_nationkey:int,n_name:string,n_regionkey:int",
        "o_custkey:bigint",
        "r_regionkey:int",
    ]


def test_head_filter_reaches_the_scan(spark, folder):
    plan = physical(QUERIES["head_attributes"](spark, folder))
    assert "EqualTo(l_linenumber,1)" in plan


def scans(df, table: str) -> int:
    """Scans of a table in the plan that ran."""
    df.collect()
    final = physical(df).split("Initial Plan")[0]
    return len(re.findall(rf"FileScan parquet[^\n]*{table}\.parquet", final))


def test_banner_links_each_table_once(no_broadcast, folder):
    df = QUERIES["banner_single"](no_broadcast, folder)
    assert scans(df, "lineitem") == 1
    assert scans(df, "orders") <= 2


@pytest.mark.parametrize("name", ["rating_distribution", "rating_means", "likert_summary"])
def test_ratings_are_shuffled_once(name, no_broadcast, folder):
    df = QUERIES[name](no_broadcast, folder)
    assert scans(df, "lineitem") <= 2
    final = physical(df).split("Initial Plan")[0]
    raw = [line for line in final.splitlines() if "hashpartitioning(interview_key" in line]
    # Ratings, heads, interviews and weights by their key, nothing of them twice.
    assert len(raw) <= 5


def test_crosstab_by_region_reads_interviews_once(no_broadcast, folder):
    assert scans(QUERIES["crosstab_region"](no_broadcast, folder), "orders") == 1


def test_no_counting_and_no_hints_while_planning():
    import pathlib

    import fieldtally

    for path in pathlib.Path(fieldtally.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            text = path.read_text()
            assert ".rdd" not in text and "F.broadcast(" not in text and ".count()" not in text, path


def test_totals_reuse_the_shuffle_of_the_counts(no_broadcast, folder):
    t = SurveyTables(no_broadcast, folder)
    df = tabulate.with_share(tabulate.frequency(t.interviews, ["q1", "q2"]), ["q1"])
    df.collect()
    final = physical(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_hot_roster_key_is_split(no_broadcast):
    """A key with most of the rows is read by several tasks of the 1:N join."""
    spark = no_broadcast
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        one = spark.range(2000).select(F.col("id").alias("key"), F.md5(F.col("id").cast("string")).alias("head"))
        many = spark.range(0, 60000, 1, 16).select(
            F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 3000).alias("key"),
            F.md5(F.col("id").cast("string")).alias("member"),
        )
        joined = linkage.attach_many(one, many, ["key"])
        assert joined.count() == one.join(many, "key", "left").count()
        weights = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 17).alias("weight"))
        weighted = linkage.attach_one(joined, weights, ["key"]).groupBy("weight").agg(F.max("member"), F.max("head"))
        weighted.collect()
        final = physical(weighted).split("Initial Plan")[0]
        # Both the 1:N join and the one after it are split.
        assert final.count("skew=true") == 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["cover_to_roster", "full_roster"])
def test_roster_joins_sort_each_side_once(name, no_broadcast, folder):
    """No side is sorted again for an anti-join, whose memory a task would hold beside the join's."""
    plan = physical(QUERIES[name](no_broadcast, folder))
    assert plan.count("SortMergeJoin") == 1 and plan.count("Sort [") == 2


@pytest.mark.parametrize("name", ["cover_to_roster", "full_roster"])
def test_roster_joins_have_partitions_by_the_size_of_the_tables(name, no_broadcast, folder, monkeypatch):
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    few = re.findall(r"hashpartitioning\(interview_key#\d+L, (\d+)\)", physical(QUERIES[name](no_broadcast, folder)))
    monkeypatch.setattr(session, "PARTITION_BYTES", 5000)
    try:
        plan = physical(QUERIES[name](no_broadcast, folder))
        files = sum(os.path.getsize(f"{folder}/{t}.parquet") for t in ("orders", "lineitem"))
        many = re.findall(r"hashpartitioning\(interview_key#\d+L, (\d+)\)", plan)
        assert set(few) == {"8"} and set(many) == {str(-(-files // 5000))} and len(many) == len(few)
    finally:
        no_broadcast.conf.unset(initial)


@pytest.mark.parametrize("most", ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"])
def test_large_tables_lower_the_bytes_of_a_task(spark, folder, monkeypatch, most):
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    old = {name: spark.conf.get(name) for name in names}
    try:
        session.spread(spark, f"{folder}/lineitem.parquet")
        assert spark.conf.get(most) == old[most]
        for limit in (10_000, 20_000):
            monkeypatch.setattr(session, "TASK_BYTES", limit)
            session.spread(spark, f"{folder}/lineitem.parquet")
            assert spark.conf.get(most) == "10000"
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_wide_table_needs_no_pass_for_its_columns(spark, folder):
    plan = physical(QUERIES["crosstab"](spark, folder))
    assert plan.count("orders.parquet") == 1


def test_top_words_are_not_sorted_as_a_whole(spark, folder):
    assert "TakeOrderedAndProject" in physical(QUERIES["open_text_words"](spark, folder))


@pytest.mark.parametrize("name", ["banner_single", "descriptives", "kpis", "progress_table", "duplicate_keys"])
def test_no_window_over_rows(name, spark, folder):
    assert "Window" not in physical(QUERIES[name](spark, folder))


def test_result_filter_and_columns_reach_a_stored_survey(spark, tmp_path):
    from fieldtally.plans.household import HouseholdSurvey
    from fieldtally.sources import schemas

    base = schemas.with_questions(schemas.HOUSEHOLD, k1="string", k3="string")
    paths = {}
    for name, schema in (("base", base), ("members", schemas.MEMBERS), ("ratings", schemas.RATINGS), ("weights", schemas.WEIGHTS)):
        paths[name] = str(tmp_path / name)
        spark.createDataFrame([], schema).write.parquet(paths[name])
    survey = HouseholdSurvey(*[spark.read.parquet(paths[n]) for n in paths], strata={"A": ["x"]}, excluded=["k9"])
    plan = survey.single("k1")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    interviews = [line for line in scans if "ctv" in line]
    assert interviews and all("EqualTo(result,1)" in line for line in interviews)
    assert all("k3" not in line and "head_name" not in line for line in scans)
    heads = [line for line in scans if "ed_clevel" in line]
    assert heads and all("EqualTo(rel,1)" in line for line in heads)
