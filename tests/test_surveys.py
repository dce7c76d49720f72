"""The three survey classes on a twelve-interview fixture, against plain Python."""

from __future__ import annotations

import dataclasses
import math
from collections import defaultdict
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldtally.operators import privacy
from fieldtally.operators.codebook import labelled
from fieldtally.plans.dashboard import FieldMonitor
from fieldtally.plans.household import DIMENSIONS, HouseholdSurvey
from fieldtally.plans.youth import RespondentSurvey
from fieldtally.sources import readers, schemas, writers

D = Decimal
BASE_SCHEMA = schemas.with_questions(
    schemas.HOUSEHOLD, k1="string", a1_1="string", a1_2="string", k4__1="int", k4__2="int", k4__888888="int", k4_1="string"
)
# Two strata, one missing community, one duplicate address, one interview with
# no option answered, one test interview, two that are not complete.
BASE = [
    ("k01", "i01", "Hill", "1", 1, 1, 1, "h01", 1, "Yes", "High", "Low", 1, 0, 0, None),
    ("k02", "i02", "Hill", "1", 1, 1, 2, "h02", 1, "No", "Low", "Low", 1, 1, 0, None),
    ("k03", "i03", "Vale", "2", 2, 1, 1, "h03", 1, "Yes", "High", "High", 0, 1, 1, "reed"),
    ("k04", "i04", "Vale", "2", 2, 1, 2, "h04", 1, None, "High", "Not stated", None, None, None, None),
    ("k05", "i05", "Vale", "2", 2, 2, 1, "h05", 1, "DK", "Low", "High", 0, 0, 1, None),
    ("k06", "i06", "Port", "3", 3, 1, 1, "h06", 1, "Yes", None, "Low", 1, 0, 0, None),
    ("k07", "i07", "Port", "3", 3, 1, 1, "h07", 1, "No", "Low", "High", 0, 0, 0, None),
    ("k08", "i08", None, "3", 3, 2, None, "h08", 1, "Yes", "High", "High", 1, 1, 1, None),
    ("k09", "i09", "Port", "3", 3, 3, 1, "h09", 2, "Yes", "High", "High", 1, 1, 1, None),
    ("k10", "i10", "Port", "3", 3, 3, 2, "h10", None, None, None, None, None, None, None, None),
    ("k11", "i11", "Hill", "1", 9, 9, 9, "test", 1, "Yes", "High", "High", 1, 1, 1, None),
    ("k12", "i12", "Vale", "2", 2, 3, 1, "h12", 1, "No", "Low", "Low", 0, 1, 0, None),
]
# (key, rel, sex, age, ethnicity, attending, current, last, employed, type)
MEMBERS = [
    ("k01", 1, 1, 52, "Creole", 2, None, 9, 1, 1),
    ("k01", 2, 2, 16, "Creole", 1, 9, None, None, None),
    ("k02", 1, 2, 40, "Maya", 2, None, 12, 1, 3),
    ("k03", 1, 1, 20, "Mestizo/Hispanic/Latino", 2, None, 18, 2, None),
    ("k04", 1, 1, None, "Mennonite", 2, None, 21, 1, 888888),
    ("k05", 1, 2, 35, None, 2, None, 999999, 1, 999999),
    ("k06", 1, 2, 17, "Creole", 1, 10, None, None, None),
    ("k07", 1, 1, 4, "Creole", None, None, None, None, None),
    ("k12", 1, 1, 70, "Garifuna", 2, None, 8, 1, 2),
    ("k12", 1, 2, 66, "Creole", 2, None, 8, 2, None),
]
RATINGS = [
    ("k01", 1, 5), ("k01", 2, 1), ("k02", 1, None), ("k03", 1, 3), ("k03", 2, 4), ("k05", 1, 2), ("k06", 1, 5),
    ("k09", 1, 1), ("k12", 1, 4),
]
WEIGHTS = [
    ("k01", D("16.71428571"), D("46.07407407")), ("k02", D("16.71428571"), D("10.5")), ("k03", D("10"), D("0")),
    ("k04", D("10"), D("7.25")), ("k06", D("9.5"), D("2.5")), ("k07", D("9.5"), D("3.5")), ("k08", D("1"), D("1.75")),
    ("k12", D("4"), D("5.125")),
]


@pytest.fixture(scope="module")
def survey(spark):
    return HouseholdSurvey(
        spark.createDataFrame(BASE, BASE_SCHEMA),
        spark.createDataFrame(MEMBERS, schemas.MEMBERS),
        spark.createDataFrame(RATINGS, schemas.RATINGS),
        spark.createDataFrame(WEIGHTS, schemas.WEIGHTS),
        excluded=["k11"],
        strata={"Upland": ["Hill"]},
        other_stratum="Lowland",
    )


# The same preparation in plain Python.
ATTAINED = {"k01": "Primary", "k02": "Secondary", "k03": "Tertiary", "k04": "Never Attended", "k05": "Not Stated", "k06": "Primary"}
AGES = {"k01": "50+", "k02": "35-49", "k03": "18-34", "k05": "35-49", "k06": "5-17", "k07": "0-4"}
WORK = {"k01": "Self Employed", "k02": "Employee", "k03": "Not Employed", "k04": "Other", "k05": "Not Stated"}


def analysis_rows():
    weight = {k: w for k, _, w in WEIGHTS}
    out = []
    for row in BASE:
        key, ctv, result = row[0], row[2], row[8]
        if result != 1 or key == "k11":
            continue
        heads = [m for m in MEMBERS if m[0] == key and m[1] == 1] or [None]
        for head in heads:
            if key == "k12":
                attained, age = "Primary", "50+"
                work = "Self Employed" if head[9] == 2 else "Not Employed"
            else:
                attained, age, work = ATTAINED.get(key), AGES.get(key), WORK.get(key)
            group = head[4] if head and head[4] in ("Creole", "Mestizo/Hispanic/Latino") else "Other"
            education = {"Primary": "Primary", "Secondary": "Secondary or Higher", "Tertiary": "Secondary or Higher"}
            out.append(
                {
                    "key": key,
                    "strata": "Upland" if ctv == "Hill" else "Lowland",
                    "age_group": age,
                    "ethnicity": group,
                    "education": education.get(attained, "Other"),
                    "workertype_group": work,
                    "w": weight.get(key),
                    "k1": row[9],
                    "options": dict(zip(["k4__1", "k4__2", "k4__888888"], row[12:15], strict=True)),
                }
            )
    return out


def by_items(data):
    for d in DIMENSIONS:
        for item in {r[d] for r in data}:
            yield d, item, [r for r in data if r[d] == item]
    yield "Total", "Total", data


def test_preparation(survey):
    expected = [(r["key"], *[r[d] for d in DIMENSIONS], r["w"]) for r in analysis_rows()]
    got = [tuple(r) for r in survey.households.select("interview__key", *DIMENSIONS, "ind_weights").collect()]

    def order(r):
        return [(v is not None, v) for v in r]

    assert sorted(got, key=order) == sorted(expected, key=order)


def test_weighted_banner(survey):
    expected = {}
    for d, item, group in by_items(analysis_rows()):
        n = defaultdict(D)
        for r in group:
            if r["k1"] is not None:
                n[r["k1"]] += r["w"] or 0
        total = sum(n.values())
        for answer, value in n.items():
            expected[d, item, answer] = (value, total, float(value) / float(total) if total else None)
    table = survey.single("k1")
    got = {(r.dimension, r.item, r.answer): (r.n, r.total, r.prop) for r in table.collect()}
    assert got.keys() == expected.keys()
    for cell, (n, total, prop) in expected.items():
        assert got[cell][:2] == (n, total)
        assert got[cell][2] == (None if prop is None else pytest.approx(prop))


def test_printed_banner(survey):
    printed = {(r.dimension, r.item): (r.Yes, r.No, r.DK) for r in survey.single_printed("k1", ["Yes", "No", "DK"]).collect()}
    # 46.07407407 + 0 + 2.5 + 1.75 Yes, 10.5 + 3.5 + 2 * 5.125 No, nothing DK.
    assert printed["Total", "Total"] == ("67.5% (51)", "32.5% (25)", "0% (0)")
    assert printed["strata", "Upland"] == ("81.4%", "18.6%", "0% (0)")


def test_multi_select_banner(survey):
    expected = {}
    for d, item, group in by_items(analysis_rows()):
        for option in ("k4__1", "k4__2", "k4__888888"):
            given = [(r["options"][option], r["w"]) for r in group if r["w"] is not None and r["options"][option] is not None]
            selected = math.ceil(sum((w for v, w in given if v == 1), D(0)))
            total = math.ceil(sum((w for _, w in given), D(0)))
            expected[d, item, option] = (selected, total)
    got = {(r.dimension, r.item, r.option): (int(r.selected), int(r.total)) for r in survey.multi("k4").collect()}
    assert got == expected


def test_ratings(survey):
    table = survey.rating_means().filter("dimension = 'Total'")
    got = {r.rated: r["mean"] for r in table.collect()}
    # k05 has no weight; the two heads of k12 count its rating twice.
    w = {k: float(x) for k, _, x in WEIGHTS}
    top = 5 * w["k01"] + 3 * w["k03"] + 5 * w["k06"] + 2 * 4 * w["k12"]
    assert got[1] == pytest.approx(top / (w["k01"] + w["k03"] + w["k06"] + 2 * w["k12"]))
    assert got[2] == pytest.approx(1.0)
    counts = survey.rating_table().filter("dimension = 'Total' AND rated = 1")
    assert {r.answer: int(r.n) for r in counts.collect()} == {None: 11, 2: 0, 3: 0, 4: 11, 5: 49}
    likert = {(r.rated, r.level): r.n for r in survey.likert().collect()}
    assert likert == {(1, 4): 10, (1, 5): 48, (2, 1): 46}
    grouped = survey.likert("strata").filter("rated = 1 AND group = 'Upland'")
    assert [(r.level, r.n, r.prop) for r in grouped.collect()] == [(5, 46, 1.0)]


def mean_rows(survey):
    """Means to twelve places: the order of a sum of doubles may move the last."""
    return rows(survey.rating_means().withColumn("mean", F.round("mean", 12)))


def test_ratings_without_repeated_heads(survey):
    single = survey.members.filter("interview__key <> 'k12' OR sex = 1")
    counted = dataclasses.replace(survey, members=single)
    direct = dataclasses.replace(counted, unique_heads=True)
    assert rows(counted.rating_table()) == rows(direct.rating_table())
    assert mean_rows(counted) == mean_rows(direct)
    assert rows(counted.likert("strata")) == rows(direct.likert("strata"))


def test_item_tables(survey):
    table = survey.item_likert({"a1_1": "Waste", "a1_2": "Fire"}, "Not stated")
    # Stated both: k01 46, k02 10, k07 4, k08 2, k12 5 twice; k03 and k05 carry no weight.
    assert {(r.rated, r.level): (r.n, r.total) for r in table.collect()} == {
        ("Waste", "High"): (48, 72), ("Waste", "Low"): (24, 72), ("Fire", "High"): (6, 72), ("Fire", "Low"): (66, 72),
    }
    shares = survey.item_shares({"k4__1": "Report", "k4__2": "Scare"})
    assert {(r.item, r.value): r.n for r in shares.collect()} == {
        ("Report", "Yes"): 60, ("Report", "No"): 14, ("Scare", "Yes"): 22, ("Scare", "No"): 52,
    }
    yes = {r.answer: (r.n, r.total) for r in survey.share_of("k1", "Yes").collect()}
    assert yes == {"Yes": (50, 81), "No or DK": (31, 81)}
    asked = {r.answer: r.n for r in survey.share_of("k1", "Yes", asked=F.col("k1").isNotNull()).collect()}
    assert asked == {"Yes": 50, "No or DK": 24}


def test_descriptions(survey):
    heads = survey.describe_heads({"sex": "Sex", "ctv": "Community"}, "ctv")
    got = {(r.dimension, r.item): float(r.n) for r in heads.collect()}
    assert got["Sex", "1"] == pytest.approx(46.07407407 + 7.25 + 3.5 + 5.125) and got["Community", "Vale"] == 17.5
    members = {(r.dimension, r.item): r.n for r in survey.describe_members({"age_group": "Age"}).collect()}
    # k08 has no members and keeps a row without an age, as does the head of k04.
    assert members == {
        ("Age", None): 2, ("Age", "50+"): 3, ("Age", "35-49"): 2, ("Age", "18-34"): 1, ("Age", "5-17"): 2, ("Age", "0-4"): 1,
    }


def test_submissions(survey, spark):
    frame = spark.createDataFrame([("Hill",)] * 4 + [("Port",)] * 5 + [("Far",)], "ctv string")
    got = {r.ctv: (r.sampled, r.submitted, r.completed, r.completed_pct) for r in survey.submissions(frame, ["ctv"]).collect()}
    assert got == {
        "Hill": (4, 2, 2, "50%"), "Port": (5, 4, 2, "40%"), "Far": (1, None, None, None), "All": (10, 6, 4, "40%"),
    }


def test_unweighted_tables(survey):
    table = {(r.item, r.answer): r.n for r in survey.single("k1", weighted=False).filter("dimension = 'Total'").collect()}
    assert table == {("Total", "Yes"): 4, ("Total", "No"): 4, ("Total", "DK"): 1}
    assert "ind_weights" not in survey.described.columns
    options = survey.multi("k4", weighted=False, base="all").filter("dimension = 'Total'").collect()
    assert {r.option: (int(r.selected), int(r.total)) for r in options} == {
        "k4__1": (4, 10), "k4__2": (5, 10), "k4__888888": (3, 10),
    }


def test_stored_survey_only_scans(survey):
    def tables(s):
        return [rows(s.single("k1")), rows(s.multi("k4")), rows(s.likert()), mean_rows(s)]

    kept = dataclasses.replace(survey).stored()
    assert tables(kept) == tables(survey)
    plan = kept.multi("k4")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    assert rows(kept.single("k1", weighted=False)) == rows(survey.single("k1", weighted=False))


@pytest.fixture(scope="module")
def field(spark):
    labels = {1: "Completed", 2: "Partial", None: None}
    base = [(*r[:4], str(r[4]), str(r[5]), None if r[6] is None else str(r[6]), r[7], labels[r[8]]) for r in BASE]
    schema = "interview__key string, interview__id string, ctv string, ed string, building_number string, " \
        "dwelling_number string, household_number string, head_name string, result string"
    frame = [
        ("f1", "1", "h01", "Hill", 1, 1, 1), ("f2", "1", "h02", "Hill", 1, 1, 2), ("f3", "2", "h03", "Vale", 2, 1, 1),
        ("f4", "2", "hxx", "Vale", 8, 8, 8), ("f5", "3", "h06", "Port", 3, 1, 1), ("f6", "3", "h08", "Port", 3, 2, None),
    ]
    frame_schema = "interview_key string, ed string, head_name string, ctv_official string, building_number int, " \
        "dwelling_number int, household_number int"
    accounts = [(f"k{i:02d}", f"interviewer{i % 3}", "00.00:10:00") for i in range(1, 12)]
    return FieldMonitor(
        spark.createDataFrame(base, schema),
        spark.createDataFrame(accounts, schemas.DIAGNOSTICS),
        spark.createDataFrame(frame, frame_schema),
        "https://h/review",
        team={"A": "interviewer0", "B": "interviewer1"},
    )


def test_field_monitor(field):
    # f5 is met twice (k06, k07); f6 by k08, which names no community.
    counts = {r.ctv_official: tuple(r)[1:] for r in field.counts.collect()}
    assert counts == {"Hill": (2, 2, 2, 0), "Vale": (2, 1, 1, 1), "Port": (3, 3, 3, 1)}
    assert rows(field.kpis()) == [(12, 10, 1, 0.92, 4, 1)]
    progress = {r.community: (r.visited_pct, r.completed_pct) for r in field.progress().collect()}
    assert progress["Total"] == ("85.7%", "85.7%") and progress["Vale"] == ("50%", "50%")
    response = {(r.row, r.col): r.cell for r in field.response().collect()}
    assert response["Port", "Completed"] == "50% (2)" and response["Total", "Completed"] == "83% (10)"
    colours = {(r.frame_id, r.interview_key): r.colour for r in field.map_status().collect()}
    assert colours == {
        ("f1", "k01"): "green", ("f2", "k02"): "green", ("f3", "k03"): "green", ("f4", None): "white",
        ("f5", "k06"): "green", ("f5", "k07"): "green", ("f6", "k08"): "green",
    }
    assert field.map_status("Vale").count() == 2
    assert rows(field.nonrespondents().select("interview__key", "interviewer", "link")) == [("k09", "A", "https://h/review/i09")]
    assert rows(field.missing_result().select("interview__key", "link")) == [("k10", "https://h/review/i10")]
    assert rows(field.by_interviewer()) == [(None, 5), ("A", 3), ("B", 4)]
    charts = {(r.chart, r.x): r.n for r in field.charts("ctv", "result").collect()}
    assert charts["ctv", "Port"] == 4 and charts["result", None] == 1


@pytest.fixture(scope="module")
def youth(spark):
    schema = "interview__key string, district string, constituency string, gender string, age string, HH_FINALRESULT string, " \
        "disability string, internet string, truths__1 string, truths__2 string, suggestion string"
    data = [
        ("a", "North", "N1", "Female", "14", "Complete", None, "1", "1", "0", "more buses please"),
        ("b", "North", "N2", "Male", "33", "Partial", "No", "2", "1", "1", "buses and more buses please now"),
        ("c", "South", "S1", "Male", "21", "Complete", "No", "missing", None, None, "no"),
        ("d", "South", "S1", "Female", "25", "Complete", "No", "2", "0", "1", None),
        ("e", "South", "missing", "Male", "20", "Complete", "No", "1", "1", "1", "x"),
        ("f", "South", "S1", "missing", "20", "Complete", "No", "1", "1", "1", "x"),
        ("g", None, "S1", "Male", "20", "Complete", "No", "1", "1", "1", "x"),
        ("h", "North", "N1", "Male", "13", "Complete", "No", "1", "1", "1", "x"),
        ("i", "North", "N1", "Male", "20", "Partial", None, "1", "1", "1", "x"),
        ("j", "North", "N1", "Male", "old", "Complete", "No", "1", "1", "1", "x"),
        ("t", "North", "N1", "Male", "20", "Complete", "No", "1", "1", "1", "x"),
    ]
    return RespondentSurvey(
        spark.createDataFrame(data, schema),
        excluded=["t"],
        recodes={"internet": {"Agree": ["1"], "Disagree": ["2"]}},
        areas={"Coast": ["N1", "N2"]},
        ages={33: 29},
    )


def test_respondents(youth):
    assert rows(youth.respondents.select("interview__key", "age", "age_group", "area", "internet")) == [
        ("a", 14, "14-17", "Coast", "Agree"),
        ("b", 29, "26-29", "Coast", "Disagree"),
        ("c", 21, "18-21", "Other", "missing"),
        ("d", 25, "22-25", "Other", "Disagree"),
    ]
    described = {(r.dimension, r.item): r.n for r in youth.describe({"gender": "Gender", "area": "Area"}).collect()}
    assert described == {("Gender", "Female"): 2, ("Gender", "Male"): 2, ("Area", "Coast"): 2, ("Area", "Other"): 2}


def test_respondent_tables(youth):
    table = youth.by_constituency("internet").collect()
    assert [r.region for r in table][:4] == ["North"] * 4 and table[-1].region is None
    cells = {(r.row, r.col): r.cell for r in table}
    assert cells["S1", "Disagree"] == "100.0% (1)" and cells["Total", "Disagree"] == "66.7% (2)"
    assert {(r.row, r.col): r.n for r in youth.by_district("internet").collect()}["North", "Total"] == 2
    shares = {(r.district, r.option): (r.n, r.total, r.prop) for r in youth.multi_by_district("truths").collect()}
    assert shares["National", "truths__1"] == (2, 4, 0.5) and shares["South", "truths__2"] == (1, 2, 0.5)
    local = {(r.constituency, r.option): r.n for r in youth.multi_by_constituency("truths").collect()}
    assert local["S1", "truths__1"] == 0 and local["N2", "truths__1"] == 1
    named = youth.multi_by_district("truths", {"truths__2": "Has a job", "truths__1": "Has a child"})
    assert {(r.option, r.label, r.label_order) for r in named.collect()} == {
        ("truths__1", "Has a child", 2), ("truths__2", "Has a job", 1),
    }
    mentions = youth.mention_shares("truths", "district").filter("dimension = 'Total'")
    assert {r.option: (r.selected, r.total) for r in mentions.collect()} == {"truths__1": (2, 4), "truths__2": (2, 4)}
    assert rows(youth.words("suggestion", ["more", "now"])) == [("buses", 3), ("please", 2)]
    assert rows(youth.triples("suggestion")) == [
        ("buses more buses", 1), ("buses please now", 1), ("more buses please", 2),
    ]
    assert rows(youth.facet_counts("district", "gender")) == [
        ("North", "Female", 1), ("North", "Male", 1), ("South", "Female", 1), ("South", "Male", 1),
    ]


def test_from_delivered_files_to_exported_tables(spark, tmp_path):
    """Files in, linked and labelled survey, banner and anonymised micro-data out."""
    coded = schemas.with_questions(schemas.HOUSEHOLD, k1="int", k4__1="int", k4__2="int")
    codes = {"Yes": 1, "No": 2, "DK": 8, None: None}
    base = [(*r[:9], codes[r[9]], r[12], r[13]) for r in BASE]
    for name, data, schema in (("base", base, coded), ("members", MEMBERS, schemas.MEMBERS), ("ratings", RATINGS, schemas.RATINGS)):
        writers.replace_dataset(spark.createDataFrame(data, schema), str(tmp_path / name))
    writers.write_delimited(spark.createDataFrame(WEIGHTS, schemas.WEIGHTS), str(tmp_path / "weights"))

    def read(name, schema):
        return readers.read_dataset(spark, str(tmp_path / name), schema=schema)

    survey = HouseholdSurvey(
        labelled(read("base", coded), {"k1": {1: "Yes", 2: "No", 8: "DK"}}),
        read("members", schemas.MEMBERS),
        read("ratings", schemas.RATINGS),
        readers.read_weights(spark, str(tmp_path / "weights")),
        excluded=["k11"],
        strata={"Upland": ["Hill"]},
        other_stratum="Lowland",
    ).stored()
    total = {r.answer: float(r.n) for r in survey.single("k1").filter("dimension = 'Total'").collect()}
    assert total == {"Yes": pytest.approx(50.32407407), "No": 24.25, "DK": 0.0}
    allowed = ["strata", "age_group", "k1", "ind_weights"]
    micro = privacy.anonymise(survey.households, allowed, {"ind_weights": "weight"})
    writers.export_dataset(micro, str(tmp_path / "out"), "csv")
    back = readers.read_delimited(spark, str(tmp_path / "out"), micro.schema)
    assert back.columns == ["strata", "age_group", "k1", "weight"] and rows(back) == rows(micro)
