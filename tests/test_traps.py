"""One test per trap: places where plain SQL would give another result."""

from __future__ import annotations

from decimal import Decimal
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldtally.functions import (
    AGE_BANDS_CHILD_FIRST,
    AGE_BANDS_HOUSEHOLD,
    AGE_BANDS_YOUTH,
    as_number,
    band,
    clean_answer,
    collapse,
    duration_seconds,
    education_attained,
    keep_or_other,
    level_index,
    not_in,
    only_levels,
    paste,
    percent_text,
    percent_with_count,
    replace_value,
    review_link,
    strip_prefix,
    trigrams,
    words,
    worker_group,
)
from fieldtally.operators import banner, linkage, monitor, multiselect, privacy, rating, tabulate, weights


def values(spark, data, schema, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column.alias("v")).collect()]


def test_exclusion_keeps_missing_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(df.filter(not_in("k", ["a"]))) == [(None,), ("b",)]
    assert rows(linkage.drop_listed(df, "k", ["a"])) == [(None,), ("b",)]
    listed = spark.createDataFrame([("a",), (None,)], "name string")
    assert rows(linkage.drop_listed(df, "k", listed, "name")) == [(None,), ("b",)]


def test_plain_comparison_drops_missing(spark):
    df = spark.createDataFrame([("x",), ("missing",), (None,)], "k string")
    assert rows(df.filter(F.col("k") != "missing")) == [("x",)]


def test_missing_address_parts_match(spark):
    frame = spark.createDataFrame([(1, "a", None), (2, "a", 3)], "id int, ed string, hh int")
    visits = spark.createDataFrame([(10, "a", None), (11, "a", None)], "key int, ed string, hh int")
    joined = monitor.frame_join(frame, visits, ["ed", "hh"])
    assert rows(joined, "id", "key") == [(1, 10), (1, 11), (2, None)]
    assert rows(linkage.attach_many(frame, visits, ["ed", "hh"]), "id", "key") == [(1, None), (2, None)]


def test_bands_take_the_first_match_of_whole_numbers(spark):
    ages = [(a,) for a in (0, 4, 5, 15, 17, 18, 34, 35, 49, 50, 120, None, -1)]
    assert values(spark, ages, "age int", band("age", AGE_BANDS_HOUSEHOLD)) == [
        "0-4", "0-4", "5-17", "5-17", "5-17", "18-34", "18-34", "35-49", "35-49", "50+", "50+", None, None,
    ]
    assert values(spark, [(35,), (36,)], "age int", band("age", AGE_BANDS_CHILD_FIRST)) == ["18-35", "36-49"]
    youth = values(spark, [(13,), (14,), (29,), (None,)], "age int", band("age", AGE_BANDS_YOUTH, "Missing"))
    assert youth == ["Missing", "14-17", "26-29", "Missing"]
    halves = values(spark, [(17.5,), (17.0,)], "age double", band("age", AGE_BANDS_HOUSEHOLD, fractional=True))
    assert halves == [None, "5-17"]


def test_group_without_weights_counts_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", Decimal("2.5"))], "g string, w decimal(18,8)")
    assert rows(tabulate.frequency(df, ["g"], "w")) == [("a", Decimal("0E-8")), ("b", Decimal("2.50000000"))]


def test_long_weights_keep_their_places(spark):
    df = spark.createDataFrame(
        [("A", 1, 5, D("46.07407407"), 3), ("A", 1, 4, D("0.00000001"), 7)],
        "g string, item int, rate int, w decimal(18,8), n bigint",
    )
    exact = D("46.07407407") * 3 + D("0.00000001") * 7
    assert df.agg(F.sum(weights.times("w", "n"))).first()[0] == exact
    table = rating.distribution(df.withColumn("w", F.col("w") * 1000), "item", "rate", [], weights.times("w", "n"))
    assert {r.answer: int(r.n) for r in table.collect()} == {5: 138223, 4: 1}
    mean = (5 * 46.07407407 * 3 + 4 * 7e-8) / float(exact)
    assert rating.means(df, "item", "rate", [], weights.times("w", "n")).first()["mean"] == pytest.approx(mean, rel=1e-14)
    by_group = rating.weighted_mean(df, ["g"], "rate", weights.times("w", "n")).first()["mean"]
    assert by_group == pytest.approx(mean, rel=1e-14)


def test_counts_rounded_up_before_or_after_shares(spark):
    df = spark.createDataFrame(
        [("s", "x", Decimal("0.25")), ("s", "y", Decimal("0.75"))], "strata string, q string, w decimal(18,8)"
    )
    plain = banner.banner(df, "q", ["strata"], "w").filter("dimension = 'strata'")
    assert rows(plain.select("answer", "prop")) == [("x", 0.25), ("y", 0.75)]
    first = banner.banner(df, "q", ["strata"], "w", ceil_counts=True).filter("dimension = 'strata'")
    assert rows(first.select("answer", "n", "total", "prop")) == [("x", 1, 2, 0.5), ("y", 1, 2, 0.5)]


def test_total_row_prints_counts_and_blanks_are_filled(spark):
    df = spark.createDataFrame([("A", "x", 1.0), ("A", "x", 1.5), ("B", "y", 2.5)], "strata string, q string, w double")
    table = banner.banner(df, "q", ["strata"], "w")
    printed = banner.banner_wide(table, ["x", "y"], percent_text("prop"), percent_with_count("prop", "n"))
    assert rows(printed) == [
        ("Total", "Total", "50% (3)", "50% (3)"),
        ("strata", "A", "100%", "0% (0)"),
        ("strata", "B", "0% (0)", "100%"),
    ]


def test_missing_answers_are_kept_on_request(spark):
    df = spark.createDataFrame([("A", "x"), ("A", None)], "strata string, q string")
    kept = banner.banner(df, "q", ["strata"], drop_null_answer=False).filter("dimension = 'Total'")
    assert rows(kept.select("answer", "n", "total")) == [(None, 1, 2), ("x", 1, 2)]
    dropped = banner.banner(df, "q", ["strata"]).filter("dimension = 'Total'")
    assert rows(dropped.select("answer", "n", "total")) == [("x", 1, 1)]


def test_missing_item_is_not_the_total(spark):
    df = spark.createDataFrame([(None, "x"), ("Total", "x")], "strata string, q string")
    table = banner.banner(df, "q", ["strata"])
    assert rows(table.select("dimension", "item", "n")) == [("Total", "Total", 2), ("strata", None, 1), ("strata", "Total", 1)]


def test_three_bases_of_a_multi_select(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 0, 1), ("A", None, None)], "g string, m__1 int, m__2 int")

    def share(base):
        table = multiselect.banner_multi(df, ["m__1", "m__2"], ["g"], base=base, ceil_counts=False, total=False)
        return rows(table.select("option", "selected", "total"))

    assert share("answered") == [("m__1", 1, 2), ("m__2", 2, 2)]
    assert share("all") == [("m__1", 1, 3), ("m__2", 2, 3)]
    assert share("mentions") == [("m__1", 1, 3), ("m__2", 2, 3)]
    with pytest.raises(ValueError, match="base"):
        share("everyone")


def test_label_text_gives_the_value_and_not_its_position(spark):
    assert values(spark, [("10",), ("5",), ("abc",), (None,), ("",)], "t string", as_number("t", "int")) == [
        10, 5, None, None, None,
    ]
    df = spark.createDataFrame([("A", "1"), ("A", "0"), ("A", "n/a")], "g string, m__1 string")
    table = multiselect.banner_multi(df, ["m__1"], ["g"], total=False)
    assert rows(table.select("selected", "total")) == [(1, 2)]


def test_other_specify_text_is_no_option(spark):
    df = spark.createDataFrame([(1, "reed", 0, 1)], "k4__1 int, k4_1 string, k4__888888 int, k41__1 int")
    assert multiselect.option_columns(df, "k4") == ["k4__1", "k4__888888"]


def test_half_even_and_printed_percent(spark):
    shares = [(0.5,), (0.125,), (0.0005,), (0.0015,), (1.0,), (None,)]
    assert values(spark, shares, "p double", percent_text("p")) == ["50%", "12.5%", "0%", "0.2%", "100%", None]
    assert values(spark, [(0.5,)], "p double", percent_text("p", keep_zero=True)) == ["50.0%"]
    assert values(spark, [(0.125,), (0.135,)], "p double", percent_text("p", 0)) == ["12%", "14%"]
    assert values(spark, [(0.1,)], "p double", percent_text("p", 2)) == ["10%"]
    assert values(spark, [(0.511, 293.2)], "p double, n double", percent_with_count("p", "n")) == ["51.1% (294)"]


def test_missing_community_counts_as_started(spark):
    df = spark.createDataFrame(
        [("a", "Completed"), (None, "Partial"), (None, None)], "community string, result string"
    )
    counts = spark.createDataFrame([("a", 0), ("b", 2)], "community string, pending bigint")
    table = monitor.kpis(df, counts, "community")
    assert rows(table) == [(3, 1, 1, 0.67, 2, 1)]
    misspelt = monitor.kpis(df, counts, "community", partial="Partly")
    assert misspelt.first()["response_rate"] == 0.33


def test_first_row_per_key_by_explicit_order(spark):
    df = spark.createDataFrame(
        [(1, 5, 2, "late"), (1, 3, 9, "tie"), (1, 3, 4, "first"), (2, None, 1, "no date")],
        "key int, date int, id int, note string",
    )
    first = linkage.earliest_per_key(df, ["key"], ["date", "id"], ["date", "id", "note"])
    assert rows(first, "key", "note") == [(1, "first"), (2, "no date")]
    last = linkage.latest_per_key(df, ["key"], ["date", "id"], ["note"])
    assert rows(last, "key", "note") == [(1, "late"), (2, "no date")]


def test_wide_columns_follow_the_codebook(spark):
    df = spark.createDataFrame([("r", "b", 1), ("r", "a", 2)], "row string, col string, n int")
    table = tabulate.wide(df, ["row"], "col", ["c", "b", "a"], "n")
    assert table.columns == ["row", "c", "b", "a"]
    assert rows(table) == [("r", None, 1, 2)]
    assert rows(tabulate.wide(df, ["row"], "col", ["c", "b"], "n", fill=0)) == [("r", 0, 1)]


def test_total_of_a_missing_count(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "community string, ed int")
    visits = spark.createDataFrame([("a", 1, "Completed"), ("b", 2, None)], "community string, ed int, result string")
    table = monitor.submissions(frame, visits, ["community", "ed"]).drop("is_total")
    assert rows(table) == [
        ("All", "All", 3, 2, 1, "33%"),
        ("a", "1", 2, 1, 1, "50%"),
        ("b", "2", 1, 1, None, None),
    ]
    strict = monitor.submissions(frame, visits, ["community", "ed"], strict=True).filter("is_total")
    assert strict.first()["completed"] is None


def test_counts_over_repeated_addresses_equal_the_joined_rows(spark):
    frame = spark.createDataFrame(
        [(1, "a", 7), (2, "a", 7), (3, "a", 8), (4, "b", None)], "id int, place string, hh int"
    )
    visits = spark.createDataFrame(
        [(10, 7, "Completed", "a"), (11, 7, "Partial", None), (12, None, None, "b"), (13, 99, "Completed", "z")],
        "key int, hh int, result string, community string",
    )
    counts = monitor.frame_counts(frame, visits, ["hh"], "id", "place")
    joined = monitor.frame_join(frame, visits, ["hh"]).groupBy("place").agg(
        F.count("id").alias("sampled"),
        F.count("key").alias("visited"),
        F.count_if(F.col("result") == "Completed").alias("completed"),
        F.count_if(F.col("community").isNull()).alias("pending"),
    )
    assert rows(counts) == rows(joined) == [("a", 5, 4, 2, 3), ("b", 1, 1, 0, 0)]
    progress = monitor.progress(counts, "place")
    assert rows(progress.select("community", "sampled", "visited_pct", "completed_pct")) == [
        ("Total", 6, "83.3%", "33.3%"), ("a", 5, "80%", "40%"), ("b", 1, "100%", "0%"),
    ]


def test_zero_weight_expands_to_nothing_and_short_texts_to_no_triple(spark):
    df = spark.createDataFrame(
        [(1, Decimal("0")), (2, Decimal("2.5")), (3, Decimal("3.5")), (4, None), (5, Decimal("0.5"))],
        "id int, w decimal(18,8)",
    )
    assert rows(weights.expand_by_weight(df, "w").groupBy("id").count()) == [(2, 2), (3, 4)]
    assert values(spark, [(["a", "b"],), ([],), (["a", "b", "c", "d"],)], "t array<string>", trigrams("t")) == [
        [], [], ["a b c", "b c d"],
    ]


def test_cleaning_by_whole_words_and_the_historic_way(spark):
    texts = [("Nonessential, none",), ("we need that road to be fixed",), ("casino",), ("I say no",), ("##N/A##",), (None,)]
    plain = values(spark, texts, "t string", clean_answer("t"))
    assert plain == ["Nonessential, ", "   road  be fixed", "casino", " say ", "", None]
    historic = values(spark, texts, "t string", clean_answer("t", compat=True))
    assert historic == ["ssential, ", "  that road  be fixed", "casi", " say ", "", None]
    assert values(spark, [("déjà à la; l'a",)], "t string", clean_answer("t")) == ["déjà à la; l'"]


def test_words_keep_inner_apostrophes_and_accents(spark):
    assert values(spark, [("L'Élève doesn't -- 'quote' 3rd_x nai\u0308ve",), ("",), (None,)], "t string", words("t")) == [
        ["l'élève", "doesn't", "quote", "3rd_x", "nai\u0308ve"], [], None,
    ]


def test_missing_weight_is_in_neither_selected_nor_total(spark):
    df = spark.createDataFrame(
        [("A", 1, Decimal("1.5")), ("A", 1, None), ("A", None, Decimal("9")), ("A", 0, Decimal("2"))],
        "g string, m__1 int, w decimal(18,8)",
    )
    table = multiselect.banner_multi(df, ["m__1"], ["g"], "w", total=False)
    assert rows(table.select("selected", "total")) == [(Decimal(2), Decimal(4))]


def test_duration_with_and_without_days(spark):
    texts = [("00.01:02:03",), ("02.00:00:01",), ("bad",), (None,)]
    assert values(spark, texts, "d string", duration_seconds("d")) == [3723, 172801, None, None]
    assert values(spark, texts, "d string", duration_seconds("d", include_days=False)) == [3723, 1, None, None]


def test_identifiers_are_not_exported(spark):
    df = spark.createDataFrame([("k", "n", 1.0)], "interview_key string, head_name string, w double")
    assert privacy.anonymise(df, ["interview_key", "w"], {"w": "weight"}).columns == ["interview_key", "weight"]
    for leak in ("head_name", "hh_gps__lat", "visits__1"):
        with pytest.raises(ValueError, match=leak):
            privacy.anonymise(df, ["interview_key", leak])


def test_education_rules(spark):
    people = [
        (1, 8, None), (1, 9, None), (1, 17, None), (1, 19, None), (2, 5, 7), (2, None, 11), (2, None, 12), (2, None, 18),
        (2, None, 21), (2, None, 20), (None, 999999, None), (1, 14, None), (None, None, None), (1, None, 12),
    ]
    schema = "a int, c int, l int"
    assert values(spark, people, schema, education_attained("a", "c", "l")) == [
        "None/Some Primary", "Primary", "Secondary", "Tertiary", "None/Some Primary", "Primary", "Secondary", "Tertiary",
        "Never Attended", "None/Some Primary", "Not Stated", "Other", None, "Other",
    ]
    heads = values(spark, people, schema, education_attained("a", "c", "l", by_attendance=False))
    assert heads[11:] == ["Not Stated", None, "Secondary"]


def test_worker_rules(spark):
    people = [(1, 1), (4, 1), (5, 1), (888888, 1), (999999, 1), (None, 2), (None, 1), (7, 2)]
    schema = "t int, e int"
    assert values(spark, people, schema, worker_group("t", "e")) == [
        "Self Employed", "Employee", "Other", "Other", "Not Stated", "Not Employed", None, "Other",
    ]
    assert values(spark, people, schema, worker_group("t"))[5:] == ["Not Employed", "Not Employed", "Other"]


def test_recoding_of_levels(spark):
    data = [("a",), ("b",), ("c",), (None,)]
    assert values(spark, data, "x string", keep_or_other("x", ["a"])) == ["a", "Other", "Other", "Other"]
    assert values(spark, data, "x string", collapse("x", {"AB": ["a", "b"], "C": ["c"]})) == ["AB", "AB", "C", None]
    assert values(spark, data, "x string", collapse("x", {"AB": ["a", "b"]})) == ["AB", "AB", "c", None]
    assert values(spark, data, "x string", only_levels("x", ["c", "a"])) == ["a", None, "c", None]
    assert values(spark, data, "x string", level_index("x", ["c", "a"])) == [2, None, 1, None]
    assert values(spark, [(33,), (29,), (None,)], "age int", replace_value("age", 33, 29)) == [29, 29, None]


def test_small_text_helpers(spark):
    assert values(spark, [("a", None)], "x string, y string", paste("x", F.lit("-"), "y")) == ["a-NA"]
    assert values(spark, [("k4__k4__1",)], "x string", strip_prefix("x", "k4__")) == ["k4__1"]
    links = values(spark, [("id1",), (None,)], "x string", review_link("https://h/review/", "x"))
    assert links == ["https://h/review/id1", None]


def test_rating_counts_round_up_and_keep_missing_in_total(spark):
    df = spark.createDataFrame(
        [("A", 1, 5, Decimal("0.5")), ("A", 1, 5, Decimal("0.2")), ("A", 1, None, Decimal("1.1")), ("A", 1, 2, Decimal("2"))],
        "g string, item int, rate int, w decimal(18,8)",
    )
    table = rating.distribution(df, "item", "rate", ["g"], "w").filter("dimension = 'g'")
    assert [(r.answer, int(r.n), int(r.total)) for r in table.orderBy("answer").collect()] == [
        (None, 2, 5), (2, 2, 5), (5, 1, 5),
    ]
    wide = rating.distribution_wide(table).first()
    assert (wide["2"], wide["5"], wide["1"]) == (0.4, 0.2, None)
    means = rating.means(df, "item", "rate", ["g"], "w").filter("dimension = 'Total'").first()
    assert means["mean"] == pytest.approx((0.7 * 5 + 2 * 2) / 2.7)
