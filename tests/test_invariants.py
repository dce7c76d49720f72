"""Relations between results that hold for any data."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldtally.operators import banner, codebook, geo, linkage, monitor, multiselect, rating, tabulate, text, weights
from fieldtally.plans.base import DIMENSIONS, analysis_base, rating_base
from fieldtally.sources.views import OPTIONS, RESULTS, SurveyTables


@pytest.fixture(scope="module")
def tables(spark, folder):
    return SurveyTables(spark, folder)


@pytest.fixture(scope="module")
def base(tables):
    return analysis_base(tables).cache()


def test_banner_is_the_union_of_single_tables(base):
    table = banner.banner(base, "q1", DIMENSIONS, "ind_weight").drop("question")
    for d in DIMENSIONS:
        single = base.filter("q1 IS NOT NULL").groupBy(F.col(d).alias("item"), F.col("q1").alias("answer")).agg(
            F.coalesce(F.sum("ind_weight"), F.lit(0)).alias("n")
        )
        assert rows(table.filter(F.col("dimension") == d).select("item", "answer", "n")) == rows(single)


def test_many_questions_at_once_equal_them_one_by_one(base):
    report = banner.banner(base, ["q1", "q2"], DIMENSIONS, "ind_weight")
    for q in ("q1", "q2"):
        alone = banner.banner(base, q, DIMENSIONS, "ind_weight")
        assert rows(report.filter(F.col("question") == q)) == rows(alone)


def test_shares_of_an_item_sum_to_one(base):
    table = banner.banner(base, "q1", DIMENSIONS, "ind_weight").filter("total > 0")
    sums = [r[0] for r in table.groupBy("dimension", "item").agg(F.sum("prop")).select("sum(prop)").collect()]
    assert sums and all(s == pytest.approx(1) for s in sums)


def test_every_dimension_adds_up_to_the_total(base):
    table = banner.banner(base, "q1", DIMENSIONS, "ind_weight")
    per_dimension = {r[0]: r[1] for r in table.groupBy("dimension").agg(F.sum("n")).collect()}
    assert len(per_dimension) == 6 and len(set(per_dimension.values())) == 1


def test_margins_add_up(tables):
    table = tabulate.with_margins(tabulate.crosstab(tables.households, "community", "q1"))
    grand = table.filter("is_total AND col = 'Total'").first()["n"]
    assert grand == tables.households.count()
    assert table.filter("NOT is_total AND col <> 'Total' OR NOT is_total AND col IS NULL").agg(F.sum("n")).first()[0] == grand
    assert {r[0] for r in table.filter("col = 'Total'").select("prop").collect()} == {1.0}


def test_copies_equal_the_weight_sum(base):
    expanded = weights.expand_by_weight(base.select("interview_key", "ind_weight"), "ind_weight")
    assert expanded.count() == base.agg(F.sum(weights.copies("ind_weight"))).first()[0]


def test_large_weights_are_copied_in_blocks(spark):
    df = spark.createDataFrame([(1, 4096.0), (2, 4097.0), (3, 20000.4), (4, 1.0), (5, 0.0), (6, -3.0)], "id int, w double")
    counts = weights.expand_by_weight(df, "w").groupBy("id").count()
    assert rows(counts) == [(1, 4096), (2, 4097), (3, 20000), (4, 1)]


def test_weighted_likert_equals_likert_of_copies(tables, base):
    weight = weights.copies("ind_weight") * F.col("times")
    summed = rating.likert(rating_base(tables), "rated_item", "rate", "strata", weight)
    pairs = tables.ratings.join(base.select("interview_key", "strata", "ind_weight"), "interview_key")
    copied = rating.likert(weights.expand_by_weight(pairs, "ind_weight"), "rated_item", "rate", "strata")
    assert rows(summed) == rows(copied)


def test_item_shares_equal_those_of_copies(base):
    labels = {o: o.upper() for o in OPTIONS}
    summed = multiselect.item_shares(base, OPTIONS, labels, weights.copies("ind_weight"))
    copied = multiselect.item_shares(weights.expand_by_weight(base, "ind_weight"), OPTIONS, labels)
    assert rows(summed) == rows(copied)


def test_option_sums_equal_the_long_form(base):
    wide = multiselect.banner_multi(base, OPTIONS, ["strata"], "ind_weight", ceil_counts=False, total=False)
    long = base.select("strata", "ind_weight", *OPTIONS).unpivot(["strata", "ind_weight"], OPTIONS, "option", "v")
    sums = long.groupBy(F.lit("strata").alias("dimension"), F.col("strata").alias("item"), "option").agg(
        F.coalesce(F.sum(F.col("v") * F.col("ind_weight")), F.lit(0)).alias("selected"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("ind_weight"))), F.lit(0)).alias("total"),
    )
    assert rows(wide.select("dimension", "item", "option", "selected", "total")) == rows(sums)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)
    one = [(k if k else None, f"h{k}") for k in range(40)]
    # One key holds a third of the rows.
    keys = [rng.choice([5] * 20 + list(range(60))) for _ in range(300)]
    many = [(k if k else None, i, rng.random() < 0.5) for i, k in enumerate(keys)]
    return (
        spark.createDataFrame(one, "key int, head string"),
        spark.createDataFrame(many, "key int, member int, adult boolean"),
    )


def test_attach_many_is_a_left_join(sides):
    one, many = sides
    assert rows(linkage.attach_many(one, many, ["key"])) == rows(one.join(many, "key", "left"))


def test_counted_rows_stand_for_all_pairs(sides, spark):
    one, many = sides
    heads = one.unionByName(one.filter("key < 20")).unionByName(spark.createDataFrame([(5, "h5")] * 30, "key int, head string"))
    ratings = many.select("key", "adult")
    few = linkage.counted(heads)
    assert few.count() == heads.distinct().count() and rows(linkage.repeated(few)) == rows(heads)
    met = linkage.attach_matching(ratings, few, ["key"])
    assert rows(linkage.repeated(met), "key", "adult", "head") == rows(ratings.join(heads, "key"), "key", "adult", "head")


def test_full_outer_is_a_full_join(sides):
    one, many = sides
    assert rows(linkage.full_outer(one, many, ["key"])) == rows(one.join(many, "key", "full"))


@pytest.mark.parametrize("name, how", [("attach_many", "left"), ("full_outer", "full")])
@pytest.mark.parametrize("kept", ["one and many", "one", "many"])
def test_joins_of_repeated_and_missing_keys(spark, name, how, kept):
    one = [(1, "a", "x"), (1, "a", "y"), (1, None, "z"), (None, None, "z"), (2, "a", "x"), (2, "a", "x"), (None, "b", None)]
    many = [(1, "a", 1), (1, "a", 1), (1, None, 2), (None, None, 3), (3, "a", 4), (3, "a", None), (None, "b", 5)]
    one = spark.createDataFrame(one if "one" in kept else [], "k int, l string, head string")
    many = spark.createDataFrame(many if "many" in kept else [], "k int, l string, member int")
    assert rows(getattr(linkage, name)(one, many, ["k", "l"])) == rows(one.join(many, ["k", "l"], how))


def test_duplicates_are_all_rows_of_repeated_keys(sides):
    _, many = sides
    counted = many.withColumn("dupe_count", F.count("*").over(Window.partitionBy("key"))).filter("dupe_count > 1")
    assert rows(linkage.duplicate_keys(many, ["key"])) == rows(counted)


def test_semi_join_keeps_rows_once(sides):
    one, many = sides
    assert rows(linkage.keep_listed(one, "key", many)) == rows(one.join(many, "key", "left_semi"))


def test_numbering_in_parts_is_a_row_number(sides):
    _, many = sides
    order = [F.col("member")]
    parts = linkage.numbered(many, ["key"], F.expr("member div 16"), order, "i")
    plain = many.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    assert rows(parts) == rows(plain)


def test_systematic_sample_takes_its_number_from_each_stratum(spark):
    data = [(i, "big" if i % 10 else "small") for i in range(1000)] + [(1000 + i, "tiny") for i in range(3)]
    frame = spark.createDataFrame(data, "id int, stratum string")
    sample = weights.systematic_sample(frame, "stratum", "id", 40)
    assert rows(sample.groupBy("stratum").count()) == [("big", 40), ("small", 40), ("tiny", 3)]
    steps = [r.position for r in sample.filter("stratum = 'big'").orderBy("position").collect()]
    assert {b - a for a, b in zip(steps, steps[1:])} <= {22, 23}
    again = weights.systematic_sample(frame.repartition(5), "stratum", "id", 40)
    assert rows(sample) == rows(again)
    other = weights.systematic_sample(frame, "stratum", "id", 40, seed="second")
    assert rows(other.select("id")) != rows(sample.select("id"))


def test_design_weights_sum_to_the_frame(spark):
    frame = spark.createDataFrame([("a",)] * 50 + [("b",)] * 30 + [("c",)] * 5, "community string")
    done = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(16)], "key int, community string")
    adults = spark.createDataFrame([(i, 1 + i % 3) for i in range(15)], "key int, adults bigint")
    table = weights.design_weights(frame, done, adults, "community", "key")
    sums = rows(table.groupBy("community").agg(F.round(F.sum("hh_weight"), 6)))
    assert sums == [("a", 50.0), ("b", 30.0)]
    by_key = {r.key: r for r in table.collect()}
    assert by_key[2].ind_weight == by_key[2].hh_weight * 3 and by_key[15].ind_weight is None


def test_weights_of_the_published_shape(spark):
    """143 interviews, weights 0 among them: expanding keeps the rounded sum."""
    data = [(f"{i:02d}-00-00-{i:03d}", Decimal(i % 8) * Decimal("3.5"), Decimal(i % 34) * Decimal("2.69")) for i in range(143)]
    df = spark.createDataFrame(data, "interview_key string, hh decimal(18,8), ind decimal(18,8)")
    expected = sum(round(d[2]) for d in data)
    assert weights.expand_by_weight(df, "ind").count() == expected
    assert df.filter("hh = 0").count() == 18


def test_sample_size_of_the_report(spark):
    n = spark.range(1).select(weights.sample_size(F.lit(1698))).first()[0]
    assert round(n, 1) == 137.9


def test_centroids_of_known_shapes(spark):
    square = [("s", i + 1, x, y) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)])]
    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3), (0, 0)]
    shape = [("l", i + 1, float(x), float(y)) for i, (x, y) in enumerate(ell)]
    turned = [("r", i + 1, float(x), float(y)) for i, (x, y) in enumerate(reversed(ell))]
    tiny = [("t", i + 1, -88.7 + x * 1e-5, 17.2 + y * 1e-5) for i, (x, y) in enumerate(ell)]
    line = [("z", 1, 1.0, 1.0), ("z", 2, 3.0, 1.0), ("z", 3, 1.0, 1.0)]
    data = [(k, s, float(x), float(y)) for k, s, x, y in [*square, *shape, *turned, *tiny, *line]]
    points = geo.polygon_centroids(spark.createDataFrame(data, "polygon_id string, seq int, lon double, lat double"))
    got = {r.polygon_id: (r.lon, r.lat) for r in points.collect()}
    # Two rectangles: 4 by 1 and 1 by 2.
    x, y = (4 * 2 + 2 * 0.5) / 6, (4 * 0.5 + 2 * 2) / 6
    assert got["s"] == pytest.approx((1, 1))
    assert got["l"] == pytest.approx((x, y)) and got["r"] == pytest.approx((x, y))
    assert got["t"] == pytest.approx((-88.7 + x * 1e-5, 17.2 + y * 1e-5), abs=1e-10)
    assert got["z"] == pytest.approx((2, 1))


def test_codebook_decodes_and_drops_unused_levels(spark):
    book = codebook.codebook(spark, {"result": RESULTS, "sex": {1: "M", 2: "F"}})
    df = spark.createDataFrame([(1, 2), (3, 2), (9, None)], "result int, sex int")
    decoded = codebook.decode(df, book, ["result", "sex"])
    assert rows(decoded.select("result_label", "result_order", "sex_label")) == [
        (None, None, None), ("Completed", 1, "F"), ("Refused", 3, "F"),
    ]
    assert rows(codebook.observed_levels(df, book, ["result", "sex"]).select("variable", "code")) == [
        ("result", 1), ("result", 3), ("sex", 2),
    ]
    table = spark.createDataFrame([("Partial", 4), ("Odd", 1)], "label string, n int")
    ordered = codebook.with_codebook_order(table, book, "result", "label")
    assert rows(ordered.select("label", "level_order")) == [("Odd", None), ("Partial", 2)]


def test_chart_labels_only_where_shown(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), (None, "x")], "g string, f string")
    table = monitor.chart_shares(df, "g", "f", {"a": ["x"]})
    assert rows(table.select("x", "fill", "n", "label")) == [(None, "x", 1, ""), ("a", "x", 2, "66.7%"), ("a", "y", 1, "")]
    assert rows(monitor.chart_shares(df, "g", "f").select("label")) == [("100%",), ("33.3%",), ("66.7%",)]


def test_map_status_of_one_community(spark):
    joined = spark.createDataFrame(
        [(1, "c", "Ann", 5, "i5", "Completed"), (2, "c", "Bo", 6, "i6", None), (3, "c", "Cy", None, None, None), (4, "d", "Di", 7, "i7", "Partial")],
        "frame_id int, frame_community string, frame_head string, interview_key int, interview_id string, result string",
    )
    table = monitor.map_status(joined, "c", "https://h")
    assert rows(table.select("frame_id", "colour")) == [(1, "green"), (2, "white"), (3, "white")]
    assert rows(table.select("frame_id", "head", "result", "link")) == [
        (1, "Ann", "Completed", "https://h/i5"), (2, "Bo", None, "https://h/i6"), (3, "Cy", None, None),
    ]


def brute_triples(texts):
    import re
    from collections import Counter

    out = Counter()
    for t in texts:
        w = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", t.lower())
        out.update(" ".join(w[i : i + 3]) for i in range(len(w) - 2))
    return out


def test_triples_and_words_against_brute_force(spark):
    texts = ["big red bus big red bus", "Red bus stop", "two words", "", "big RED bus"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    expected = brute_triples(texts)
    assert {r.words: r.n for r in text.trigram_counts(df, "t").collect()} == dict(expected)
    assert rows(text.most_common(text.trigram_counts(df, "t"), "words", 2)) == [("big red bus", 3), ("bus big red", 1)]
    assert rows(text.word_counts(df, "t", ["two", "stop"])) == [("big", 3), ("bus", 4), ("red", 4), ("words", 1)]
    stop = spark.createDataFrame([("two",), ("stop",)], "word string")
    assert rows(text.word_counts(df, "t", stop)) == rows(text.word_counts(df, "t", ["two", "stop"]))


def test_grand_total_share_and_empty_groups(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), (None, "x", 4)], "r string, c string, n int")
    shares = tabulate.with_share(df, [])
    assert rows(shares.select("r", "c", "total", "prop")) == [(None, "x", 8, 0.5), ("a", "x", 8, 0.125), ("a", "y", 8, 0.375)]
    zero = tabulate.with_share(spark.createDataFrame([("a", 0)], "r string, n int"), ["r"])
    assert zero.first()["prop"] is None
    total = tabulate.grand_total(spark.createDataFrame([(1, None), (2, 3)], "x int, y int"), ["x", "y"], strict=True)
    assert rows(total) == [(3, None)]


def test_one_way_table_includes_missing(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "v string")
    assert rows(tabulate.oneway(df, "v")) == [(None, 1, 4, 0.25), ("a", 2, 4, 0.5), ("b", 1, 4, 0.25)]
    hidden = tabulate.crosstab(df.withColumn("w", F.lit("z")), "v", "w", show_missing=False)
    assert rows(hidden) == [("a", "z", 2), ("b", "z", 1)]


def test_conditional_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "g string, x int")
    table = tabulate.conditional_counts(
        df, ["g"], {"ones": F.col("x") == 1, "missing": F.col("x").isNull(), "present": F.col("x").isNotNull()}
    )
    assert rows(table) == [("a", 1, 1, 1), ("b", 0, 0, 1)]
