"""Packed counts, folded codebooks, triples by bounds, rings of polygons, counts that are carried and not copied."""

from __future__ import annotations

import random
from collections import Counter
from math import prod

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_plans import physical

from fieldtally.operators import codebook, geo, monitor, packing, tabulate, text
from fieldtally.operators.banner import banner
from fieldtally.operators.multiselect import banner_multi
from fieldtally.plans import catalog


def shuffled_rows(df):
    """Most rows that any shuffle of the plan that ran has written."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(n):
        name = n.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(n.executedPlan())
        if "QueryStage" in name:
            return walk(n.plan())
        if name == "Exchange":
            found.append(n.metrics().apply("shuffleRecordsWritten").value())
        for i in range(n.children().size()):
            walk(n.children().apply(i))

    walk(node)
    return max(found)


def test_packs_stay_under_their_bound():
    rng = random.Random(3)
    for _ in range(50):
        units = {f"u{i}": [rng.randint(1, 30) for _ in range(rng.randint(1, 2))] for i in range(rng.randint(1, 60))}
        groups = packing.pack(units, 2000)
        assert sorted(u for g in groups for u in g) == sorted(units)
        for g in groups:
            assert len(g) == 1 or prod(n + 1 for u in g for n in units[u]) <= 2000


def test_forty_variables_in_one_pass(spark):
    """Rows are as good as all different over forty variables; packed, a task sends on few."""
    n, bound = 20_000, 600
    names = [f"v{i}" for i in range(40)]
    some = [F.when(F.rand(i) < 0.9, F.floor(F.rand(100 + i) * (2 + i % 6)).cast("int")).alias(v) for i, v in enumerate(names)]
    df = spark.range(0, n, 1, 4).select(*some, (F.col("id") % 7).cast("decimal(10,2)").alias("w")).cache()
    assert df.select(*names).distinct().count() > 0.99 * n
    levels = {v: 2 + i % 6 for i, v in enumerate(names)}
    units = {v: [F.col(v)] for v in names}
    counts = packing.packed_counts(df, units, F.count("*"), {v: [k] for v, k in levels.items()}, bound)
    groups = packing.pack({v: [k] for v, k in levels.items()}, bound)
    assert shuffled_rows(counts) <= 4 * len(groups) * bound < 4 * n
    assert "FileScan" not in physical(counts) and physical(counts).count("Range") <= 2
    data = df.collect()
    want = Counter((v, None if r[v] is None else str(r[v])) for r in data for v in names)
    assert {(r.unit, r.level[0]): r.n for r in counts.collect()} == want
    table = tabulate.descriptives(df, names, "w", levels)
    total = sum(r.w for r in data)
    assert {r.total for r in table.collect()} == {total}
    weighted = Counter()
    for r in data:
        for v in names:
            weighted[v, None if r[v] is None else str(r[v])] += r.w
    assert {(r.dimension, r.item): r.n for r in table.collect()} == weighted
    book = codebook.codebook(spark, {v: {k: f"{v} {k}" for k in range(12)} for v in names})
    seen = codebook.observed_levels(df, book, names, levels)
    assert {(r.variable, r.code) for r in seen.collect()} == {(v, int(x)) for v, x in want if x is not None}
    bars = monitor.chart_counts(df, {"one": (F.col("v3"), None), "two": (F.col("v4"), F.col("v5"))})
    pairs = Counter(("two", *(None if x is None else str(x) for x in (r.v4, r.v5))) for r in data)
    ones = Counter(("one", None if r.v3 is None else str(r.v3), None) for r in data)
    assert {(r.chart, r.x, r.fill): r.n for r in bars.collect()} == pairs + ones
    df.unpersist()


def test_fifty_variables_are_decoded_without_a_join(spark):
    names = [f"v{i}" for i in range(50)]
    book = codebook.codebook(spark, {v: {k: f"{v}={k}" for k in range(1, 5)} for v in names} | {"other": {1: "x"}})
    df = spark.range(60).select(F.col("id").alias("key"), *[((F.col("id") + i) % 6).cast("int").alias(v) for i, v in enumerate(names)])
    decoded = codebook.decode(df, book, names)
    assert "Join" not in physical(decoded)
    for r in decoded.collect():
        for i, v in enumerate(names):
            k = (r.key + i) % 6
            assert (r[f"{v}_label"], r[f"{v}_order"]) == ((f"{v}={k}", k) if 1 <= k <= 4 else (None, None))
    assert codebook.decode(df, book.limit(0), ["v1"]).where("v1_label IS NOT NULL").isEmpty()
    twice = book.union(book.where("variable = 'v7' AND code = 2"))
    with pytest.raises(Exception, match="listed twice"):
        codebook.decode(df, twice, names).collect()
    # A variable that is not asked for may be listed as it likes.
    assert codebook.decode(df, twice, ["v1"]).where("v1_label IS NOT NULL").count() == 40


def answers(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "answer string").repartition(4)


def test_triples_by_bounds_equal_the_full_count(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    heavy = ["alpha beta gamma delta"] * 40 + ["one two three"] * 30 + ["red green blue"] * 30
    noise = [" ".join(rng.choices(words, k=30)) for _ in range(300)]
    tied = [f"t{i} u{i} v{i}" for i in range(60)]
    cases = {"heavy": heavy + noise, "all tied": tied, "ties at the end": heavy + tied * 2, "none": [], "short": ["one two", None, ""], "few": ["a1 b1 c1 d1"]}
    for name, some in cases.items():
        frame = answers(spark, some)
        full = text.trigram_counts(frame, "answer")
        for k in (1, 4, 25):
            for buckets in (7, 1 << 12):
                got = text.top_trigrams(frame, "answer", k, buckets=buckets)
                assert [tuple(r) for r in got.collect()] == [tuple(r) for r in text.most_common(full, "words", k).collect()], (name, k, buckets)


def test_triples_that_cannot_be_among_the_first_are_not_shuffled(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    frame = answers(spark, ["alpha beta gamma delta"] * 60 + ["one two three four"] * 50 + [" ".join(rng.choices(words, k=40)) for _ in range(400)])
    full = text.trigram_counts(frame, "answer")
    top = text.top_trigrams(frame, "answer", 4, buckets=1 << 14)
    assert rows(top) == rows(text.most_common(full, "words", 4))
    assert full.count() > 14_000
    # The result was among the largest buckets: nothing is left but to read it.
    assert "Generate" not in physical(top)
    close = text.top_trigrams(frame, "answer", 5, buckets=64)
    assert rows(close) == rows(text.most_common(full, "words", 5))


RING = "polygon_id string, ring int, hole boolean, seq int, lon double, lat double"


def ring(name, number, points, hole=False):
    return [(name, number, hole, i, float(x), float(y)) for i, (x, y) in enumerate(points)]


def box(x, y, w, h, turned=False):
    points = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return points[::-1] if turned else points


def test_outlines_with_holes_and_parts(spark):
    x0, y0, s = -88.7, 17.2, 1e-4
    data = [
        # A block with a court, the court's ring running the other way.
        *ring("court", 1, box(0, 0, 10, 10)), *ring("court", 2, box(6, 6, 2, 2, True), True),
        # The same with directions that cannot be trusted.
        *ring("same way", 1, box(0, 0, 10, 10)), *ring("same way", 2, box(6, 6, 2, 2), True),
        # Two parts, one of them with two holes.
        *ring("parts", 1, box(0, 0, 4, 4)), *ring("parts", 2, box(10, 0, 2, 2)), *ring("parts", 3, box(1, 1, 1, 1, True), True), *ring("parts", 4, box(1, 2, 1, 1, True), True),
        # A building far from the origin.
        *ring("far", 1, [(x0 + x * s, y0 + y * s) for x, y in box(0, 0, 10, 10)]), *ring("far", 2, [(x0 + x * s, y0 + y * s) for x, y in box(6, 6, 2, 2, True)], True),
        *ring("plain", 7, box(1, 1, 2, 2)), *ring("line", 1, [(0, 0), (2, 2)]), *ring("line", 2, [(4, 4)]),
        ("nowhere", 1, False, 1, None, 1.0),
    ]
    random.Random(1).shuffle(data)
    frame = spark.createDataFrame(data, RING).repartition(3)
    court = (10 * 10 * 5 - 4 * 7) / 96
    px = (16 * 2 + 4 * 11 - 1.5 - 1.5) / 18
    py = (16 * 2 + 4 * 1 - 1.5 - 2.5) / 18
    want = {
        "court": (court, court), "same way": (court, court), "parts": (px, py), "far": (x0 + court * s, y0 + court * s), "plain": (2, 2), "line": (2, 2), "nowhere": (None, None),
    }
    for part in (geo.PART, 2):
        told = {r.polygon_id: (r.lon, r.lat) for r in geo.polygon_centroids(frame, part=part, ring="ring", hole="hole").collect()}
        assert set(told) == set(want)
        for name, point in want.items():
            assert told[name] == (pytest.approx(point, abs=1e-10) if point[0] is not None else point), name
        turned = {r.polygon_id: (r.lon, r.lat) for r in geo.polygon_centroids(frame, part=part, ring="ring").collect()}
        assert all(turned[n] == pytest.approx(told[n], abs=1e-10) for n in ("court", "parts", "far", "plain"))


def test_unknown_order_is_an_error(spark):
    schema = "polygon_id string, seq int, lon double, lat double"
    ell = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    good = [("g", i, float(x), float(y)) for i, (x, y) in enumerate(ell)]
    want = rows(geo.polygon_centroids(spark.createDataFrame(good, schema)))
    # A row that is given twice, and one without a place or order, change nothing.
    again = spark.createDataFrame([*good, good[2], ("g", None, None, 1.0)], schema)
    assert rows(geo.polygon_centroids(again)) == want
    for bad in ([("g", None, float(x), float(y)) for x, y in ell], [*good, ("g", 3, 9.0, 9.0)], [*good, ("g", None, 5.0, 5.0)]):
        with pytest.raises(Exception, match="unknown order in polygon g"):
            geo.polygon_centroids(spark.createDataFrame(bad, schema)).collect()


def test_times_counts_like_copies(spark):
    data = [("Yes", "a", 1, 2, "1.50000000"), ("No", "a", None, 3, "2.25000000"), ("Yes", "b", 0, 1, None), (None, "b", 1, 4, "1.00000000"), ("Yes", None, 1, 0, "3.00000000")]
    df = spark.createDataFrame(data, "q string, g string, m int, times long, w string").withColumn("w", F.col("w").cast("decimal(18,8)"))
    rows_of = df.where("times > 0").withColumn("__c", F.explode(F.expr("array_repeat(0, CAST(times AS INT))"))).drop("__c", "times")
    counted = df.where("times > 0")
    for weight in (None, "w"):
        assert rows(banner(counted, "q", ["g"], weight, times="times")) == rows(banner(rows_of, "q", ["g"], weight))
        assert rows(banner_multi(counted, ["m"], ["g"], weight, times="times")) == rows(banner_multi(rows_of, ["m"], ["g"], weight))


def test_questions_side_by_side_count_like_rows(spark):
    data = [
        ("Yes", 1, "a", 2, "1.50000000"), ("No", None, "a", 3, "2.25000000"), ("Yes", 2, "b", 1, None), (None, 2, "b", 4, "1.00000000"),
        ("Yes", 2, None, 1, "3.00000000"), ("DK", 1, "c", 1, None), (None, None, "d", 5, "0.00000000"), ("No", 3, "a", 2, "0.12345678"),
    ]
    df = spark.createDataFrame(data, "q string, r int, g string, times long, w string").withColumn("w", F.col("w").cast("decimal(18,8)"))
    df = df.withColumn("d", F.col("w").cast("double"))
    levels = {"q": ["Yes", "No", "DK", "Never given"], "r": ["1", "2", "3"]}
    for weight in (None, "w", "d"):
        for times in (None, "times"):
            for more in ({}, {"drop_null_answer": False}, {"drop_null_item": True}, {"ceil_counts": True}, {"total": False}):
                long = banner(df, ["q", "r"], ["g"], weight, times=times, **more)
                packed = banner(df, ["q", "r"], ["g"], weight, times=times, levels=levels, **more)
                assert packed.schema.simpleString() == long.schema.simpleString()
                assert rows(packed) == rows(long)
    assert rows(banner(df.limit(0), ["q", "r"], ["g"], "w", levels=levels)) == []
    assert rows(banner(df, "q", [], "w", levels=levels)) == rows(banner(df, "q", [], "w"))


def test_an_answer_outside_the_levels_is_an_error(spark):
    df = spark.createDataFrame([("Yes", "a"), ("Perhaps", "a"), (None, "b")], "q string, g string")
    with pytest.raises(Exception, match="answers to q that are not among its levels, rows: 1"):
        banner(df, "q", ["g"], levels={"q": ["Yes", "No"]}).collect()


def test_many_questions_multiply_no_rows(spark, folder):
    """Eighty-eight questions: rows reach the sums as they are, and few leave a task."""
    plan = physical(catalog.queries()["banner_report"](spark, folder))
    below = plan[plan.rindex("partial_sum(CASE WHEN (q1") :]
    assert "Expand" not in below and "Generate" not in below and "SortAggregate" not in plan
    questions = {f"q{i}": ["a", "b", "c", "d"] for i in range(88)}
    df = spark.range(20000).select((F.col("id") % 3).cast("string").alias("g"), *[F.element_at(F.array(*map(F.lit, "abcd")), ((F.col("id") * (i + 1)) % 4 + 1).cast("int")).alias(q) for i, q in enumerate(questions)])
    assert rows(banner(df, list(questions), ["g"], levels=questions)) == rows(banner(df, list(questions), ["g"]))


@pytest.mark.parametrize("name", ["banner_single", "banner_report", "banner_unweighted", "banner_multi", "multi_unweighted", "yes_share", "multi_item_share", "likert_overall"])
def test_banners_copy_no_rows(name, spark, folder):
    plan = physical(catalog.queries()[name](spark, folder))
    assert "array_repeat" not in plan
