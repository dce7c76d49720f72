"""Search, codes and clusters of whole-number vectors against plain versions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldtally.llm import centroids, codes, integers, registry, topk

TABLE = "vec_id long, embedding array<float>, label int"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def clumps(seed, n, dims, copies=0):
    """Vectors in clumps, some loners, and ``copies`` rows of one vector."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, dims)) / 4
    out = [(i, [float(np.float32(x)) for x in middles[i % 7] * (i % 11 > 0) + rng.normal(size=dims) * (0.02 if i % 5 else 0.3)], i % 4 or None) for i in range(n)]
    return out + [(n + i, out[5][1], 2) for i in range(copies)]


ODD_VECTORS = [
    (1, None, 1), (2, [float("nan"), 1.0, 0.0, 2.0], 1), (3, [1.0, None, 0.0, 2.0], 1), (4, [float("inf"), 1.0, 0.0, 2.0], 2), (5, [], 1),
    (6, [1.0, 2.0], None), (7, [0.0, 0.0, 0.0, 0.0], 3), (20, [1.0, -1.0, 0.5, -0.5], 1), (20, [1.0, -1.0, 0.5, -0.5], 1), (20, [-1.0, 0.25, 3.0, 0.1], 2),
    (None, [1.0, -1.0, 0.5, -0.5], 1), (40, [1.0, -1.0, 0.5, -0.5], None), (60, [-0.001, 0.001, -1.0, 1.0], 3), (80, [9.0] * 5, 3), (100, None, 1), (120, [], 1), (None, [0.3, 0.3, 0.3, 0.3], 3),
]


# Whole numbers


def test_products_and_distances_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for top in (3, 1000, 2**20, 2**27):
        a, b = rng.integers(-top, top, (5, 16)), rng.integers(-top, top, (7, 16))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
        assert integers.products(a, b).tolist() == want
        assert integers.distances(a, b).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(u, v, strict=True)) for v in b] for u in a]


def test_huge_components_are_held_so_that_distances_fit(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38] * 32)], "vec_id long, embedding array<float>")
    code = df.select(integers.whole("embedding", 1024)).first()[0]
    assert set(code) == {2**26, -(2**26)}
    v = np.array([code], np.int64)
    assert integers.distances(v, -v)[0, 0] == 64 * 2**54


# Search


def plain_top(data, asked, k, scale):
    ok = [(i, key, floors(v, scale)) for i, (key, v, *_) in enumerate(data) if fine(v)]
    out = []
    for i, key, q in ok:
        if key is None or not asked(key):
            continue
        scored = [(-sum(a * b for a, b in zip(q, d, strict=True)), other is None, other or 0, j) for j, other, d in ok if j != i and len(d) == len(q)]
        for rank, (s, gone, other, _) in enumerate(sorted(scored)[:k], 1):
            out.append((key, rank, None if gone else other, -s))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("small", [False, True])
def test_search_against_all_scores(spark, small, monkeypatch):
    if small:  # many ranges, pages and waves on few rows
        for name, value in (("RANGE", 16), ("BLOCK", 4), ("CHUNK", 3), ("PAGE", 5), ("WAVES", [1, 2, 1 << 30])):
            monkeypatch.setattr(topk, name, value)
    data = clumps(3, 500, 12, copies=60)
    got = rows(topk.top_k(spark.createDataFrame(data, TABLE), F.col("vec_id") % 20 == 0, 20))
    assert got == plain_top(data, lambda key: key % 20 == 0, 20, topk.SCALE)


def test_search_prunes_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    data = np.repeat(rng.integers(-60, 60, (7, 12)), 100, axis=0) + rng.integers(-4, 5, (700, 12))
    starts = np.arange(0, len(data), topk.BLOCK)
    doc = {"code": data, "number": np.arange(700), "first": np.arange(700), "high": np.maximum.reduceat(data, starts), "low": np.minimum.reduceat(data, starts)}
    asks, scored = data[1::88], []
    plain = topk.products
    most = topk.bounds(asks, doc["high"], doc["low"])
    true = plain(asks, data)
    assert all((true[:, s : s + topk.BLOCK].max(axis=1) <= most[:, b]).all() for b, s in enumerate(starts))
    monkeypatch.setattr(topk, "products", lambda a, b: scored.append(len(a) * len(b)) or plain(a, b))
    q, s, d = topk.walk(asks, np.full(8, topk.LOWEST), doc, 5)
    bounding = 2 * 8 * len(starts)
    assert sum(scored) - bounding < 0.5 * true.size
    for i in range(8):
        assert list(zip(s[q == i].tolist(), d[q == i].tolist(), strict=True)) == [(-a, b) for a, b in sorted(zip((-true[i]).tolist(), range(700), strict=True))[:5]]


def test_search_odd_rows(spark):
    frame = spark.createDataFrame([(*r, "x", 7) for r in ODD_VECTORS], TABLE + ", score string, code int")
    got = rows(topk.top_k(frame, F.col("vec_id") % 20 == 0, 20))
    assert got == plain_top(ODD_VECTORS, lambda key: key % 20 == 0, 20, topk.SCALE)
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(frame, F.lit(False)).count() == 0


def test_a_vector_of_a_third_of_all_rows_is_a_few_rows(spark):
    data = [(i, [0.5, 0.25] if i % 3 == 0 else [i / 500, 1 - i / 400], 1) for i in range(900)]
    frame = spark.createDataFrame(data, TABLE)
    reps = topk.classes(frame, F.col("vec_id") % 20 == 0, "vec_id", "embedding", 64, 20)
    assert reps.agg(F.max(F.size("ids"))).first()[0] == 21
    assert rows(topk.top_k(frame, F.col("vec_id") % 20 == 0, 20)) == plain_top(data, lambda key: key % 20 == 0, 20, 64)


# Codes


def plain_codes(data, n_parts, n_entries, rounds, scale):
    ok = [(key, floors(v, scale), label) for key, v, label in data if fine(v) and v and len(v) % n_parts == 0]
    if not ok:
        return [], []
    sizes = [len(v) for _, v, _ in ok]
    usual = min(set(sizes), key=lambda n: (-sizes.count(n), n))
    ok = [r for r in ok if len(r[1]) == usual]
    w = usual // n_parts
    first = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:n_entries]
    books = [[v[p * w : (p + 1) * w] for _, v, _ in first] for p in range(n_parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(n_parts):
            members = {}
            for _, v, _ in ok:
                members.setdefault(nearest(v[p * w : (p + 1) * w], books[p])[1], []).append(v[p * w : (p + 1) * w])
            books[p] = [[sum(x) // len(x) for x in zip(*members[i], strict=True)] if i in members else e for i, e in enumerate(books[p])]
    out = []
    for key, v, label in ok:
        best = [nearest(v[p * w : (p + 1) * w], books[p]) for p in range(n_parts)]
        out.append((key, label, [i for _, i in best], sum(d for d, _ in best)))
    return out, books


def bag(found):
    return sorted(found, key=repr)


@pytest.mark.parametrize("data", [clumps(8, 330, 8, copies=70), clumps(9, 40, 16), ODD_VECTORS], ids=["clumps", "few", "odd"])
def test_codes_against_plain_rounds(spark, data, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 8)
    monkeypatch.setattr(codes, "PAGE", 48)
    want, books = plain_codes(data, 4, 32, 4, 1024)
    made = codes.compress(spark.createDataFrame(data, TABLE), keep=["vec_id", "label"], entries=32)
    assert made.books == books
    assert bag((r.vec_id, r.label, list(r.entries), r.error) for r in made.coded.collect()) == bag(want)


def test_codes_keep_columns_of_any_name_and_empty_tables(spark):
    names = "embedding array<float>, vec_id long, row string, part string, __row int, error string, code int"
    frame = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], 1, "a", "b", 3, "c", 4), ([1.0, 2.0, 3.0, 9.0], 2, "a", "b", 3, "c", 4)], names)
    made = codes.compress(frame)
    assert made.coded.columns == ["embedding", "vec_id", "row", "part", "__row", "code", "entries", "error"]
    assert [(r.vec_id, r.row, r.part, r.code, list(r.entries), r.error) for r in made.coded.orderBy("vec_id").collect()] == [(1, "a", "b", 4, [0] * 4, 0), (2, "a", "b", 4, [0, 0, 0, 1], 0)]
    none = codes.compress(frame.limit(0))
    assert none.coded.count() == 0 and none.books == [[]] * 4


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2), (16, 1)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
    places = codes.hilbert(cells, bits)
    assert sorted(places.tolist()) == list(range(len(cells)))
    walked = cells[np.argsort(places)]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_keep_the_nearest_and_drop_others():
    rng = np.random.default_rng(2)
    book = rng.integers(-400, 400, (64, 4))
    members = (rng.integers(-400, 400, (50, 1, 4)) + rng.integers(-25, 25, (50, 16, 4)))
    short = codes.shortlists(members.min(axis=1), members.max(axis=1), book)
    for block, able in zip(members, short, strict=True):
        assert able[integers.distances(block, book).argmin(axis=1)].all()
    assert short.mean() < 0.2


# Clusters


def plain_clusters(data, k, rounds, dims, scale, seed="3"):
    ok = [(key, floors(v, scale)) for key, v, *_ in data if fine(v) and len(v) == dims]
    hashed = sorted(ok, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(now))

    for _ in range(rounds):
        members = {}
        for _, v in ok:
            members.setdefault(nearest(v)[1], []).append(v)
        now = [[sum(x) // len(x) for x in zip(*members[i], strict=True)] if i in members else c for i, c in enumerate(now)]
    return [(key, *nearest(v)[::-1]) for key, v in ok], now


@pytest.mark.parametrize(
    ("data", "dims"),
    [(clumps(4, 400, 10, copies=90), 10), (clumps(5, 5, 10), 10), (ODD_VECTORS, 4), ([(i, [i % 3 / 2, 0.0, 0.0], 1) for i in range(40)], 3), ([(i, [0.25, 0.5], 1) for i in range(20)], 2)],
    ids=["clumps", "few", "odd", "line", "copies"],
)
def test_clusters_against_plain_rounds(spark, data, dims):
    want, middles = plain_clusters(data, 8, 10, dims, 1024)
    got, found = centroids.cluster(spark.createDataFrame(data, TABLE), keep=["vec_id"], dims=dims)
    assert found == middles
    assert bag(tuple(r) for r in got.collect()) == bag(want)


def test_clusters_keep_columns_of_any_name_and_empty_tables(spark):
    frame = spark.createDataFrame([([1.0, 2.0], 1, "a", "b", 5), ([1.0, 3.0], 2, "a", "b", 5)], "embedding array<float>, vec_id long, codes string, apex string, cluster int")
    got, middles = centroids.cluster(frame, dims=2)
    assert got.columns == ["embedding", "vec_id", "codes", "apex", "cluster", "distance"] and len(middles) == 2
    assert {(r.vec_id, r.codes, r.apex, r.distance) for r in got.collect()} == {(1, "a", "b", 0), (2, "a", "b", 0)}
    none, middles = centroids.cluster(frame.limit(0), dims=2)
    assert none.count() == 0 and middles == [] and centroids.with_inertia(none, middles).count() == 0


def test_simplex_bounds_hold_and_filter():
    rng = np.random.default_rng(6)
    middles = rng.integers(-400, 400, (8, 24))
    values = middles[rng.integers(0, 8, 500)] + rng.integers(-60, 60, (500, 24))
    now = middles + rng.integers(-20, 20, (8, 24))
    for points in (middles, middles[:1], np.repeat(middles[:2], 3, axis=0), np.vstack([middles[:3], middles[:1] + 1])):
        base = centroids.base_of(points)
        a, c = base.apexes(values), base.apexes(now)
        true = integers.distances(values, now)
        low = ((a[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (low <= true * (1 + 1e-9) + 1e-3).all()
        assert (true <= low + 4 * a[:, -1:] * c[:, -1] + true * 1e-9 + 1e-3).all()
        able = centroids.candidates(a, c)
        assert able[np.arange(500), true.argmin(axis=1)].all()
    base = centroids.base_of(middles)
    assert centroids.candidates(base.apexes(values), base.apexes(now)).sum(axis=1).mean() < 1.5


@pytest.mark.parametrize("name", ["op11_topk", "op12_codes", "op13_centroids"])
def test_queries_over_empty_and_odd_tables(spark, tmp_path, name):
    frame = spark.createDataFrame(ODD_VECTORS, TABLE)
    frame.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    frame.write.parquet(f"{tmp_path}/odd/embeddings.parquet")
    query = registry.queries()[name]
    none, odd = query(spark, f"{tmp_path}/none"), query(spark, f"{tmp_path}/odd")
    assert none.count() == 0 and none.columns == odd.columns and none.dtypes == odd.dtypes
    odd.collect()
