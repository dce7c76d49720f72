"""Near-duplicates, tokens, URL lists, shards and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import rows
from plain import ODD, plain_hits, plain_spans
from pyspark.sql import functions as F

import corpus_pipeline
from fieldtally.llm import components, personal, pieces, quality, registry, shards, simhash, urls, vectors


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


def joined(n, pairs):
    """Least member of the component of each of n points."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_against_union_find(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(300, 420)]
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + chain + [(5, 5), (7, 200), (200, 7)]
    links = spark.createDataFrame([*pairs, (None, 3)], "u long, v long")
    want = joined(421, pairs)
    got = components.components(links).collect()
    assert {(r.node, r.component) for r in got} == {(x, want[x]) for a, b in pairs if a != b for x in (a, b)}
    assert len(got) == len({r.node for r in got})
    assert components.components(links.limit(0)).count() == 0


def test_the_hot_node_of_a_star_is_split(spark):
    """A star's middle has all the links: the tasks of the joins share them."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        star = spark.range(1, 200_000, 1, 8).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
        held = []
        step = components._large_star(star, held)
        step.collect()
        assert "skew=true" in step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert components.components(star).where("component <> 0").isEmpty()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(docs):
    prints = [plain_fingerprint(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = joined(len(docs), pairs)
    least = {}
    for (key, _), r in zip(docs, root, strict=True):
        if key is not None:
            least[r] = min(key, least.get(r, key))
    return prints, [least.get(r) for r in root], root


def test_simhash_query_against_all_pairs(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    prints, groups, _ = plain_groups(docs)
    got = rows(registry.queries()["op5_simhash"](spark, folder), "doc_id", "fingerprint", "component_id")
    assert got == sorted((k, f"{p:016x}", g) for (k, _), p, g in zip(docs, prints, groups, strict=True))


def test_simhash_odd_rows(spark, odd):
    prints, groups, _ = plain_groups(ODD)
    got = rows(simhash.near_duplicates(odd).select("doc_id", simhash.hex_digits().alias("h"), "component"))
    want = [(k, f"{p:016x}", g) for (k, _), p, g in zip(ODD, prints, groups, strict=True)]
    assert got == sorted(want, key=lambda r: [(v is not None, v) for v in r])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_anchors_meet_and_pieces_lose_nothing(spark):
    rng = random.Random(6)
    # A dense heap, pairs at every distance up to six bits, and loners.
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)}
    for _ in range(150):
        a = rng.getrandbits(64)
        fps |= {a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))}
    fps = sorted(fps)
    want = joined(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for piece in (simhash.PIECE, 20):
        links = [(int(np.int64(r.u).view(np.uint64)), int(np.int64(r.v).view(np.uint64))) for r in simhash.links(table, piece=piece).collect()]
        assert all((u ^ v).bit_count() <= 4 or piece for u, v in links)
        place = {f: i for i, f in enumerate(fps)}
        assert joined(len(fps), [(place[u], place[v]) for u, v in links]) == want


def test_one_of_each_group_stays(spark, odd):
    extra = [(20, "a b c d e"), (21, "A B C D E"), (19, "a b  c d e"), (5, "same text")]
    docs = [*ODD, *extra]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    _, groups, root = plain_groups(docs)
    got = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert len(got) == len(set(root)) and got == sorted({(g is None, g) for g in groups})


def test_one_of_each_group_stays_with_maps_beside(spark):
    data = [(1, "a b c", {"x": 1}, [{"y": 2}]), (2, "a b c", None, None), (1, "a b c", {"x": 1}, [{"y": 2}]), (3, "quite other words", {}, [])]
    frame = spark.createDataFrame(data, "doc_id long, text string, __hash map<string,int>, fp array<map<string,int>>").withColumnRenamed("__hash", "extra")
    kept = simhash.keep_one(frame)
    assert kept.dtypes == frame.dtypes and sorted((r.doc_id, r.extra) for r in kept.collect()) == [(1, {"x": 1}), (3, {})]


# Embeddings


def plain_links(vectors_):
    ok = [v is not None and lab is not None and k is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for k, v, lab in vectors_]
    pairs = []
    for i, (_, v, a) in enumerate(vectors_):
        for j in range(i):
            w, b = vectors_[j][1:]
            if ok[i] and ok[j] and a == b and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    pairs.append((i, j))
    counts = [0] * len(vectors_)
    for i, j in pairs:
        counts[i] += 1
        counts[j] += 1
    least = {}
    root = joined(len(vectors_), pairs)
    for (k, _, _), r in zip(vectors_, root, strict=True):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return counts, [least.get(r) for r in root]


def heaps(seed, n=420):
    """Vectors of two labels: heaps of near copies, exact copies and loners."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 16))
    out = []
    for i in range(n):
        c = centres[int(rng.integers(0, 40)) if i % 3 else 0]
        v = c + rng.normal(size=16) * (0.03 if i % 5 else 1.0)
        out.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    out += [(n + i, out[3][1], out[3][2]) for i in range(15)]
    return out


@pytest.mark.parametrize("target", [2048, 60])
def test_vectors_against_all_pairs(spark, target):
    data = heaps(target)
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicates(frame, target=target).collect()}
    counts, groups = plain_links(data)
    true, found = sum(counts), sum(min(c, got[k].n_links) for (k, _, _), c in zip(data, counts, strict=True))
    assert len(got) == len(data) and found >= 0.97 * true
    assert all(got[k].n_links <= c for (k, _, _), c in zip(data, counts, strict=True))
    assert sum(got[k].component_id == g for (k, _, _), g in zip(data, groups, strict=True)) >= 0.97 * len(data)
    assert got[0].audited_recall >= 0.9


def test_a_short_search_is_made_good_exactly(spark, monkeypatch):
    """A search that finds next to nothing is not accepted: all pairs are compared then."""
    data = heaps(7, 260)
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(vectors, "MAX_DOUBLINGS", 0)
    nothing = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    monkeypatch.setattr(vectors, "search", lambda rows, beam, min_cosine: nothing)
    got = {r.vec_id: r for r in vectors.near_duplicates(frame, target=60).collect()}
    counts, groups = plain_links(data)
    assert [(got[k].n_links, got[k].component_id) for k, _, _ in data] == list(zip(counts, groups, strict=True))
    assert got[0].audited_recall == 1.0


def test_the_audit_weighs_vectors_and_not_links(spark):
    """One heap found whole and thirty pairs lost: most vectors have lost their links."""
    data = [(i, [1.0, 0.0001 * i, 0.0, 0.0], 1) for i in range(200)] + [(1000 + 2 * i + j, [0.0, *np.eye(3)[i % 3] * (1 + i // 3)], 100 + i) for i in range(30) for j in (0, 1)]
    data = [(k, [float(x + 0.001 * (k % 2)) for x in v], lab) for k, v, lab in data]
    reps = vectors.classes(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    true, _ = plain_links(data)
    links = spark.createDataFrame([(k, n if k < 1000 else 0) for (k, _, _), n in zip(data, true, strict=True)], "rep long, links long")
    assert vectors.recall(reps, links) < vectors.MIN_RECALL
    whole = spark.createDataFrame([(k, n) for (k, _, _), n in zip(data, true, strict=True)], "rep long, links long")
    assert vectors.recall(reps, whole) == 1.0


def test_dense_shards_are_compared_in_blocks(spark):
    data = [(i, [1.0, 0.001 * i, 0.0], 1) for i in range(120)] + [(500 + i, [0.0, 1.0, 0.01 * i], 1) for i in range(9)]
    reps = vectors.classes(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    members = reps.select(F.lit("a").alias("shard"), F.lit(True).alias("home"), "rep", "copies", "embedding")
    dense = spark.createDataFrame([("a", 129)], "shard string, n long")
    lists = spark.createDataFrame([], "rep long, near array<long>")
    found = vectors.link(members, lists, dense, 16, 25, 0.98)
    counts, groups = plain_links(data)
    assert dict(vectors.counted(found, reps).collect()) == {k: c for (k, _, _), c in zip(data, counts, strict=True) if c}
    named = dict(components.components(found.where("v IS NOT NULL")).collect())
    assert [named.get(k, k) for k, _, _ in data] == groups


def two_shards(spark):
    """Two heaps in range, one vector of the first a guest in the second's shard, and a chain of a third shard behind it."""
    data = [(i, [1.0, 0.001 * i, 0.0], 1) for i in range(1, 9)] + [(20 + i, [1.0, 0.05 + 0.04 * i, 0.0], 1) for i in range(8)]
    data += [(40, [0.0, 1.0, 0.0], 1), (41, [0.0, 0.0, 1.0], 1)]
    reps = vectors.classes(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    home = F.when(F.col("rep") < 20, "a").when(F.col("rep") < 24, "b").otherwise("c")
    members = reps.select(home.alias("shard"), F.lit(True).alias("home"), "rep", "copies", "embedding")
    guests = members.where("rep IN (8, 23)").withColumns({"shard": F.when(F.col("rep") == 8, "b").otherwise("c"), "home": F.lit(False)})
    return data, reps, members.union(guests)


def test_the_search_leaves_the_shard(spark):
    data, reps, members = two_shards(spark)
    dense = spark.createDataFrame([], "shard string, n long")
    lists = vectors.united_lists(members)
    inside = vectors.link(members, lists, dense, 16, 25, 0.98)
    counts, _ = plain_links(data)
    want = {k: c for (k, _, _), c in zip(data, counts, strict=True) if c}
    short = dict(vectors.counted(inside, reps).collect())
    assert sum(short.values()) < sum(want.values())
    found = vectors.crossed(inside, members, lists, 1000, 0.98)
    assert dict(vectors.counted(found, reps).collect()) == want
    # Nothing is cut where there is too much to look at: the caller compares blocks.
    assert vectors.crossed(inside, members, lists, 3, 0.98) is None


def test_too_many_crossings_are_compared_in_blocks(spark, monkeypatch):
    data, reps, members = two_shards(spark)
    monkeypatch.setattr(vectors, "CROSSINGS", 0)
    monkeypatch.setattr(vectors, "shards", lambda reps, target: members)
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
    counts, groups = plain_links(data)
    assert [(got[k].n_links, got[k].component_id) for k, _, _ in data] == list(zip(counts, groups, strict=True))


def test_vectors_query_against_all_pairs(spark, folder):
    data = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    counts, groups = plain_links(data)
    got = rows(registry.queries()["op3_vectors"](spark, folder), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted((k, c, g, k == g) for (k, _, _), c, g in zip(data, counts, groups, strict=True))


def test_vectors_odd_rows(spark):
    data = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [float("nan"), 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-30, 0.0], 1),
        (13, [1e30, 1e27], 1), (None, [1.0, 0.0], 1), (14, [float("inf"), 0.0], 1),
    ]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = rows(vectors.near_duplicates(frame), "vec_id", "n_links", "component_id")
    counts, groups = plain_links(data)
    want = [(k, c, g) for (k, _, _), c, g in zip(data, counts, groups, strict=True)]
    assert got == sorted(want, key=lambda r: [(v is not None, v) for v in r])
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


# Pieces


def test_pieces_against_the_library(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    strange = ["", " ", "   ", "a ", " a", "a  b   c", "▁a ▁▁ b▁", "x\ny \t z", "ü😀é ﬁ①　w", "<s> </s> <unk> <0x0A>", "a\u0000b", "word" * 5000, None]
    strange = spark.createDataFrame([(-i, t) for i, t in enumerate(strange, 1)] + ODD, "doc_id long, text string")
    docs = docs.union(strange)
    for r in pieces.encode(docs, decoded=True).collect():
        ids = [*model.encode(r.text or ""), model.eos_id()]
        assert r.ids == ids and r.decoded == model.decode(ids), r.doc_id
    back = pieces.decode(pieces.encode(strange)).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)
    for r in pieces.token_digests(strange).join(strange.select(F.col("doc_id").alias("d"), "text").distinct(), F.col("d") == F.col("doc_id")).collect():
        ids = [*model.encode(r.text or ""), model.eos_id()]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert pieces.encode(docs.limit(0)).count() == 0


def test_small_word_table_changes_nothing():
    with open(pieces.public_model(), "rb") as file:
        proto = file.read()
    small, large = pieces.Encoder(proto, 3), pieces.Encoder(proto)
    for text in ("a b c d e f a b", "one  two three ", "a", "z y x w a b "):
        assert small.ids(text) == large.ids(text) == large.model.encode(text)
    assert large.alone


# URLs


def test_urls_odd_rows(spark):
    data = [
        (1, None), (2, ""), (3, "no scheme/en/"), (4, "http://"), (5, "HTTP://WWW.Example.COM/en/x?y#z"), (6, "http://example.com/en"),
        (7, "http://com/"), (8, "http://com"), (9, "http://xcom/"), (10, "a://b.net/fr/?q"), (11, "a://net/frr/"), (12, "a://b.example.com/en/x://y"),
        (13, "http://notexample.com/en/"), (14, "http://spam.example.org/a/?x"), (15, "https://spam.example.org/a#y"), (16, "http://spam.example.org/b"),
        (5, "HTTP://WWW.Example.COM/en/x?y#z"), (17, "http://.com/"), (18, "http://a..net/es/"),
    ]
    pages = spark.createDataFrame([(*r, "old") for r in data], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("spam.example.org/a",), ("spam.example.org/a",), (None,), ("com",)], "url string")
    entries = urls.rule_entries(spark).unionByName(urls.listed_entries(listed))
    got = rows(urls.judge(pages, entries), "page_id", "rule", "verdict")
    want = {
        5: ("www.example.com/en/", "allow"), 6: ("com/", "allow"), 7: ("com/", "allow"), 8: (None, "block"), 10: ("net/fr/", "block"),
        12: ("example.com/en/", "block"), 13: ("com/", "allow"), 14: (None, "block"), 15: (None, "block"), 17: ("com/", "allow"), 18: ("net/es/", "block"),
    }
    assert got == sorted(((k, *want.get(k, (None, "allow"))) for k, _ in data), key=lambda r: [(v is not None, v) for v in r])
    assert urls.judge(pages.limit(0), entries).count() == 0
    assert {r.verdict for r in urls.judge(pages, entries.limit(0)).collect()} == {"allow"}


def plain_canonical(host, path):
    host = re.sub(r"\.*(:(80|443)?)?$", "", host.split("@")[-1])
    path = re.sub("%([0-9A-Fa-f]{2})", lambda m: c if re.fullmatch("[A-Za-z0-9._~-]", c := chr(int(m[1], 16))) else m[0].upper(), path)
    done = []
    for i, part in enumerate(path.split("/")):
        if i == 0 or part not in (".", ".."):
            done.append(part)
        elif part == "..":
            done[1:] = done[1:-1]
    return host + re.sub("/$", "", "/".join(done)) if host else None


def test_canonical_urls(spark):
    rng = random.Random(5)
    bits = ["a", "%41", "%2e", "%2F", "%e4", "%", "%4", "~", "/", "/", "/.", "/..", "/../", "/./", "..", ".a", "ß"]
    hosts = ["h.org", "u:p@h.org", "u@h.org:80", "h.org:443", "h.org.", "h.org.:", "h.org:8080", "@", ":80", "a@b@h.org", ""]
    data = [(rng.choice(hosts), "/" * rng.randint(0, 1) + "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for _ in range(3000)]
    data = [(h, p if p[:1] in ("/", "") else "/" + p) for h, p in data]
    found = spark.createDataFrame(data, "host string, path string").select("host", "path", urls.canonical().alias("c")).collect()
    assert [r.c for r in found] == [plain_canonical(r.host, r.path) for r in found]
    same = ["http://h.org/a/b", "https://u@H.org:443/a/b/", "http://h.org./x/../a/./b?q", "http://h.org:80/%61/b#f", "http://h.org/a%2fb"]
    pages = spark.createDataFrame(list(enumerate(same)), "page_id int, url string")
    entries = urls.listed_entries(spark.createDataFrame([("h.org/a/b",)], "url string"))
    assert [r.verdict for r in urls.judge(pages, entries).orderBy("page_id").collect()] == ["block"] * 4 + ["allow"]


def test_urls_sql_has_the_same_canonical_form(spark, tmp_path):
    import duckdb

    host = "spam-farm.example.org"
    odd = [f"http://{host}/a/%62", f"http://u@{host}:80/x/../a/b/", f"http://{host}./a/./b", f"http://{host}:81/a/b", f"http://{host}", "", "x"]
    odd += [f"http://{host}.:443/%", f"http://{host}/%", f"http://{host}/a%2fb", f"http://{host}/a/..", f"http://{host}/%C3%a4", f"https://{host}:443/%c3%A4"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*odd, None])], "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = sorted(db.execute(f"SELECT page_id, verdict FROM ({urls.OP8_SQL})").fetchall())
    found = sorted((r.page_id, r.verdict) for r in urls.op8_urls(spark, str(tmp_path)).collect())
    assert found == want and len({v for _, v in want}) == 2


def test_rules_met_by_key_and_in_tasks_agree(spark, monkeypatch):
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "org"]
    paths = ["/", "/e", "/en/", "/en/x", ""]
    rules = [(rng.choice(("allow", "block")), rng.choice(hosts), rng.choice(paths)) for _ in range(14)]
    made = [f"http://{rng.choice(['', 'c.', 'd.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '/en'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "k", 7) for i, u in enumerate(made * 2)], "page_id int, url string, key string, __key_0 int")
    entries = urls.rule_entries(spark, rules).unionByName(urls.listed_entries(pages.limit(5).select(F.expr("substr(url, 8)").alias("url"))))
    got = urls.judge(pages, entries)
    assert got.columns == ["page_id", "url", "key", "__key_0", "host", "path", "rule", "verdict"]
    in_tasks = rows(got, *got.columns)
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert rows(urls.judge(pages, entries), *got.columns) == in_tasks
    for page_id, _, _, _, host, path, rule, _ in in_tasks:
        fit = [h + p for _, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert rule == (max(fit, key=lambda r: (len(r), r)) if fit else None), page_id


def test_bloom_filter_keeps_every_key(spark):
    keys = spark.range(5000).selectExpr("concat('host', id, '/path') AS key")
    blocks, n = urls.bloom_blocks(keys, 5000)
    assert urls.possible(keys, "key", blocks, n).count() == 5000
    others = spark.range(20_000).selectExpr("concat('other', id, '/path') AS key")
    assert urls.possible(others, "key", blocks, n).count() < 400


# Shards


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 4), (3, 3), (4, 2)])
def test_curve_steps_to_neighbours(spark, dims, bits):
    cells = spark.range(1 << (dims * bits))
    axes = [f"a{i}" for i in range(dims)]
    cells = cells.select(*[F.expr(f"CAST(shiftright(id, {bits * i}) & {(1 << bits) - 1} AS INT)").alias(a) for i, a in enumerate(axes)])
    cells = cells.select("*", *[F.col(a).alias(f"c{a}") for a in axes])
    walk = [tuple(r)[:-1] for r in shards.with_curve(cells, [f"c{a}" for a in axes], bits).orderBy("curve").collect()]
    assert len(set(walk)) == 1 << (dims * bits)
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(walk, walk[1:], strict=False))


def check_shards(found, texts, n_shards=16):
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert sorted((r.shard, r.slot) for r in found) == [x[:2] for x in sorted((r.shard, r.slot, r.curve) for r in found)]
    in_order = [r.curve for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert in_order == sorted(in_order)


def test_shards_query(spark, folder):
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    found = registry.queries()["op10_hilbert"](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    check_shards(found, texts)


def test_shards_odd_rows(spark, tmp_path):
    data = [(i, t, [None, "en", "de"][n % 3], "s") for n, (i, t) in enumerate(ODD)] + [(None, None, None, None)] * 40
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/a/documents.parquet")
    found = registry.queries()["op10_hilbert"](spark, f"{tmp_path}/a").collect()
    assert len(found) == len(data)
    sizes = [sum(r.shard == s for r in found) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert registry.queries()["op10_hilbert"](spark, f"{tmp_path}/b").count() == 0


def test_quantile_borders_are_exact(spark):
    rng = random.Random(8)
    sets = [
        [10**15, *range(2000)],
        [-(2**63), 2**63 - 1, *[2**i for i in range(62)], *[-(2**i) for i in range(62)]] * 3,
        [7] * 900 + [8] * 50 + list(range(100, 150)),
        [None] * 300 + [5, 6] * 20,
        [rng.randrange(40) ** 9 for _ in range(500)] + [None] * 31,
        [3] * 11,
        [None] * 4,
        [],
    ]
    for values in sets:
        df = spark.createDataFrame([(v,) for v in values], "v long")
        found = shards.with_cells(df, [shards.Dimension("v", F.col("v"))]).select("v", "__cell_0").collect()
        for v, cell in found:
            below = sum(x is None or x < v for x in values) if v is not None else 0
            assert cell == below * 16 // len(values), (v, cell)
        assert len(found) == len(values)


def test_an_outlier_leaves_its_dimension(spark):
    data = [(i, f"site_{i % 200:03d}") for i in range(2000)] + [(10**15, "wiki")]
    df = spark.createDataFrame(data, "doc_id long, source string")
    celled = shards.with_cells(df, [shards.Dimension("doc_id", F.col("doc_id")), shards.Dimension("source", shards.text_value(df, "source"))])
    assert celled.groupBy("__cell_0").count().agg(F.max("count")).first()[0] <= 126


def test_shards_prune_files(spark, tmp_path):
    """Files along the curve are left out by ranges of every dimension; files in the order of one prune by that alone."""
    rng = random.Random(9)
    data = [(i, rng.randrange(10**6), rng.randrange(10**6)) for i in range(16_000)]
    spark.createDataFrame(data, "doc_id long, a long, b long").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    placed = shards.hilbert_shards(df, [shards.Dimension(c, F.col(c)) for c in ("a", "b")], ["doc_id"], 64)
    shards.write_shards(placed, f"{tmp_path}/out", 250)
    back = spark.read.parquet(f"{tmp_path}/out").withColumn("file", F.input_file_name())
    assert sorted(tuple(r) for r in back.select("doc_id", "a", "b").collect()) == data
    files = [tuple(r) for r in back.groupBy("file", "shard").agg(*[f(c) for c in "ab" for f in (F.min, F.max)], F.count("*")).collect()]
    assert len(files) >= 64 and max(f[-1] for f in files) <= 500

    def read(column, low):
        return sum(f[2 + 2 * column] <= low + 50_000 and f[3 + 2 * column] >= low for f in files) / len(files)

    shares = [read(c, rng.randrange(950_000)) for c in (0, 1) for _ in range(40)]
    # Sorted by doc_id every file spans both dimensions: a share of 1. A curve over two leaves about 1/8 + 1/16.
    assert sum(shares) / len(shares) < 0.3 and max(shares) < 0.5


def test_written_shards_are_runs_of_slots(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    placed = registry.queries()["op10_hilbert"](spark, folder).select("doc_id", "shard", "slot")
    shards.write_shards(docs.join(placed, "doc_id"), f"{tmp_path}/out", 40)
    back = spark.read.parquet(f"{tmp_path}/out").withColumn("file", F.input_file_name())
    assert back.count() == docs.count()
    runs = back.groupBy("shard", "file").agg(F.min("slot").alias("low"), F.max("slot").alias("high"), F.count("*").alias("n")).collect()
    assert all(r.high - r.low + 1 == r.n for r in runs) and len(runs) > 16


# Pipeline


def test_stages_and_run_against_plain_versions(spark, folder):
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs.select("doc_id", "text"), quality.usable_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    good = {r.doc_id for r in quality.score(docs, model).where(f"score >= {quality.THRESHOLD}").collect()}
    kept = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    _, groups, _ = plain_groups(kept)
    kept = [d for d, g in zip(kept, groups, strict=True) if d[0] == g]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    indexed = {}
    for item_id, item in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.lower())
        for i in range(max(1, len(words) - 12)):
            indexed.setdefault(tuple(words[i : i + 13]), []).append((item_id, " ".join(words[i : i + 13])))
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    want = {}
    for key, text in kept:
        near = {x for words in indexed.values() for x in words if x[1].split()[0] in text.lower()}
        n, hit, _ = plain_hits(text, [x for x in near if x[1] in " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))])
        if hit and 20 * hit >= n:
            continue
        if hit:
            want[key] = None
            continue
        out, at = "", 0
        for kind, a, b in sorted(plain_spans(text), key=lambda s: s[1:]):
            if a >= at:
                out += text[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        ids = [*sp.encode(out + text[at:]), sp.eos_id()]
        want[key] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(want)
    assert all(v is None or got[k] == v for k, v in want.items())


CLASHING = ["score", "fp", "n_words", "hit_runs", "hit_items", "base", "spans", "places", "digest", "found", "component", "h", "h2", "ids"]


def test_columns_of_any_name_are_kept(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    texts = [(1, "mail a1@b.example.com now"), (2, "clean words of no note at all here"), (3, item), (4, "w " * 900 + item), (5, None)]
    docs = spark.createDataFrame([(*t, *[f"{c}{t[0]}" for c in CLASHING]) for t in texts], ["doc_id", "text", *CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns
        kept = made.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in kept for c in CLASHING)
        if name == "benchmark":
            assert {r.doc_id for r in kept} == {1, 2, 4, 5} and {r.doc_id: r.text for r in kept}[2] == texts[1][1]
        if name == "personal":
            assert {r.doc_id: r.text for r in kept}[1] == "mail <EMAIL> now"
    found = personal.with_spans(docs)
    assert found.columns == [*[c for c in docs.columns if c not in ("base", "spans")], "base", "spans"]
    assert {r.doc_id: len(r.spans) for r in found.collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0}


def test_stages_keep_columns_and_stand_odd_rows(spark, folder):
    data = [(i, t, "en", "s", len(t or ""), n) for n, (i, t) in enumerate(ODD)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.personal_stage(spark, docs, folder).count() == len(data)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "personal", "pieces"]


WITHOUT_PACKAGE = """
import sys
sys.path[:0] = {paths!r}
import pyarrow as pa
from fieldtally.llm import registry
from fieldtally.session import build_session

spark = build_session("alone", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir={shared!r})
spark.sparkContext.setLogLevel("ERROR")

def known(batches):
    for batch in batches:
        try:
            import fieldtally
            yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])
        except ModuleNotFoundError:
            yield pa.RecordBatch.from_arrays([pa.array([0])], names=["n"])

assert spark.range(4).mapInArrow(known, "n long").agg({{"n": "sum"}}).first()[0] == 0
for name, query in registry.queries().items():
    query(spark, {folder!r}).write.format("noop").mode("overwrite").save()
    print("done", name, flush=True)
"""


def test_tasks_need_no_package(tmp_path, folder):
    """Every query and the pipeline where workers cannot import this package: another folder, no PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = WITHOUT_PACKAGE.format(paths=[root], shared=str(tmp_path / "shared"), folder=folder)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert ran.returncode == 0, ran.stderr[-3000:]
    assert [x.split()[1] for x in ran.stdout.splitlines() if x.startswith("done")] == list(registry.queries())
