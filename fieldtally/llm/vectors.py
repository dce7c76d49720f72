"""Embedding near-duplicates with a robust-pruned flat graph.

Vectors of a label are dealt into overlapping cluster shards of bounded size.
Each shard builds a pruned neighbour graph, the adjacency lists of a vector
from all its shards are united, and every vector is looked up: a greedy search
from the medoid of its home shard, then an expansion over all that lies in
range, which follows the united lists out of the shard. Every pair is verified
in double precision, and the recall of the search is audited against brute
force before the result is accepted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.llm.components import components
from fieldtally.llm.tables import table
from fieldtally.session import settle

MIN_COSINE = 0.98
# Rows a shard aims at; a shard is built and searched in one task.
SHARD_ROWS = 2048
# A shard that stays over twice its size after this many splits is one dense heap and is compared in exact blocks.
MAX_SPLITS = 6
# Fit of a split: at most this many rows of a shard, at most this many clusters.
SAMPLE_ROWS, MAX_CLUSTERS = 1000, 32
# Graph: candidates looked at, neighbours kept near by and far off, and how much nearer a kept one must be to prune.
NEAR_CANDIDATES, NEAR, FAR, ALPHA = 48, 16, 8, 1.2
BEAM = 16
# Audit: vectors compared with all others, the recall asked for, and how often the beam is doubled for it.
AUDIT_VECTORS, MIN_RECALL, MAX_DOUBLINGS = 200, 0.95, 3
# Pairs a vector may have to look at outside its shard, on average; where there are more, blocks are compared.
CROSSINGS = 16

FOUND = "u long, v long, n long"
LISTS = "rep long, near array<struct<rep: long, close: boolean>>"


def classes(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """(rep, label, dims, embedding, copies): equal vectors of a label as one, named by their least key.

    Left out are vectors without key or label, null or empty ones, zero vectors,
    and those with a null or non-finite component.
    """
    value = F.col("embedding").cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    usable = vectors.where(F.col(key).isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    return (
        usable.groupBy("label", "embedding")
        .agg(F.min(key).alias("rep"), F.count("*").alias("copies"))
        .select("rep", "label", F.size("embedding").alias("dims"), "embedding", "copies")
    )


def _matrix(column) -> np.ndarray:
    """A column of equally long lists as unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    # Scaled first, so that the squares of very large or small components stay finite.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _clusters(rows: np.ndarray, k: int) -> np.ndarray:
    """k-means centres, first ones far from each other; fewer if the rows are fewer."""
    rng = np.random.default_rng(5)
    centres = [rows[0]]
    gap = np.full(len(rows), np.inf)
    while len(centres) < k:
        gap = np.minimum(gap, ((rows - centres[-1]) ** 2).sum(axis=1))
        if gap.sum() <= 0:
            break
        centres.append(rows[rng.choice(len(rows), p=gap / gap.sum())])
    centres = np.array(centres)
    for _ in range(8):
        own = (rows @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = rows[own == c].mean(axis=0)
    return centres


def _split(members: DataFrame, sizes: DataFrame, target: int) -> DataFrame:
    """The members of the shards in ``sizes`` (shard, n) dealt into clusters.

    A home member goes to its nearest cluster as home and to the second nearest
    as guest, a guest to its nearest only. Shards are salted by size, each salt
    with its own copy of the centres, so no task holds a whole large shard.
    """

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        k = int(min(MAX_CLUSTERS, max(2, -(-2 * rows.column("n")[0].as_py() // target))))
        centres = _clusters(_matrix(rows.column("embedding")), k)
        return pa.table({"shard": pa.array([key[0].as_py()]), "centres": pa.array([centres.ravel().tolist()], pa.list_(pa.float64()))})

    inside = members.join(sizes, "shard")
    some = inside.withColumn("__r", F.expr("row_number() OVER (PARTITION BY shard ORDER BY xxhash64(rep))")).where(f"__r <= {SAMPLE_ROWS}")
    centres = some.select("shard", "embedding", "n").groupBy("shard").applyInArrow(fit, "shard string, centres array<double>")
    salts = f"CAST(ceil(n / {target}) AS INT)"
    told = centres.join(sizes, "shard").withColumn("salt", F.explode(F.expr(f"sequence(0, {salts} - 1)")))
    blank = [F.lit(None).cast(t).alias(c) for c, t in members.dtypes if c != "shard"]
    told = told.select("shard", "salt", F.lit(0).alias("turn"), "centres", *blank)
    dealt = inside.withColumn("salt", F.expr(f"CAST(pmod(xxhash64(rep), {salts}) AS INT)")).select(
        "shard", "salt", F.lit(1).alias("turn"), F.lit(None).cast("array<double>").alias("centres"), *[c for c in members.columns if c != "shard"]
    )
    names = ["shard", *[c for c in members.columns if c != "shard"]]

    def assign(batches):
        centre = None
        for batch in batches:
            turn = batch.column("turn").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(turn == 0).tolist()
            for a, b in zip([-1, *starts], [*starts, batch.num_rows], strict=True):
                rows = batch.slice(a + 1, b - a - 1)
                if a >= 0:
                    centre = np.array(batch.column("centres")[a].as_py())
                if not rows.num_rows:
                    continue
                vectors = _matrix(rows.column("embedding"))
                c = centre.reshape(-1, vectors.shape[1])
                order = np.argsort(-(vectors @ c.T - 0.5 * (c**2).sum(axis=1)), axis=1, kind="stable")
                home = rows.column("home").to_numpy(zero_copy_only=False).astype(bool)
                for place, taken in ((0, np.ones(len(home), bool)), (1, home & (order.shape[1] > 1))):
                    at = np.flatnonzero(taken)
                    if not len(at):
                        continue
                    part = rows.take(pa.array(at))
                    shards = [f"{s}/{order[i, place]}" for s, i in zip(part.column("shard").to_pylist(), at, strict=True)]
                    columns = {n: part.column(n) for n in names}
                    columns["shard"] = pa.array(shards)
                    columns["home"] = pa.array(home[at] & (place == 0))
                    yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    stream = told.unionByName(dealt).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "turn")
    return stream.mapInArrow(assign, members.select(*names).schema).select(*members.columns)


def shards(reps: DataFrame, target: int = SHARD_ROWS) -> DataFrame:
    """(shard, home, rep, copies, embedding): every class in its home shard and as guest in shards next to it."""
    members = reps.select(
        F.concat_ws(":", "label", "dims").alias("shard"), F.lit(True).alias("home"), "rep", "copies", "embedding"
    )
    members = settle(members, "vector-members")
    done = []
    for _ in range(MAX_SPLITS):
        sizes = settle(members.groupBy("shard").agg(F.count("*").alias("n")).where(f"n > {target}"), "vector-sizes")
        if sizes.isEmpty():
            break
        done.append(members.join(sizes, "shard", "left_anti"))
        members = settle(_split(members, sizes, target), "vector-members")
    for part in done:
        members = members.unionByName(part)
    return members


def _pruned(i: int, order: np.ndarray, near: np.ndarray, keep: int) -> list[int]:
    """Neighbours of i out of ``order`` (nearest first): none that a kept one is nearer to by ALPHA."""
    out: list[int] = []
    gap = 2 - 2 * near[i, order]
    while len(order) and len(out) < keep:
        p = order[0]
        out.append(int(p))
        stay = ALPHA * (2 - 2 * near[p, order]) > gap
        stay[0] = False
        order, gap = order[stay], gap[stay]
    return out


def build(rows: pa.Table, min_cosine: float) -> pa.Table:
    """Adjacency lists (rep, near) of one shard: pruned near and far neighbours, and who points here.

    A neighbour is close if it is within twice the angle of ``min_cosine``: all
    that is in range of one point lies so, so a walk that stays in range needs
    no other edge.
    """
    vectors = _matrix(rows.column("embedding")).astype(np.float32)
    n = len(vectors)
    near = vectors @ vectors.T
    rng = np.random.default_rng(n)
    lists: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        some = np.argpartition(-near[i], min(NEAR_CANDIDATES, n - 1))[: NEAR_CANDIDATES + 1]
        far = rng.integers(0, n, 2 * FAR)
        for pool, keep in ((some, NEAR), (far, FAR)):
            pool = np.unique(pool[pool != i])
            for j in _pruned(i, pool[np.argsort(-near[i, pool], kind="stable")], near, keep):
                lists[i].add(j)
                lists[j].add(i)
    reps = rows.column("rep").to_numpy()
    ends = np.cumsum([0, *map(len, lists)])
    there = np.array([j for x in lists for j in sorted(x)], np.int64)
    here = np.repeat(np.arange(n), np.diff(ends))
    # A little room, as these products are in single precision.
    close = near[here, there] >= 2 * min_cosine**2 - 1 - 1e-5
    told = pa.StructArray.from_arrays([pa.array(reps[there], pa.int64()), pa.array(close)], names=["rep", "close"])
    return pa.table({"rep": pa.array(reps), "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)})


def _greedy(q: np.ndarray, vectors: np.ndarray, lists: list[np.ndarray], start: int, seen: np.ndarray, beam: int) -> list[int]:
    """The ``beam`` nearest points met on a best-first walk from ``start``; ``seen`` is marked along the way."""
    seen[start] = True
    at, near, opened = [start], [float(vectors[start] @ q)], [False]
    while not all(opened):
        i = opened.index(False)
        opened[i] = True
        new = lists[at[i]]
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        both = sorted(
            [*zip(near, at, opened, strict=True), *zip((vectors[new] @ q).tolist(), new.tolist(), [False] * len(new), strict=True)],
            key=lambda x: -x[0],
        )[:beam]
        near, at, opened = (list(x) for x in zip(*both, strict=True))
    return at


def search(rows: pa.Table, beam: int, min_cosine: float) -> pa.Table:
    """Links of one shard's home vectors, found over the united lists: see ``_told``.

    Close neighbours of what is in range that are in other shards are told as
    (u, v, -2), to be looked at there; a shard with more than CROSSINGS of them
    a vector says so with one row (null, null, -3) and tells none.
    """
    vectors = _matrix(rows.column("embedding"))
    reps = rows.column("rep").to_numpy()
    united = rows.column("near").combine_chunks()
    entry, ends = united.values.field("rep").to_numpy(zero_copy_only=False), united.offsets.to_numpy()
    order = np.argsort(reps, kind="stable")
    at = order[np.minimum(np.searchsorted(reps[order], entry), len(reps) - 1)]
    inner, close = reps[at] == entry, united.values.field("close").to_numpy(zero_copy_only=False).astype(bool)
    spans = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    lists = [at[x][inner[x]] for x in spans]
    outer = [entry[x][~inner[x] & close[x]] for x in spans]
    home = rows.column("home").to_numpy().astype(bool)
    medoid = int((vectors @ vectors.mean(axis=0)).argmax())
    us, vs = [], []
    crossing: list[tuple[int, np.ndarray]] = []
    room = CROSSINGS * len(reps)
    for i in np.flatnonzero(home):
        q = vectors[i]
        seen = np.zeros(len(vectors), bool)
        met = np.array(_greedy(q, vectors, lists, medoid, seen, beam))
        frontier = met[vectors[met] @ q >= min_cosine]
        # In range the walk goes on over everything in range, however many there are.
        inside = np.zeros(len(vectors), bool)
        inside[frontier] = True
        tried = np.zeros(len(vectors), bool)
        tried[met] = True
        while len(frontier):
            new = np.unique(np.concatenate([lists[j] for j in frontier]))
            new = new[~tried[new]]
            tried[new] = True
            frontier = new[vectors[new] @ q >= min_cosine]
            inside[frontier] = True
        inside[i] = True
        if room >= 0:
            away = [outer[j] for j in np.flatnonzero(inside) if len(outer[j])]
            if away:
                crossing.append((int(reps[i]), np.unique(np.concatenate(away))))
                room -= len(crossing[-1][1])
        inside[i] = False
        found = np.flatnonzero(inside)
        us.append(np.full(len(found), i))
        vs.append(found)
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    told = _told(u, v, reps, home, rows.column("copies").to_numpy())
    if room < 0:
        return pa.concat_tables([told, pa.table({"u": [None], "v": [None], "n": [-3]}, schema=told.schema)])
    u = np.repeat([i for i, _ in crossing], [len(x) for _, x in crossing]).astype(np.int64)
    v = np.concatenate([x for _, x in crossing]) if crossing else u
    return pa.concat_tables([told, pa.table({"u": u, "v": v, "n": np.full(len(u), -2)}, schema=told.schema)])


def block(rows: pa.Table, min_cosine: float) -> pa.Table:
    """Links between two pieces of a dense shard, or within one, by comparing all."""
    vectors = _matrix(rows.column("embedding"))
    piece = rows.column("own").to_numpy()
    home = rows.column("home").to_numpy().astype(bool)
    across = piece[:, None] != piece[None, :] if len(np.unique(piece)) > 1 else ~np.eye(len(piece), dtype=bool)
    # A pair of pieces holds each piece; what lies within one is found where it is compared with itself.
    if rows.column("p")[0].as_py() != rows.column("q")[0].as_py() and len(np.unique(piece)) == 1:
        across[:] = False
    u, v = np.nonzero((vectors @ vectors.T >= min_cosine) & across & home[:, None])
    return _told(u, v, rows.column("rep").to_numpy(), home, rows.column("copies").to_numpy())


def _told(u: np.ndarray, v: np.ndarray, reps: np.ndarray, home: np.ndarray, copies: np.ndarray) -> pa.Table:
    """What a task found, without listing all pairs.

    Pairs of two home vectors belong to this shard alone: (u, null, n) tells
    how many vectors u is linked to that way, and (u, v, 0) a forest that joins
    them. A pair with a guest may be found elsewhere too, so it is listed as
    (u, v, -1) and counted later.
    """
    n = len(reps)
    both = home[u] & home[v]
    a, b = u[both], v[both]
    # Either may have found the other.
    codes = np.unique(np.concatenate([a * n + b, b * n + a])) if len(a) else np.zeros(0, np.int64)
    a, b = codes // n, codes % n
    links = np.bincount(a, weights=copies[b], minlength=n).astype(np.int64)
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, root[a], root[b])
        root = root[root]
        if (root == before).all():
            break
    counted, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
    c, d = u[~both], v[~both]
    us = np.concatenate([reps[counted], reps[joined], reps[c]])
    vs = pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(reps[root[joined]], pa.int64()), pa.array(reps[d], pa.int64())])
    ns = np.concatenate([links[counted], np.zeros(len(joined), np.int64), np.full(len(c), -1)])
    return pa.table({"u": pa.array(us, pa.int64()), "v": vs, "n": pa.array(ns, pa.int64())})


def united_lists(members: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(rep, near): the adjacency lists of every shard, united per vector; at most a few shards hold one."""

    def building(rows: pa.Table) -> pa.Table:
        return build(rows, min_cosine)

    built = members.select("shard", "rep", "embedding").groupBy("shard").applyInArrow(building, LISTS)
    return built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def link(members: DataFrame, lists: DataFrame, dense: DataFrame, beam: int, target: int, min_cosine: float) -> DataFrame:
    """Links of all home members (see ``_told``): by search, in dense shards by exact blocks."""

    def searching(rows: pa.Table) -> pa.Table:
        return search(rows, beam, min_cosine)

    def comparing(rows: pa.Table) -> pa.Table:
        return block(rows, min_cosine)

    usual = members.join(dense, "shard", "left_anti").join(lists, "rep")
    searched = usual.select("shard", "home", "rep", "copies", "embedding", "near").groupBy("shard").applyInArrow(searching, FOUND)
    pieces = f"CAST(ceil(n / {target}) AS INT)"
    heap = members.join(dense, "shard").withColumn("own", F.expr(f"CAST(pmod(xxhash64(rep), {pieces}) AS INT)"))
    heap = heap.withColumn("other", F.explode(F.expr(f"sequence(0, {pieces} - 1)")))
    heap = heap.select(
        "shard", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "home", "rep", "copies", "embedding"
    )
    blocks = heap.groupBy("shard", "p", "q").applyInArrow(comparing, FOUND)
    return searched.unionByName(blocks)


def crossed(found: DataFrame, members: DataFrame, lists: DataFrame, most: int, min_cosine: float) -> DataFrame | None:
    """``found`` with what the search reaches in other shards in place of the (u, v, -2) it has to look at there.

    A pair that is in range leads on to the close neighbours of either end, until
    nothing new is met. Pairs at home in one shard are left to that shard. None
    if a round has more than ``most`` pairs: then blocks are cheaper.
    """

    def verify(batches):
        for batch in batches:
            dims = pc.list_value_length(batch.column("a")).to_numpy()
            for n in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == n)))
                cosine = np.einsum("ij,ij->i", _matrix(part.column("a")), _matrix(part.column("b")))
                yield part.select(["u", "v"]).filter(pa.array(cosine >= min_cosine))

    def unordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()

    told = found.where("n <= -2").agg(F.min("n")).first()[0]
    links = found.where("n >= -1")
    if told is None:
        return links
    if told == -3:
        return None
    at_home = members.where("home")
    ends = [at_home.select(F.col("rep").alias(k), F.col("shard").alias(f"{k}_shard"), F.col("embedding").alias(e)) for k, e in (("u", "a"), ("v", "b"))]
    asked = settle(unordered(found.where("n = -2")), "vector-crossings")
    tried = asked
    while (n := asked.count()) > 0:
        if n > most:
            return None
        pairs = asked.join(ends[0], "u").join(ends[1], "v").where("u_shard <> v_shard").select("u", "v", "a", "b")
        met = settle(pairs.mapInArrow(verify, "u long, v long"), "vector-crossed")
        links = links.union(met.select("u", "v", F.lit(-1).cast("long")))
        ways = met.union(met.select("v", "u")).withColumnRenamed("v", "rep").join(lists, "rep")
        on = ways.select("u", F.explode(F.filter("near", lambda x: x["close"])).alias("x")).select("u", F.col("x.rep").alias("v"))
        asked = settle(unordered(on).join(tried, ["u", "v"], "left_anti"), "vector-crossings")
        tried = tried.union(asked)
    return links


def counted(found: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, links): vectors linked to each class, its own copies left out."""
    own = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
    pairs = found.where("n = -1").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    ways = pairs.union(pairs.select("b", "a"))
    guests = ways.join(reps.select(F.col("rep").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("n"))
    return own.union(guests).groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))


def recall(reps: DataFrame, links: DataFrame, min_cosine: float = MIN_COSINE, queries: int = AUDIT_VECTORS) -> float:
    """Mean share of its true links that a vector has in ``links`` (rep, links), over vectors of every size of group; 1 without any.

    Half of the queries are any vectors, those without a link among them, and
    half are dealt out evenly over sizes of groups (one more for every doubling
    of the links), the first by a hash, so that one heap does not stand for all.
    The queries are a fixed number and go to every task, where each is compared
    with all vectors; tasks return one count per query. A vector counts once,
    whatever the number of its links.
    """
    sized = links.where("links > 0").select("rep", F.floor(F.log2("links")).alias("__size"))
    place = F.row_number().over(Window.partitionBy("__size").orderBy(F.xxhash64("rep")))
    spread = sized.withColumn("__at", place).where(f"__at <= {queries // 2}").orderBy("__at", "__size").limit(queries // 2)
    some = [reps.orderBy(F.xxhash64("rep")).limit(queries // 2), reps.join(spread.select("rep"), "rep", "left_semi")]
    chosen = some[0].union(some[1]).dropDuplicates(["rep"]).toArrow()
    if not chosen.num_rows:
        return 1.0
    asked: dict = {}
    for r, label, e in zip(chosen["rep"].to_pylist(), chosen["label"].to_pylist(), chosen["embedding"].to_pylist(), strict=True):
        asked.setdefault((label, len(e)), []).append((r, _matrix(pa.array([e]))[0]))

    def count(batches):
        true: dict[int, int] = {}
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dims").to_pylist()
            groups: dict = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                if key in asked:
                    groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                part = batch.take(pa.array(at))
                vectors, copies, own = _matrix(part.column("embedding")), part.column("copies").to_numpy(), part.column("rep").to_numpy()
                for r, q in asked[key]:
                    true[r] = true.get(r, 0) + int(copies[(vectors @ q >= min_cosine) & (own != r)].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(true), pa.int64()), pa.array(list(true.values()), pa.int64())], names=["rep", "n"])

    true = reps.select("rep", "label", "dims", "embedding", "copies").mapInArrow(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    share = F.least("n", F.coalesce("links", F.lit(0))) / F.col("n")
    shown = true.where("n > 0").join(links, "rep", "left").agg(F.avg(share)).first()[0]
    return 1.0 if shown is None else float(shown)


def exact_links(reps: DataFrame, target: int, min_cosine: float) -> DataFrame:
    """All links, by comparing every label's vectors in blocks: the way out where the search falls short."""
    members = reps.select(F.concat_ws(":", "label", "dims").alias("shard"), F.lit(True).alias("home"), "rep", "copies", "embedding")
    sizes = members.groupBy("shard").agg(F.count("*").alias("n"))
    return link(members, members.limit(0).select("rep", F.array("rep").alias("near")), sizes, BEAM, target, min_cosine)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", min_cosine: float = MIN_COSINE, target: int = SHARD_ROWS) -> DataFrame:
    """``vectors`` (key, embedding, label) with n_links, component_id and audited_recall.

    Vectors are compared only within a label and a length; those ``classes``
    leaves out link with nothing. Copies of a vector are one class while links
    are sought, and count as linked to each other. A vector without key has
    component null. Repeated rows are vectors of their own. Columns of the
    added names are replaced, others may have any name but the key's, embedding
    and label. An empty table gives no rows; ties do not arise. The search is
    audited, and if it still falls short with the widest beam, or meets too many
    pairs outside the shards, all vectors of a label are compared in blocks: ``audited_recall`` is under MIN_RECALL in no result.
    """
    vectors = vectors.drop("n_links", "component_id", "audited_recall")
    reps = settle(classes(vectors, key), "vector-classes")
    members = settle(shards(reps, target), "vector-shards")
    dense = settle(members.groupBy("shard").agg(F.count("*").alias("n")).where(f"n > {2 * target}"), "vector-dense")
    lists = settle(united_lists(members.join(dense, "shard", "left_anti"), min_cosine), "vector-lists")
    most = CROSSINGS * reps.count()
    beam, shown = BEAM, 0.0
    for _ in range(MAX_DOUBLINGS + 1):
        searched = settle(link(members, lists, dense, beam, target, min_cosine), "vector-links")
        found = crossed(searched, members, lists, most, min_cosine)
        if found is None:
            break
        links = settle(counted(found, reps), "vector-counts")
        shown = recall(reps, links, min_cosine)
        if shown >= MIN_RECALL:
            break
        beam *= 2
    if shown < MIN_RECALL:
        # A wider beam cannot find pairs whose shards never meet, and a heap over many shards has too many pairs to list.
        found = settle(exact_links(reps, target, min_cosine), "vector-links")
        links = settle(counted(found, reps), "vector-counts")
        shown = recall(reps, links, min_cosine)
    joined = components(found.where("v IS NOT NULL"))
    named = reps.join(links, "rep", "left").join(joined, reps["rep"] == joined["node"], "left").select(
        F.col("label").alias("__label"),
        F.col("embedding").alias("__embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    same = (vectors["label"] == named["__label"]) & (vectors["embedding"] == named["__embedding"]) & vectors[key].isNotNull()
    return vectors.join(named, same, "left").select(
        *[vectors[c] for c in vectors.columns],
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", vectors[key]).alias("component_id"),
        F.lit(shown).alias("audited_recall"),
    )


def op3_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    found = near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    return found.select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "audited_recall"
    )


OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
reach(r, id) AS (SELECT r, vec_id FROM ok UNION SELECT a, reach.id FROM reach JOIN links ON links.b = reach.r),
least AS (SELECT r, min(id) AS id FROM reach GROUP BY r),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least.id, vec_id) AS component_id,
  coalesce(vec_id = coalesce(least.id, vec_id), false) AS kept, CAST(1 AS DOUBLE) AS audited_recall
FROM v LEFT JOIN counts USING (r) LEFT JOIN least USING (r)
"""
