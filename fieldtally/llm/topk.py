"""Exact top-k search by block-at-a-time pruning.

Different vectors are put in an order that keeps near ones together and cut
into document ranges of many small blocks. A block keeps its forward index (the
vectors) and, of every component, its greatest and least value: a query's
greatest possible score in the block is the sum of its terms' maxima, taken
from the greatest value where the query is positive and from the least where it
is negative. A query walks the blocks of its own range first, from the highest
bound down, until the bounds fall below its k-th score; then ranges, in waves
of falling bounds, and in each range the blocks in the same way. Bounds and
scores are whole numbers, so the result is exact; only ranges and queries that
can still meet are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.llm.integers import lists, matrix, products, usable, whole
from fieldtally.llm.tables import table
from fieldtally.session import settle

K, SCALE = 20, 64
# Different vectors in a block, and in a document range; queries that go to a range together; ranges told of in one page.
BLOCK, RANGE, CHUNK, PAGE = 32, 2048, 256, 512
# A wave takes, of each page, the ranges up to the next of these places in a query's order of bounds; the last one all that are left.
WAVES = [4, 16, 64, 256, 1 << 30]
# Order of the vectors: cells around centres fitted to a bounded sample. Results depend on neither number.
SAMPLE_ROWS, CENTRES = 4096, 256
LOWEST = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max

INDEX = (
    "range long, dims int, n int, number array<long>, first array<long>, code array<int>, high array<int>, low array<int>, "
    "asked array<boolean>, ids array<array<long>>"
)
CHUNKS = "chunk long, range long, dims int, n int, number array<long>, code array<int>"
FOUND = "chunk long, pos int, score long, number long, first long"


def classes(vectors: DataFrame, asked: Column, key: str, column: str, scale: int, k: int) -> DataFrame:
    """(code, ids, first, asked): different vectors, the least k + 1 keys of the rows that have one, and whether one of them asks.

    More of a class can be in no result. The window's limit is applied by every
    task before rows are shuffled, so a vector that very many rows have is a few rows of each task.
    """
    rows = vectors.where(usable(column)).select(
        whole(column, scale).alias("code"), F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked")
    )
    least = Window.partitionBy("code", "asked").orderBy(F.col("id").asc_nulls_last())
    some = rows.withColumn("at", F.row_number().over(least)).where(f"at <= {k + 1}")
    kept = some.groupBy("code").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull(), "id"))).alias("all"), F.max("asked").alias("asked"))
    ids = F.transform(F.slice("all", 1, k + 1), lambda x: x["id"])
    return kept.select("code", ids.alias("ids"), "asked").withColumn("first", F.coalesce(F.col("ids")[0], F.lit(LAST)))


def _centres(sample: np.ndarray) -> np.ndarray:
    """Centres of a sample: spread-out rows, moved to the means of what is near them a few times."""
    rng = np.random.default_rng(11)
    centres = sample[rng.permutation(len(sample))[: min(CENTRES, max(1, len(sample) // 8))]]
    for _ in range(6):
        own = ((centres * centres).sum(axis=1) / 2 - sample @ centres.T).argmin(axis=1)
        centres = np.array([sample[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
    # Along the line of the centres, each is followed by the nearest one left.
    order, left = [0], list(range(1, len(centres)))
    while left:
        gaps = ((centres[left] - centres[order[-1]]) ** 2).sum(axis=1)
        order.append(left.pop(int(gaps.argmin())))
    return centres[order]


def _placed(reps: DataFrame) -> DataFrame:
    """``reps`` sorted: by length, nearest centre, second nearest, distance, and a hash that leaves no large ties."""
    sample = reps.orderBy(F.xxhash64("code")).limit(SAMPLE_ROWS).select("code", F.size("code").alias("n")).toArrow()
    sizes = sample["n"].to_numpy()
    centres = {
        n: _centres(np.array(sample["code"].filter(pa.array(sizes == n)).to_pylist(), np.float64)) for n in np.unique(sizes).tolist() if n > 0
    }

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            nearest, second, gap = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for n in np.unique(dims).tolist():
                if n not in centres:
                    continue
                at, c = np.flatnonzero(dims == n), centres[n]
                values = matrix(batch.column("code").take(pa.array(at)), n).astype(np.float64)
                gaps = (c * c).sum(axis=1) - 2 * values @ c.T
                order = np.argsort(gaps, axis=1, kind="stable")
                nearest[at], gap[at] = order[:, 0], gaps[np.arange(len(at)), order[:, 0]] + (values * values).sum(axis=1)
                second[at] = order[:, min(1, len(c) - 1)]
            columns = [*batch.columns, pa.array(nearest), pa.array(second), pa.array(gap)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "c1", "c2", "gap"])

    read = reps.withColumn("dims", F.size("code"))
    blank = {"c1": F.lit(0), "c2": F.lit(0), "gap": F.lit(0.0)}
    by = ["dims", "c1", "c2", "gap", "turn"]
    placed = read.mapInArrow(place, read.withColumns(blank).schema).withColumn("turn", F.xxhash64("code"))
    return placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("c1", "c2", "gap", "turn")


def index(reps: DataFrame) -> DataFrame:
    """Document ranges with the maxima and minima of their blocks and their forward index; numbers name the vectors."""

    def one(number: int, dims: int, columns: list) -> pa.RecordBatch:
        code, first, asked, ids = columns
        starts = np.arange(0, len(code), BLOCK)
        numbers = number * RANGE + np.arange(len(code))
        high, low = np.maximum.reduceat(code, starts, axis=0), np.minimum.reduceat(code, starts, axis=0)
        made = [
            pa.array([number]), pa.array([dims], pa.int32()), pa.array([len(code)], pa.int32()), lists(numbers[None, :], pa.int64()),
            lists(first[None, :], pa.int64()), lists(code.reshape(1, -1), pa.int32()), lists(high.reshape(1, -1), pa.int32()),
            lists(low.reshape(1, -1), pa.int32()), lists(asked[None, :], pa.bool_()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        ]
        return pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in INDEX.split(", ")])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, held_dims = TaskContext.get().partitionId() << 24, None, None
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for n in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == n)))
                code = matrix(part.column("code"), n) if n else np.zeros((part.num_rows, 0), np.int64)
                new = [code, part.column("first").to_numpy(), part.column("asked").to_numpy(zero_copy_only=False), part.column("ids")]
                if held is not None and n != held_dims:
                    yield one(number, held_dims, held)
                    number, held = number + 1, None
                if held is not None:
                    new = [*(np.concatenate(x) for x in zip(held[:3], new[:3], strict=True)), pa.concat_arrays([held[3], new[3]])]
                held = new
                held_dims = n
                while len(held[0]) >= RANGE:
                    yield one(number, n, [x[:RANGE] for x in held])
                    number, held = number + 1, [x[RANGE:] for x in held]
                held = held if len(held[0]) else None
        if held is not None:
            yield one(number, held_dims, held)

    return _placed(reps).select("dims", "code", "first", "asked", "ids").mapInArrow(gather, INDEX)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The greatest score each query can have in each block: its terms' maxima, summed."""
    return products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)


def walk(queries: np.ndarray, floors: np.ndarray, doc: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """(query, score, place) of what is among the best k of one range for queries whose k-th score is ``floors`` so far.

    Blocks come in each query's order of bounds, one, then two, then four more,
    until the bounds are below its k-th score; equal bounds are still looked
    at, for ties. Within a step, queries that look at the same block share its kernel.
    """
    most = bounds(queries, doc["high"], doc["low"])
    order = np.argsort(-most, axis=1, kind="stable")
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    kth, at, step = floors.copy(), 0, 1
    while at < most.shape[1]:
        taken = order[:, at : at + step]
        live = np.take_along_axis(most, taken, axis=1) >= kth[:, None]
        if not live.any():
            break
        told = [best]
        for b in np.unique(taken[live]).tolist():
            asks = np.flatnonzero(((taken == b) & live).any(axis=1))
            scores = products(queries[asks], doc["code"][b * BLOCK : (b + 1) * BLOCK])
            q, d = np.nonzero(scores >= kth[asks, None])
            told.append([asks[q], scores[q, d], d + b * BLOCK])
        best = [np.concatenate(x) for x in zip(*told, strict=True)]
        # Higher scores first, of equal ones the smaller key.
        sort = np.lexsort((doc["number"][best[2]], doc["first"][best[2]], -best[1], best[0]))
        best = [x[sort] for x in best]
        place = np.arange(len(sort)) - np.searchsorted(best[0], best[0], side="left")
        full = place == k - 1
        kth[best[0][full]] = np.maximum(kth[best[0][full]], best[1][full])
        best = [x[place < k] for x in best]
        at, step = at + step, step * 2
    return best[0], best[1], best[2]


def _doc(row: dict) -> dict[str, np.ndarray]:
    """Arrays of one range out of its row of Arrow columns."""
    dims = row["dims"][0].as_py()
    flat = {n: row[n].flatten().to_numpy() for n in ("number", "first")}
    if not dims:
        blocks = -(-len(flat["number"]) // BLOCK)
        none = np.zeros((blocks, 0), np.int64)
        return flat | {"high": none, "low": none, "code": np.zeros((len(flat["number"]), 0), np.int64)}
    return flat | {n: matrix(row[n], dims) for n in ("code", "high", "low")}


def _queries(row: dict, prefix: str = "") -> np.ndarray:
    """The query vectors of a row."""
    n, dims = row[prefix + "n"][0].as_py(), row["dims"][0].as_py()
    return matrix(row[prefix + "code"], dims) if dims else np.zeros((n, 0), np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Every row of the batches as Arrow columns of length one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c.slice(i, 1) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _found(chunk: int, pos: np.ndarray, best: tuple[np.ndarray, ...], doc: dict[str, np.ndarray]) -> pa.RecordBatch:
    q, score, place = best
    columns = [
        pa.array(np.full(len(q), chunk)), pa.array(pos[q], pa.int32()), pa.array(score), pa.array(doc["number"][place]), pa.array(doc["first"][place]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])


def chunks(ranges: DataFrame) -> DataFrame:
    """The vectors that are asked for, in rows of queries of one range: near ones ask together."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            asked = np.flatnonzero(row["asked"].flatten().to_numpy(zero_copy_only=False))
            code, numbers = _queries(row), row["number"].flatten().to_numpy()
            for a in range(0, len(asked), CHUNK):
                at = asked[a : a + CHUNK]
                made = [
                    pa.array([int(numbers[at[0]])]), row["range"], row["dims"], pa.array([len(at)], pa.int32()), lists(numbers[at][None, :], pa.int64()),
                    lists(code[at].reshape(1, -1), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in CHUNKS.split(", ")])

    return ranges.mapInArrow(cut, CHUNKS)


def _told(asks: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    """What queries find in ranges; ``asks`` (chunk, range, pos, q_n, q_code, floors), a row for each chunk and range that meet."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            doc = _doc(row)
            floors, pos = row["floors"].flatten().to_numpy(), row["pos"].flatten().to_numpy()
            yield _found(row["chunk"][0].as_py(), pos, walk(_queries(row, "q_"), floors, doc, k), doc)

    both = asks.join(ranges.drop("asked", "n", "ids"), "range")
    return both.mapInArrow(look, FOUND)


def _pages(ranges: DataFrame, n_pages: int) -> DataFrame:
    """(page, dims, ranges, tops, bottoms): greatest and least components of whole ranges, about PAGE of them in a row."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            doc = _doc(row)
            ends = [lists(f(doc[n], axis=0)[None, :], pa.int32()) for f, n in ((np.max, "high"), (np.min, "low"))]
            yield pa.RecordBatch.from_arrays([row["range"], row["dims"], *ends], names=["range", "dims", "top", "bottom"])

    ends = ranges.mapInArrow(sum_up, "range long, dims int, top array<int>, bottom array<int>")
    paged = ends.withColumn("page", F.expr(f"CAST(pmod(xxhash64(range), {n_pages}) AS INT)"))
    return paged.groupBy("page", "dims").agg(F.array_sort(F.collect_list(F.struct("range", "top", "bottom"))).alias("all")).select(
        "page", "dims", F.col("all.range").alias("ranges"), F.flatten("all.top").alias("tops"), F.flatten("all.bottom").alias("bottoms")
    )


def _met(asking: DataFrame, pages: DataFrame, n_pages: int, start: int, stop: int) -> DataFrame:
    """Which ranges the queries of a chunk go to: places ``start`` to ``stop`` of a page in their order of bounds, none under their floor."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            queries, floors = _queries(row), row["floors"].flatten().to_numpy()
            ranges, dims = row["ranges"].flatten().to_numpy(), row["dims"][0].as_py()
            tops, bottoms = (matrix(row[n], dims) if dims else np.zeros((len(ranges), 0), np.int64) for n in ("tops", "bottoms"))
            most = bounds(queries, tops, bottoms)
            # A query has been through its own range.
            most[:, ranges == row["range"][0].as_py()] = LOWEST
            order = np.argsort(-most, axis=1, kind="stable")[:, start:stop]
            goes = np.zeros(most.shape, bool)
            np.put_along_axis(goes, order, True, axis=1)
            goes &= (most >= floors[:, None]) & (most > LOWEST)
            for r in np.flatnonzero(goes.any(axis=0)):
                at = np.flatnonzero(goes[:, r])
                made = [
                    row["chunk"], pa.array([int(ranges[r])]), pa.array([len(at)], pa.int32()), lists(at[None, :], pa.int64()),
                    lists(queries[at].reshape(1, -1), pa.int32()), lists(floors[at][None, :], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["chunk", "range", "q_n", "pos", "q_code", "floors"])

    wide = asking.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).join(pages, ["page", "dims"])
    return wide.mapInArrow(choose, "chunk long, range long, q_n int, pos array<long>, q_code array<int>, floors array<long>")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; the window's limit is applied by every task first."""
    order = Window.partitionBy("chunk", "pos").orderBy(F.desc("score"), "first", "number")
    return found.withColumn("at", F.row_number().over(order)).where(f"at <= {k}").drop("at")


def _with_floors(asking: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """``asking`` with each query's k-th score so far, the lowest number where it has fewer."""
    kth = best.groupBy("chunk", "pos").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(f"n >= {k}")
    maps = kth.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("pos", "score"))).alias("kth"))
    one = lambda i: F.coalesce(F.element_at("kth", i), F.lit(int(LOWEST)))
    floors = F.transform(F.sequence(F.lit(0), F.col("n") - 1), one)
    return asking.join(maps, "chunk", "left").withColumn("floors", floors).drop("kth")


def top_k(
    vectors: DataFrame, asked: Column, k: int = K, key: str = "vec_id", column: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every row that ``asked`` holds for, its own row left out.

    Components count as floor(scale * x). Ties go to the smaller key, rows
    without key last. Vectors that are null or hold null or non-finite
    components take no part; those of different lengths do not meet, and the
    product of empty ones is zero. Repeated rows are rows of their own: each
    asks and is found. Queries with fewer than k others return those, and an
    empty table returns nothing. Other columns are not read, so their names do not matter.
    """
    reps = settle(classes(vectors, asked, key, column, scale, k), "topk-classes")
    ranges = settle(index(reps), "topk-index")
    # One more than asked for: a query's own row is among its best.
    most = k + 1
    asking = settle(chunks(ranges), "topk-chunks")
    n_ranges = ranges.count()
    n_pages = max(1, -(-n_ranges // PAGE))
    pages = settle(_pages(ranges, n_pages), "topk-pages")
    start = asking.select(
        "chunk", "range", F.col("n").alias("q_n"), F.sequence(F.lit(0), F.col("n") - 1).cast("array<long>").alias("pos"), F.col("code").alias("q_code"),
        F.array_repeat(F.lit(int(LOWEST)), F.col("n")).alias("floors"),
    )
    best = settle(_told(start, ranges, most), "topk-best")
    done = 0
    for stop in WAVES:
        met = settle(_met(_with_floors(asking, best, most), pages, n_pages, done, stop), "topk-met")
        if met.isEmpty():
            break
        best = settle(_best(best.unionByName(_told(met, ranges, most)), most), "topk-best")
        done = stop
    return _ranked(vectors, asked, asking, best, ranges, k, key, column, scale)


def _ranked(
    vectors: DataFrame, asked: Column, asking: DataFrame, best: DataFrame, ranges: DataFrame, k: int, key: str, column: str, scale: int
) -> DataFrame:
    """The rows of the best classes, in order, for every asking row."""
    named = ranges.select(F.explode(F.arrays_zip("number", "ids")).alias("x")).select("x.number", "x.ids")
    told = best.join(named, "number").select("chunk", "pos", "score", "number", F.explode("ids").alias("id"))
    row = F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("last"), "id", "number")
    lists_ = told.groupBy("chunk", "pos").agg(F.slice(F.array_sort(F.collect_list(row)), 1, k + 1).alias("best"))
    code = F.slice("code", F.col("pos") * F.col("dims") + 1, F.col("dims"))
    asks = asking.select("chunk", "dims", "code", F.posexplode("number").alias("pos", "own")).select("chunk", "pos", "own", code.alias("code"))
    answers = settle(lists_.join(asks, ["chunk", "pos"]).select("code", "own", "best"), "topk-answers")
    queries = vectors.where(F.coalesce(asked, F.lit(False)) & usable(column)).select(
        F.col(f"`{key}`").cast("long").alias("query_id"), whole(column, scale).alias("code")
    )
    # The own row is left out once: of rows with the same key and vector the others stay.
    own = F.expr("array_position(transform(best, x -> x.number = own AND x.id <=> query_id), true)")
    others = F.expr(f"slice(filter(best, (x, i) -> own_at = 0 OR i <> own_at - 1), 1, {k})")
    met = queries.join(answers, "code").withColumn("own_at", own).withColumn("others", others)
    return met.select("query_id", F.posexplode("others").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )


QUERY_STEP = 20


def op11_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest inner products of every twentieth embedding with all others."""
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, d.r AS dr,
  CASE WHEN len(d.c) = 0 THEN 0 ELSE CAST(list_inner_product(q.c, d.c) AS BIGINT) END AS score
  FROM v q JOIN v d ON q.r <> d.r AND len(q.c) = len(d.c) WHERE q.vec_id % {QUERY_STEP} = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, dr) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM o WHERE rank <= {K}
"""
