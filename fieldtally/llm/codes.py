"""Vector codes: product quantisation in whole numbers over Hilbert-sorted flat blocks.

Every vector is cut into parts. The parts of one position are sorted along a
Hilbert curve and stored in pages of flat blocks, each with its box (least and
greatest components) and its sums. In every round the distances from a block's
box to the codebook's entries leave the block a shortlist: the entries that can
be nearest to anything in the box. A block with one such entry is added by its
stored sums; in the others a small kernel compares members and shortlist, in
whole numbers. Tasks return sums per entry; the codebooks, of fixed size, are
all that passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.integers import distances, lists, matrix, usable, whole
from fieldtally.llm.tables import shielded, table
from fieldtally.session import settle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Parts in a block, and in a page: a row of the stored table.
BLOCK, PAGE = 32, 2048
# Bits of a curve index, and rows that tell how wide components spread; results depend on neither.
CURVE_BITS, SPREAD_ROWS = 60, 1024

PAGES = "part int, n int, row array<long>, code array<int>, low array<int>, high array<int>, total array<long>"


@dataclass(frozen=True)
class Compressed:
    """The coded vectors, and the codebooks: entries of each part."""

    coded: DataFrame
    books: list[list[list[int]]]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and place, as decimal numbers joined by commas."""
        return sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits in each dimension.

    From the highest bit down, what has been walked so far turns the remaining
    lower bits: a set bit inverts them in the first dimension, an unset one
    swaps them with the first dimension's. The Gray code of the result is the place.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        lower = (1 << bit) - 1
        for d in range(dims):
            walked = (x[:, d] >> bit) & 1 == 1
            x[walked, 0] ^= lower
            swap = np.where(walked, 0, (x[:, 0] ^ x[:, d]) & lower)
            x[:, 0] ^= swap
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << 1) | ((x[:, d] >> bit) & 1)
    return place


def curve_places(values: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Curve index of parts: components in steps of their spread, the widest ones only if there are very many."""
    used = np.sort(np.argsort(-spread, kind="stable")[:CURVE_BITS])
    bits = min(4, CURVE_BITS // max(1, len(used)))
    half = 1 << (bits - 1)
    steps = np.floor((values[:, used] - centre[used]) / np.maximum(spread[used], 1e-9) * (half / 2)) + half
    return hilbert(np.clip(steps, 0, 2 * half - 1).astype(np.int64), bits)


def _cut(kept: DataFrame, width: int, parts: int, centre: np.ndarray, spread: np.ndarray) -> DataFrame:
    """(part, curve, row, code): every vector's parts with their place on the curve."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column("__codes"), width * parts)
            for p in range(parts):
                at = slice(p * width, (p + 1) * width)
                places = curve_places(values[:, at], centre[at], spread[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), p), pa.int32()), pa.array(places), batch.column("__row"), lists(values[:, at], pa.int32())],
                    names=["part", "curve", "row", "code"],
                )

    return kept.select("__row", "__codes").mapInArrow(cut, "part int, curve long, row long, code array<int>")


def _page(part: int, rows: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    starts = np.arange(0, len(values), BLOCK)
    low, high, total = (f.reduceat(values, starts, axis=0) for f in (np.minimum, np.maximum, np.add))
    columns = [
        pa.array([part], pa.int32()), pa.array([len(values)], pa.int32()), lists(rows[None, :], pa.int64()), lists(values.reshape(1, -1), pa.int32()),
        lists(low.reshape(1, -1), pa.int32()), lists(high.reshape(1, -1), pa.int32()), lists(total.reshape(1, -1), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "n", "row", "code", "low", "high", "total"])


def pages(cut: DataFrame, width: int) -> DataFrame:
    """The parts of every position along their curve, in rows of flat blocks."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, values = None, np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        for batch in batches:
            parts = batch.column("part").to_numpy()
            new_rows, new_values = batch.column("row").to_numpy(), matrix(batch.column("code"), width)
            for p in np.unique(parts).tolist():
                if p != part and len(rows):
                    yield _page(part, rows, values)
                    rows, values = rows[:0], values[:0]
                part = p
                rows, values = np.concatenate([rows, new_rows[parts == p]]), np.concatenate([values, new_values[parts == p]])
                while len(rows) >= PAGE:
                    yield _page(part, rows[:PAGE], values[:PAGE])
                    rows, values = rows[PAGE:], values[PAGE:]
        if len(rows):
            yield _page(part, rows, values)

    # The row ends the sort key, so copies of one part are dealt out too.
    sorted_ = cut.repartitionByRange("part", "curve", "row").sortWithinPartitions("part", "curve", "row")
    return sorted_.mapInArrow(gather, PAGES)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Per block, the entries that can be nearest to anything in its box.

    An entry is out if another one's farthest point of the box is nearer than its own nearest point.
    """
    under, over = low[:, None, :] - book[None], book[None] - high[:, None, :]
    outside = np.maximum(np.maximum(under, over), 0)
    across = np.maximum(np.abs(book[None] - low[:, None, :]), np.abs(book[None] - high[:, None, :]))
    near, far = (outside * outside).sum(axis=2), (across * across).sum(axis=2)
    return near <= far.min(axis=1)[:, None]


def blocks(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple]:
    """(part, rows, values, totals, shortlist) of every block of the pages."""
    for i in range(batch.num_rows):
        page = {n: c.slice(i, 1) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        part = page["part"][0].as_py()
        book = books[part]
        width = book.shape[1]
        values, rows = matrix(page["code"], width), page["row"].flatten().to_numpy()
        total = matrix(page["total"], width)
        short = shortlists(matrix(page["low"], width), matrix(page["high"], width), book)
        for b in range(len(short)):
            at = slice(b * BLOCK, (b + 1) * BLOCK)
            yield part, rows[at], values[at], total[b], np.flatnonzero(short[b])


def kernel(values: np.ndarray, short: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of a block's members, out of its shortlist; ties to the lower entry."""
    gaps = distances(values, book[short])
    best = gaps.argmin(axis=1)
    return short[best], gaps[np.arange(len(best)), best]


def _round(stored: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after every part has gone to its nearest entry: componentwise floors of the means."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = [np.array(b, np.int64) for b in books]
        sums, counts = [np.zeros(b.shape, np.int64) for b in now], [np.zeros(len(b), np.int64) for b in now]
        for batch in batches:
            for part, _, values, total, short in blocks(batch, now):
                if len(short) == 1:
                    sums[part][short[0]] += total
                    counts[part][short[0]] += len(values)
                else:
                    entry, _ = kernel(values, short, now[part])
                    np.add.at(sums[part], entry, values)
                    counts[part] += np.bincount(entry, minlength=len(now[part]))
        for part in range(len(now)):
            used = np.flatnonzero(counts[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), part), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[part][used]), lists(sums[part][used], pa.int64())],
                names=["part", "entry", "n", "sums"],
            )

    told = stored.mapInArrow(add, "part int, entry int, n long, sums array<long>")
    long = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "some"))
    totals = long.groupBy("part", "entry", "at").agg(F.sum(F.col("some").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = [[list(entry) for entry in book] for book in books]
    for r in totals.collect():  # at most parts x entries x components
        new[r.part][r.entry][r.at] = int(r.total) // r.n
    return new


def _assigned(stored: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """(row, part, entry, error) of every part."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = [np.array(b, np.int64) for b in books]
        for batch in batches:
            found = [(part, rows, *kernel(values, short, now[part])) for part, rows, values, _, short in blocks(batch, now)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([r for _, r, _, _ in found])),
                        pa.array(np.concatenate([np.full(len(r), p) for p, r, _, _ in found]), pa.int32()),
                        pa.array(np.concatenate([e for _, _, e, _ in found]), pa.int32()),
                        pa.array(np.concatenate([d for _, _, _, d in found])),
                    ],
                    names=["row", "part", "entry", "error"],
                )

    return stored.mapInArrow(tell, "row long, part int, entry int, error long")


def compress(
    vectors: DataFrame, column: str = "embedding", key: str = "vec_id", keep: list[str] | None = None, parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Compressed:
    """Columns ``keep`` (all) of the vectors with entries (one number per part) and error, and the codebooks.

    Kept columns may have any name; those called entries or error are replaced.
    Vectors that are null, empty or hold null or non-finite components are left
    out, and so are those of another length than most (ties: the shorter), or
    of one that the parts do not divide: codebooks have one width. A codebook
    starts as the parts of the vectors with the least keys (rows without key
    last; of one key the smaller vector first), so with fewer vectors it has
    fewer entries, and equal entries can occur: the lower has all parts then.
    Repeated rows are vectors of their own. An empty table gives no rows and no entries.
    """
    names = [F.col(f"`{c}`") for c in (vectors.columns if keep is None else keep) if c.lower() not in ("entries", "error")]
    read = vectors.select(*names, F.col(f"`{column}`").alias("__vector"), F.col(f"`{key}`").alias("__key"))
    shield, named = shielded(read, "__vector", "__key")
    size = F.size("__vector")
    fine = shield.where(usable("__vector") & (size > 0) & (size % parts == 0))
    numbered = fine.withColumns({"__codes": whole("__vector", scale), "__row": F.monotonically_increasing_id()}).drop("__vector")
    kept = settle(numbered, "code-vectors")
    usual = kept.groupBy(F.size("__codes").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if usual is None:
        none = kept.withColumns({"entries": F.lit(None).cast("array<int>"), "error": F.lit(0).cast("long"), "__vector": F.lit(None)})
        return Compressed(none.select(*named(none)[:-2], "entries", "error"), [[] for _ in range(parts)])
    kept = kept.where(F.size("__codes") == usual.dims)
    width = usual.dims // parts
    first = [r[0] for r in kept.orderBy(F.col("__key").asc_nulls_last(), "__codes").limit(entries).select("__codes").collect()]
    books = [[[int(x) for x in v[p * width : (p + 1) * width]] for v in first] for p in range(parts)]
    some = matrix(kept.orderBy(F.xxhash64("__codes")).limit(SPREAD_ROWS).select("__codes").toArrow()["__codes"], usual.dims)
    stored = settle(pages(_cut(kept, width, parts, some.mean(axis=0), some.std(axis=0)), width), "code-pages")
    for _ in range(rounds):
        books = _round(stored, books)
    told = _assigned(stored, books)
    own = [F.max(F.when(F.col("part") == p, F.col("entry"))) for p in range(parts)]
    whole_again = told.groupBy("row").agg(F.array(*own).alias("entries"), F.sum("error").alias("error"))
    carried = kept.drop("__codes")
    made = carried.join(whole_again, carried["__row"] == whole_again["row"]).withColumn("__vector", F.lit(None))
    return Compressed(made.select(*named(made)[:-2], "entries", "error"), books)


def hex_code(entries: str = "entries") -> Column:
    """Entries as two lowercase hex digits each."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e.cast("long")), 2, "0"))), "")


def op12_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every embedding, the error of its label, and the digest of the codebooks."""
    made = compress(table(spark, folder, "embeddings"), keep=["vec_id", "label"])
    coded = settle(made.coded, "code-vectors")
    labels = settle(
        coded.groupBy(F.col("label").alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "code-labels"
    )
    return coded.join(labels, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", hex_code().alias("code"), "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256")
    )


def _sql() -> str:
    """One assignment and one mean a round, each a table of its own."""
    gap = "CAST(list_inner_product(x.c, x.c) - 2 * list_inner_product(x.c, k.c) + list_inner_product(k.c, k.c) AS BIGINT)"
    tables = [
        f"""ok AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS c FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "usual AS MATERIALIZED (SELECT len(c) AS dims FROM ok GROUP BY len(c) ORDER BY count(*) DESC, len(c) LIMIT 1)",
        "v AS MATERIALIZED (SELECT ok.* FROM ok JOIN usual ON len(c) = dims)",
        f"""p AS MATERIALIZED (SELECT r, p, c[p * (dims // {PARTS}) + 1 : (p + 1) * (dims // {PARTS})] AS c FROM v, usual, range({PARTS}) t(p))""",
        f"f AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, c) - 1 AS k FROM v ORDER BY k LIMIT {ENTRIES})",
        "k0 AS MATERIALIZED (SELECT p, k, c FROM p JOIN f USING (r))",
    ]
    for i in range(ROUNDS + 1):
        tables.append(f"a{i} AS MATERIALIZED (SELECT x.r, x.p, min([{gap}, k.k]) AS d FROM p x JOIN k{i} k USING (p) GROUP BY x.r, x.p)")
        if i < ROUNDS:
            tables.append(
                f"""m{i} AS MATERIALIZED (SELECT p, k, list(m ORDER BY i) AS c FROM (SELECT x.p, d[2] AS k, i,
  CAST((sum(CAST(x.c[i] AS BIGINT)) - ((sum(CAST(x.c[i] AS BIGINT)) % count(*)) + count(*)) % count(*)) // count(*) AS DOUBLE) AS m
  FROM p x JOIN a{i} USING (r, p), usual, range(1, dims // {PARTS} + 1) t(i) GROUP BY x.p, d[2], i) GROUP BY p, k)"""
            )
            tables.append(f"k{i + 1} AS MATERIALIZED (SELECT k{i}.p, k{i}.k, coalesce(m.c, k{i}.c) AS c FROM k{i} LEFT JOIN m{i} m USING (p, k))")
    return f"""WITH {", ".join(tables)},
book AS MATERIALIZED (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, k)) AS h FROM k{ROUNDS}),
one AS MATERIALIZED (SELECT r, string_agg(printf('%02x', d[2]), '' ORDER BY p) AS code, sum(d[1]) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM one JOIN v USING (r), book"""


OP12_SQL = _sql()
