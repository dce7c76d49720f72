"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most four bits differ in at most two bits on
one of their 31-bit halves. The anchors of a half are the words of the Hamming
code of length 31: every half lies within one bit of an anchor (the covering
radius), so the point midway between two halves two bits apart has an anchor
within one bit, which is within two bits of either. Every fingerprint goes to
all anchors within radius plus its share of the threshold, 1 + 1 bits: 16 of
the 67 million anchors of a half. Fingerprints are compared anchor by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.components import components
from fieldtally.llm.tables import map_texts, table
from fieldtally.session import settle

SHINGLE = 4
MAX_BITS = 4
SEED = 42
HALF = 31
# Words of a text are hashed in runs of this many.
RUN_WORDS = 200_000
# Anchors with more fingerprints than this are compared in pieces of about this size, every piece with every other.
PIECE = 2048
# Up to this size the links at an anchor are written as found; above it as a forest that joins the same fingerprints.
SMALL = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text, repeats included; a text without words has fingerprint zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    votes = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for start in range(0, n, RUN_WORDS):
        run = words[start : min(start + RUN_WORDS, n) + shingle - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(run[i : i + shingle]), SEED) for i in range(len(run) - shingle + 1)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) with fp, the fingerprint as a signed long."""

    def begin():
        def work(texts: list, _) -> dict:
            return {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64).tolist()}

        return work

    added = T.StructType([T.StructField("fp", T.LongType())])
    return map_texts(docs, text, begin, added, docs.columns if keep is None else keep)


def _patterns() -> list[list[int]]:
    """For each syndrome of the code: the changes of at most two bits that lead to an anchor."""
    out = []
    for syndrome in range(32):
        if syndrome == 0:
            out.append([0])
            continue
        pairs = [(1 << (i - 1)) | (1 << ((i ^ syndrome) - 1)) for i in range(1, 32) if i < i ^ syndrome]
        out.append([1 << (syndrome - 1), *pairs])
    return out


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, fp): every fingerprint at its anchors; an anchor's number tells the half it is of."""
    checks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    mask = (1 << HALF) - 1
    halves = F.explode(
        F.array(
            *[
                F.struct(F.lit(h).alias("h"), F.shiftrightunsigned("fp", h * HALF).bitwiseAND(F.lit(mask)).alias("x"))
                for h in range(2)
            ]
        )
    )
    split = fps.select("fp", halves.alias("s")).select("fp", "s.h", "s.x")
    syndrome = " + ".join(f"(bit_count(x & {c}L) % 2) * {1 << k}" for k, c in enumerate(checks))
    table_ = ", ".join("array(" + ", ".join(f"{c}L" for c in row) + ")" for row in _patterns())
    split = split.withColumn("syndrome", F.expr(syndrome).cast("int"))
    spread = split.select("fp", "h", "x", F.explode(F.expr(f"element_at(array({table_}), syndrome + 1)")).alias("change"))
    return spread.select(F.expr(f"(x ^ change) | shiftleft(CAST(h AS BIGINT), {HALF})").alias("anchor"), "fp")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links between points 0 to n - 1, every point with the least one it is joined to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of one group: all of them for a small group, a forest for a large one."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    a, b = np.nonzero(np.triu(near, 1))
    if len(fps) > SMALL and len(a):
        a, b = _forest(a, b, len(fps))
    return fps[a], fps[b]


def compare(groups: DataFrame, keys: list[str], max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) among the rows of equal ``keys`` (column fp); the keys' groups are small by construction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None

        def found(rows: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)) + 1
            us, vs = [], []
            for fps in np.split(rows[:, -1].view(np.uint64), change):
                if len(fps) > 1:
                    u, v = _links(fps, max_bits)
                    us.append(u)
                    vs.append(v)
            u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = rows if rest is None else np.concatenate([rest, rows])
            if not len(rows):
                continue
            # The last group may go on in the next batch.
            last = np.flatnonzero((rows[:, :-1] != rows[-1, :-1]).any(axis=1))
            end = last[-1] + 1 if len(last) else 0
            rest = rows[end:]
            if end:
                yield found(rows[:end])
        if rest is not None:
            yield found(rest)

    dealt = groups.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u long, v long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, piece: int = PIECE) -> DataFrame:
    """Links between distinct fingerprints (column fp) that join all within ``max_bits`` bits, at most four.

    Anchors with one fingerprint are left out after a count per anchor. An
    anchor with more than ``piece`` is dealt into pieces, and every pair of
    pieces is compared in a group of its own, so no task holds more than about
    two pieces. Large groups write a spanning forest of their links instead of
    all pairs, which leaves the components as they are.
    """
    if max_bits > MAX_BITS:
        raise ValueError("two halves with one code each cover at most four bits")
    rows = anchored(fps)
    counts = rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(counts, "anchor")
    pieces = f"CAST(ceil(n / {piece}) AS INT)"
    dealt = shared.withColumn("own", F.expr(f"CAST(pmod(xxhash64(fp), {pieces}) AS INT)"))
    dealt = dealt.withColumn("other", F.explode(F.expr(f"sequence(0, {pieces} - 1)")))
    groups = dealt.select("anchor", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    return compare(groups, ["anchor", "p", "q"], max_bits)


def groups_of(prints: DataFrame, key: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component): the least ``key`` of all rows that fingerprint fp is joined to, directly or by way of others.

    ``prints`` (key, fp) is read several times and should be stored. Equal
    fingerprints count as one: their rows are reduced before anything is
    compared, so a hot text costs no more than another. Null keys never name a
    component unless no other key is there.
    """
    least = settle(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash-fps")
    found = components(links(least.select("fp"), max_bits))
    placed = least.join(found, least["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    roots = placed.groupBy("root").agg(F.min("least").alias("component"))
    # Most roots have one fingerprint; the join is by the root, of which each row of roots is one.
    return placed.join(roots, "root").select("fp", "component")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """(key, fp, component) for every row: rows joined by links of at most ``max_bits`` bits have one component.

    A null or empty text has no words and fingerprint zero, which links like
    any other; a text of fewer words than a shingle is one shingle. Repeated
    rows keep one row each. Texts are read whole, however long; a bit that is
    set in exactly half the shingles is 0. An empty table gives no rows. Only
    key and text are read, so other columns may have any name.
    """
    prints = settle(fingerprints(docs, text, shingle, keep=[key]), "simhash-prints")
    placed = groups_of(prints, key, max_bits).withColumnRenamed("fp", "__fp")
    # A hot fingerprint is a skewed left side, which adaptive execution splits.
    joined = prints.join(placed, prints["fp"] == placed["__fp"], "left")
    return joined.select(key, "fp", "component")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_digits().alias("fingerprint"), F.col("component").alias("component_id"))


def _row_hash(docs: DataFrame) -> Column:
    """Hash of a whole row; columns with a map in them, which has none, by their JSON."""

    def mapped(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return mapped(kind.elementType)
        if isinstance(kind, T.StructType):
            return any(mapped(f.dataType) for f in kind.fields)
        return isinstance(kind, T.MapType)

    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if mapped(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields])


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least key.

    Of rows with the same least key one stays, by a hash of the row. Rows
    without a key come after all others. Columns may be of any type and name;
    an empty table stays one. ``docs`` is read again to pick the rows, by key
    and row hash, so it should be stored.
    """
    hashed = docs.withColumn("__hash", _row_hash(docs))
    prints = settle(fingerprints(hashed, text, SHINGLE, keep=[key, "__hash"]), "simhash-prints")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__hash").alias("hash"))
    least = settle(prints.groupBy("fp").agg(F.min(order).alias("first")), "simhash-fps")
    found = components(links(least.select("fp")))
    placed = least.join(found, least["fp"] == found["node"], "left")
    chosen = placed.groupBy(F.coalesce("component", "fp")).agg(F.min("first").alias("first"))
    chosen = settle(chosen.select(F.col("first.key").alias("__k"), F.col("first.hash").alias("__h")), "simhash-kept")
    kept = hashed.join(chosen, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__hash") == F.col("__h")), "left_semi")
    again = prints.groupBy(key, "__hash").agg(F.count("*").alias("n")).where("n > 1")
    again = settle(again.select(F.col(key).alias("__k"), F.col("__hash").alias("__h")), "simhash-again")
    if not again.isEmpty():  # whole rows that are repeated
        same = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__hash") == F.col("__h"))
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates([key, "__hash"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
