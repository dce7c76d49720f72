"""Centroid clustering of whole-number vectors, filtered by n-simplex projection.

A few pivots are fixed at the start. The distances of a vector to them are
computed once and turned into the coordinates of the apex of a simplex whose
base the pivots are; the rounds read those from a stored table. Of two apexes
the plain distance is a lower bound of the vectors' distance, and the distance
with one height turned over an upper bound. In every round these bounds leave
a vector the few centroids that can be its nearest, and only those are compared
with it, in whole numbers. Nothing but 64-component sums of a few clusters
leaves a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.integers import distances, lists, matrix, usable, whole
from fieldtally.llm.tables import shielded, table
from fieldtally.session import settle

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, "3"
# Pivots are the first centroids and those that the rounds lead to on this many rows; results do not depend on them.
PIVOT_ROWS = 2048
# A pivot that lies this near the span of the others (as a share of the widest altitude) adds nothing but rounding.
MIN_ALTITUDE, MAX_CONDITION = 0.01, 1e4
# Bounds are loosened by this share of the apexes' squared lengths: far over the rounding of coordinates so conditioned.
SLACK = 1e-4
BATCH_ROWS = 8192


@dataclass(frozen=True)
class Base:
    """The base simplex: pivots, squared distances of the first to the others, and the inverse of its triangular matrix."""

    pivots: np.ndarray
    edges: np.ndarray
    inverse: np.ndarray

    def apexes(self, values: np.ndarray) -> np.ndarray:
        """Apex coordinates of vectors, from their squared distances to the pivots: the last one is the height."""
        gaps = distances(values, self.pivots).astype(np.float64)
        along = (gaps[:, :1] + self.edges - gaps[:, 1:]) / 2
        flat = along @ self.inverse.T
        return np.column_stack([flat, np.sqrt(np.maximum(gaps[:, 0] - (flat * flat).sum(axis=1), 0))])


def base_of(points: np.ndarray) -> Base:
    """A base from the points in their order, without those that (nearly) lie in the span of earlier ones."""
    pivots, directions = [points[0]], []
    altitudes: list[float] = []
    for p in points[1:]:
        rest = (p - pivots[0]).astype(np.float64)
        for d in directions:
            rest = rest - (rest @ d) * d
        height = float(np.sqrt(rest @ rest))
        if height and height >= MIN_ALTITUDE * max(altitudes, default=0.0):
            if np.linalg.cond(_triangle([*pivots, p], [*directions, rest / height])) <= MAX_CONDITION:
                pivots.append(p)
                directions.append(rest / height)
                altitudes.append(height)
    chosen = np.array(pivots)
    if not directions:
        return Base(chosen, np.zeros((1, 0)), np.zeros((0, 0)))
    edges = distances(chosen[:1], chosen[1:]).astype(np.float64)
    return Base(chosen, edges, np.linalg.inv(_triangle(pivots, directions)))


def _triangle(points: list[np.ndarray], directions: list[np.ndarray]) -> np.ndarray:
    """Coordinates of the base's corners: row i is corner i + 1, zero beyond its own direction."""
    sides = (np.array(points[1:]) - points[0]).astype(np.float64)
    return np.tril(sides @ np.array(directions).T)


def candidates(apexes: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Which centroids (their apexes: ``corners``) can be nearest to which vectors."""
    own, other = (apexes * apexes).sum(axis=1)[:, None], (corners * corners).sum(axis=1)[None, :]
    low = own + other - 2 * apexes @ corners.T
    high = low + 4 * apexes[:, -1:] * corners[:, -1][None, :]
    slack = SLACK * (own + other) + 1e-6
    return low - slack <= (high + slack).min(axis=1, keepdims=True)


def nearest(values: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, base: Base, measured: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance): ties to the smaller number.

    Without ``measured`` the distance of a vector whose bounds leave one
    centroid is not computed.
    """
    able = candidates(apexes, base.apexes(centroids))
    found = np.full(able.shape, np.iinfo(np.int64).max)
    single = able.sum(axis=1) == 1
    found[single, able[single].argmax(axis=1)] = 0
    for c in range(len(centroids)):
        rows = np.flatnonzero(able[:, c] if measured else able[:, c] & ~single)
        found[rows, c] = distances(values[rows], centroids[c : c + 1])[:, 0]
    best = found.argmin(axis=1)
    return best, found[np.arange(len(best)), best]


def moved(centroids: list[list[int]], sums: dict[tuple[int, int], int], counts: dict[int, int]) -> list[list[int]]:
    """Centroids after a round: componentwise floor of the mean, in whole numbers of any size; empty ones stay."""
    return [[sums[c, i] // counts[c] for i in range(len(old))] if counts.get(c) else old for c, old in enumerate(centroids)]


def _sample_rounds(sample: np.ndarray, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    for _ in range(rounds):
        now = np.array(centroids, np.int64)
        best = distances(sample, now).argmin(axis=1)
        centroids = [sample[best == c].sum(axis=0) // (best == c).sum() if (best == c).any() else now[c] for c in range(len(now))]
    return [[int(x) for x in c] for c in centroids]


def _round(stored: DataFrame, centroids: list[list[int]], base: Base) -> list[list[int]]:
    width = len(centroids[0])

    def add(batches):
        now = np.array(centroids, np.int64)
        sums, counts = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for batch in batches:
            values = matrix(batch.column("codes"), width)
            best, _ = nearest(values, _floats(batch.column("apex"), len(base.pivots)), now, base, False)
            for c in np.unique(best):
                sums[c] += values[best == c].sum(axis=0)
            counts += np.bincount(best, minlength=len(now))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used]), lists(sums[used], pa.int64())], names=["cluster", "n", "sums"]
        )

    told = stored.select("codes", "apex").mapInArrow(add, "cluster int, n long, sums array<long>")
    long = told.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    totals = long.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    return moved(centroids, {(r.cluster, r.at): int(r.total) for r in totals}, {r.cluster: r.n for r in totals})


def _floats(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def cluster(
    vectors: DataFrame, column: str = "embedding", key: str = "vec_id", keep: list[str] | None = None, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """Columns ``keep`` (all) of the vectors of ``dims`` components with cluster and distance, and the final centroids.

    Kept columns may have any name; those called cluster or distance are replaced. Vectors that are null, of another
    length (empty ones too) or with a null or non-finite component are left
    out. The first centroids are the vectors whose keys have the least hashes
    of ``seed:key``; rows without key come last among them, and of rows with
    one key the smaller vector first. Repeated rows are vectors of their own,
    so equal centroids can occur; the smaller number then has all vectors. With
    fewer vectors than clusters there are as many centroids as vectors. An
    empty table gives no rows and no centroids.
    """
    spark = vectors.sparkSession
    names = [F.col(f"`{c}`") for c in (vectors.columns if keep is None else keep) if c.lower() not in ("cluster", "distance")]
    read = vectors.select(*names, F.col(f"`{column}`").alias("__vector"), F.col(f"`{key}`").alias("__key"))
    shield, named = shielded(read, "__vector", "__key")
    fine = shield.where(usable("__vector") & (F.size("__vector") == dims))
    kept = settle(fine.withColumn("__codes", whole("__vector", scale)).drop("__vector"), "cluster-vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__key").cast("string")).cast("binary"), 256)
    first = kept.orderBy(hashed.asc_nulls_last(), "__codes").limit(clusters).select("__codes").collect()
    out = spark.createDataFrame([], "cluster int, distance long").schema
    if not first:
        empty = kept.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "__vector": F.lit(None)})
        return empty.select(*named(empty)[:-2], "cluster", "distance"), []
    centroids = [[int(x) for x in r[0]] for r in first]
    sample = kept.orderBy(F.xxhash64("__codes")).limit(PIVOT_ROWS).select("__codes").toArrow()
    led = _sample_rounds(matrix(sample["__codes"], dims), centroids, rounds)
    base = base_of(np.array(centroids + led, np.int64))

    def project(batches):
        for batch in batches:
            apexes = base.apexes(matrix(batch.column("__codes"), dims))
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__key"]
            yield pa.RecordBatch.from_arrays(
                [*columns, lists(apexes, pa.float64())], names=[*[n for n in batch.schema.names if n != "__key"], "apex"]
            )

    carried = kept.drop("__key")
    schema = kept.drop("__key").withColumn("apex", F.array(F.lit(0.0))).schema
    stored = settle(carried.mapInArrow(project, schema).withColumnRenamed("__codes", "codes"), "cluster-apexes")
    for _ in range(rounds):
        centroids = _round(stored, centroids, base)

    def assign(batches):
        now = np.array(centroids, np.int64)
        for batch in batches:
            values = matrix(batch.column("codes"), dims)
            best, gap = nearest(values, _floats(batch.column("apex"), len(base.pivots)), now, base, True)
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("codes", "apex")]
            rest = [n for n in batch.schema.names if n not in ("codes", "apex")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.int32()), pa.array(gap)], names=[*rest, "cluster", "distance"])

    final = stored.drop("codes", "apex")
    schema = type(out)([*final.schema.fields, *out.fields])
    made = settle(stored.mapInArrow(assign, schema), "cluster-assigned").withColumns({"__vector": F.lit(None), "__key": F.lit(None)})
    return made.select(*named(made)[:-2], "cluster", "distance"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` (cluster, distance) with the summed distances of each cluster and of all, and the digest of its centroid."""
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    if not centroids:
        return assigned.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    at = F.col("cluster") + 1
    return assigned.withColumns(
        {
            "cluster_inertia": F.element_at(F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))]), at),
            "inertia": F.lit(sum(sums.values())).cast("long"),
            "centroid_sha256": F.element_at(F.array(*map(F.lit, digests)), at),
        }
    )


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster, distance and inertia of every embedding of 64 components."""
    assigned, centroids = cluster(table(spark, folder, "embeddings"), keep=["vec_id"])
    return with_inertia(assigned, centroids)


def _sql() -> str:
    """One assignment and one mean a round, each a table of its own."""
    dot = "CAST(list_inner_product(CAST(v.c AS DOUBLE[]), CAST(k.c AS DOUBLE[])) AS BIGINT)"
    gap = f"v.s - 2 * {dot} + CAST(list_inner_product(CAST(k.c AS DOUBLE[]), CAST(k.c AS DOUBLE[])) AS BIGINT)"
    parts = [
        f"""RECURSIVE ok AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "v AS MATERIALIZED (SELECT *, CAST(list_inner_product(CAST(c AS DOUBLE[]), CAST(c AS DOUBLE[])) AS BIGINT) AS s FROM ok)",
        f"""k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, c) - 1 AS k, c FROM v
  ORDER BY k LIMIT {CLUSTERS})""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, d[1] AS gap, d[2] AS k FROM
  (SELECT v.r, min([{gap}, k.k]) AS d FROM v CROSS JOIN k{i} k GROUP BY v.r))"""
        )
        if i < ROUNDS:
            parts.append(
                f"""m{i} AS MATERIALIZED (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, (s - ((s % n) + n) % n) // n AS x FROM
  (SELECT a.k, i, CAST(sum(v.c[i]) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{i} a USING (r), range(1, {DIMS + 1}) t(i) GROUP BY a.k, i)) GROUP BY k)"""
            )
            parts.append(f"k{i + 1} AS MATERIALIZED (SELECT k{i}.k, coalesce(m.c, k{i}.c) AS c FROM k{i} LEFT JOIN m{i} m USING (k))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(gap AS BIGINT) AS distance, CAST(sum(gap) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(gap) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN k{ROUNDS} k ON a.k = k.k"""


OP13_SQL = _sql()
