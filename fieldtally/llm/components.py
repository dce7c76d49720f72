"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.session import release, scratch_path

# Rounds grow with the logarithm of the longest chain; this many cover chains beyond any table.
MAX_ROUNDS = 60


def _stored(df: DataFrame, label: str, held: list[str]) -> DataFrame:
    """``df`` written to the shared folder; its path is put into ``held``."""
    held.append(scratch_path(df.sparkSession, label))
    df.write.parquet(held[-1])
    return df.sparkSession.read.schema(df.schema).parquet(held[-1])


def _large_star(links: DataFrame, held: list[str]) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest one the node knows.

    The node a large component hangs on has most of the links. What each node
    knows is stored before it is joined: of two plain shuffles adaptive
    execution splits the one that is skewed, which it cannot where a side is
    still being summed up.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    least = _stored(least, "star-least", held)
    return (
        both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).distinct()


def _small_star(links: DataFrame, held: list[str]) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    least = _stored(least, "star-least", held)
    hung = links.join(least, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is its smallest node.

    Links may repeat, run either way or join a node to itself (which adds
    nothing); null ends are ignored. Every round ends in a written table, so
    the lineage does not grow and a lost executor costs a read.
    """
    spark = links.sparkSession
    ends = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") != F.col("v")).alias("ok"))
    now = ends.where("ok").select("u", "v").distinct()
    before, path = None, None
    for _ in range(MAX_ROUNDS):
        following = scratch_path(spark, "stars")
        held: list[str] = []
        step = now if path is None else _small_star(_stored(_large_star(now, held), "large-stars", held), held)
        step.write.parquet(following)
        for done in held if path is None else [*held, path]:
            release(spark, done)
        path, now = following, spark.read.parquet(following)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError("links did not settle into components")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
