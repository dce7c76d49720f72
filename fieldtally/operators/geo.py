"""Building polygons to points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.operators.linkage import attach_one

# Vertices of a polygon are gathered in parts of this many sequence numbers.
PART = 4096
# A polygon whose doubled area is this small against its squared edges is a line or a point.
FLAT = 1e-9


def polygon_centroids(
    vertices: DataFrame, key: str = "polygon_id", part: int = PART, ring: str | None = None, hole: str | None = None
) -> DataFrame:
    """Area centroid per polygon: (key, lon, lat), one row for every key of ``vertices`` (key, seq, lon, lat).

    The order of ``seq`` is the order of the ring, gaps do no harm; a ring that
    is not closed is closed. Vertices without a coordinate are left out; a
    polygon without any left has no coordinates. A polygon without area (a
    point, a line) has the mean of its vertices, a closing vertex left out.

    A polygon of several rings names them by the column ``ring``: parts that
    lie side by side, and holes. Their signed areas and moments are added, so
    a hole is a ring that runs the other way round than its part. Where
    directions cannot be trusted the column ``hole`` tells which rings are
    holes, and no direction matters then.

    A ring whose order is not known is an error when the result is used: a
    vertex with a place but without ``seq``, or two different places of a ring
    with the same one. A vertex that is given twice counts once.

    The vertices are read once and gathered by polygon and part of its
    sequence, so a huge polygon is spread over tasks. Each part gives sums
    relative to its first vertex, as a building's area would drown in the
    rounding of products of full coordinates; only these few numbers per part
    meet by polygon, where they are moved to one origin and joined by the edges
    between parts.
    """
    keys = [key, *([ring] if ring else [])]
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    point = F.when(
        known & F.col("seq").isNotNull(), F.struct("seq", F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
    )
    flag = F.max(F.coalesce(F.col(hole), F.lit(False))) if hole else F.lit(None).cast("boolean")
    # A set keeps a vertex that is given twice once; one without a place in the order is only told of.
    gathered = vertices.groupBy(*keys, F.floor(F.coalesce(F.col("seq"), F.lit(0)) / part).alias("__part")).agg(
        F.array_sort(F.collect_set(point)).alias("p"),
        F.count_if(known & F.col("seq").isNull()).alias("__loose"),
        flag.alias("__hole"),
    )
    twice = F.expr("size(p) <> size(array_distinct(transform(p, v -> v.seq)))")
    wrong = F.raise_error(F.concat(F.lit("vertices of unknown order in polygon "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    checked = F.when((F.col("__loose") > 0) | twice, wrong.cast(gathered.schema["p"].dataType)).otherwise(F.col("p"))
    parts = gathered.withColumn("p", checked).withColumn("n", F.size("p"))
    # Vertices relative to the part's first, and the edges between neighbours.
    local = parts.withColumn("q", F.expr("transform(p, v -> struct(v.x - p[0].x AS x, v.y - p[0].y AS y))"))
    edges = local.withColumn(
        "e",
        F.expr(
            "transform(IF(n > 1, sequence(1, n - 1), array()),"
            " i -> struct(q[i - 1].x AS x0, q[i - 1].y AS y0, q[i].x AS x1, q[i].y AS y1, "
            "q[i - 1].x * q[i].y - q[i].x * q[i - 1].y AS cross))"
        ),
    )

    def total(term: str, over: str = "e") -> str:
        return f"aggregate({over}, 0D, (a, e) -> a + {term})"

    sums = edges.selectExpr(
        *[f"`{k}`" for k in keys],
        "__part",
        "__hole",
        "n",
        "get(p, 0).x AS fx",
        "get(p, 0).y AS fy",
        "get(q, n - 1).x AS lx",
        "get(q, n - 1).y AS ly",
        f"{total('e.x', 'q')} AS sx",
        f"{total('e.y', 'q')} AS sy",
        f"{total('e.cross')} AS a",
        f"{total('(e.x0 + e.x1) * e.cross')} AS mx",
        f"{total('(e.y0 + e.y1) * e.cross')} AS my",
        f"{total('(e.x0 + e.x1) * (e.y1 - e.y0)')} AS xdy",
        f"{total('(e.y0 + e.y1) * (e.x1 - e.x0)')} AS ydx",
        f"{total('pow(e.x1 - e.x0, 2) + pow(e.y1 - e.y0, 2)')} AS len2",
    )
    # Parts without a vertex have nulls in place of their sums and are passed over.
    whole = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = Window.partitionBy(*keys).orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    placed = sums.withColumns(
        {
            "ox": F.first("fx", ignorenulls=True).over(whole),
            "oy": F.first("fy", ignorenulls=True).over(whole),
            "nx": F.first("fx", ignorenulls=True).over(after),
            "ny": F.first("fy", ignorenulls=True).over(after),
        }
    ).withColumns({"last": F.col("nx").isNull(), "nx": F.coalesce("nx", "ox"), "ny": F.coalesce("ny", "oy")})
    # Move a part's sums by (dx, dy), and add the edge from its last vertex to the next part or back to the start.
    moved = placed.selectExpr(
        "*", "fx - ox AS dx", "fy - oy AS dy", "fx - ox + lx AS ex", "fy - oy + ly AS ey", "nx - ox AS gx", "ny - oy AS gy"
    ).selectExpr(
        "*", "a + dx * ly - dy * lx AS ta", "ex * gy - gx * ey AS bridge", "last AND ex = 0 AND ey = 0 AS back"
    )
    rings = moved.groupBy(*keys).agg(
        F.first("ox", ignorenulls=True).alias("ox"),
        F.first("oy", ignorenulls=True).alias("oy"),
        F.sum(F.expr("ta + bridge")).alias("a2"),
        F.sum(F.expr("mx + dx * xdy - dy * lx * lx + 2 * dx * ta + (ex + gx) * bridge")).alias("mx"),
        F.sum(F.expr("my + dx * ly * ly - dy * ydx + 2 * dy * ta + (ey + gy) * bridge")).alias("my"),
        F.sum(F.expr("len2 + pow(gx - ex, 2) + pow(gy - ey, 2)")).alias("len2"),
        F.sum(F.expr("sx + n * dx")).alias("sx"),
        F.sum(F.expr("sy + n * dy")).alias("sy"),
        F.sum("n").alias("n"),
        F.bool_or("back").alias("back"),
        F.bool_or("__hole").alias("__hole"),
    )
    # The first vertex of a ring is its origin: where it stands again at the end it adds nothing to the sums but one to the count.
    rings = rings.withColumn("n", F.col("n") - F.when(F.col("back") & (F.col("n") > 1), 1).otherwise(0))
    if ring:
        rings = _together(rings, key, hole is not None)
    flat = F.abs("a2") <= F.col("len2") * FLAT
    n = F.col("n")
    return rings.select(
        key,
        (F.col("ox") + F.when(flat, F.try_divide("sx", n)).otherwise(F.try_divide("mx", F.col("a2") * 3))).alias("lon"),
        (F.col("oy") + F.when(flat, F.try_divide("sy", n)).otherwise(F.try_divide("my", F.col("a2") * 3))).alias("lat"),
    )


def _together(rings: DataFrame, key: str, told: bool) -> DataFrame:
    """The sums of a polygon's rings, moved to one origin and added by their sign.

    With ``told`` a ring's sign is that of its flag and not of its direction.
    """
    # The origin of any ring will do; the least is the same however rows are dealt.
    placed = rings.withColumn("__o", F.when(F.col("ox").isNotNull(), F.struct("ox", "oy"))).withColumn("__at", F.min("__o").over(Window.partitionBy(key)))
    sign = F.when(F.col("__hole"), -1.0).otherwise(1.0) * F.signum("a2") if told else F.lit(1.0)
    moved = placed.withColumns({"s": sign, "dx": F.col("ox") - F.col("__at.ox"), "dy": F.col("oy") - F.col("__at.oy")})
    return moved.groupBy(key).agg(
        F.max("__at.ox").alias("ox"),
        F.max("__at.oy").alias("oy"),
        F.sum(F.expr("s * a2")).alias("a2"),
        F.sum(F.expr("s * (mx + 3 * dx * a2)")).alias("mx"),
        F.sum(F.expr("s * (my + 3 * dy * a2)")).alias("my"),
        F.sum("len2").alias("len2"),
        F.sum(F.expr("sx + n * dx")).alias("sx"),
        F.sum(F.expr("sy + n * dy")).alias("sy"),
        F.sum("n").alias("n"),
    )


def refresh_coordinates(frame: DataFrame, points: DataFrame, frame_key: str, point_key: str) -> DataFrame:
    """Replace the frame's coordinates; rows without a new point get NULL."""
    fresh = points.select(F.col(point_key).alias(frame_key), "lon", "lat")
    return attach_one(frame.drop("lon", "lat"), fresh, [frame_key])
