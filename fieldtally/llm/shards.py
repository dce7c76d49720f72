"""Sharding along a Hilbert curve, so that every file holds a compact box of the metadata space.

Everything is DataFrame expressions. A value's cell is the share of rows below
it, so cells hold equal numbers of rows whatever the scale and its outliers;
the borders are found exactly, by counting on ever finer steps round them, and
the curve runs through the cells. Rows are sorted by curve index and cut into
runs whose row counts differ by one at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.tables import table
from fieldtally.session import settle

N_SHARDS = 16
BITS = 4  # cells per dimension: 2 ** BITS
FINE = 4096  # steps a dimension is counted on at a time: bounds what a count brings to the driver
FILE_ROWS = 1 << 20  # rows of a file that write_shards writes, at most about so many


@dataclass(frozen=True)
class Dimension:
    """A whole-number measure of a row; nulls come first, in cell 0."""

    name: str
    value: Column


def text_value(df: DataFrame, name: str) -> Column:
    """A number in the order of a string column: its five bytes after the prefix that all values share."""
    least, most = df.agg(F.min(name), F.max(name)).first()
    shared = 0
    if least is not None:
        a, b = least.encode(), most.encode()
        while shared < min(len(a), len(b)) and a[shared] == b[shared]:
            shared += 1
    raw = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), shared + 1, 5)), 10, "0")
    return F.conv(raw, 16, 10).cast("long")


def log_value(name: str) -> Column:
    """A count from 1 on a scale of 64 steps per doubling, in whole numbers."""
    digits = f"length(bin(`{name}`))"
    return F.expr(f"{digits} * 64 + (shiftright(shiftleft(`{name}`, 6), {digits} - 1) & 63)").cast("long")


def _step(name: str, spans: list[tuple[int, int]], steps: int) -> Column:
    """Which span a value is in and which of its ``steps`` equal steps, as one number; null outside all spans."""
    whole = f"CAST(`{name}` AS DECIMAL(20,0))"
    number = F.lit(None).cast("long")
    for i, (least, most) in enumerate(spans):
        within = f"CAST((({whole} - {least}BD) * {steps}) div {most - least + 1}BD AS BIGINT) + {i * steps}"
        number = F.when(F.expr(f"`{name}` BETWEEN {least}L AND {most}L"), F.expr(within)).otherwise(number)
    return number


def _counted(df: DataFrame, spans: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int, int, int]]]:
    """Per column the steps of its spans in order: span, rows, least and greatest value. At most FINE a column."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("value"), _step(c, s, FINE // len(s)).alias("step"))
        for c, s in spans.items()
    ]
    steps = df.select(F.explode(F.array(*cells)).alias("x")).where("x.step IS NOT NULL").groupBy("x.column", "x.step")
    found: dict[str, list] = {c: [] for c in spans}
    for r in steps.agg(F.count("*").alias("n"), F.min("x.value").alias("least"), F.max("x.value").alias("most")).collect():
        found[r["column"]].append((r["step"] // (FINE // len(spans[r["column"]])), r["n"], r["least"], r["most"], r["step"]))
    return {c: [t[:4] for t in sorted(made, key=lambda t: t[4])] for c, made in found.items()}


def quantile_borders(df: DataFrame, columns: list[str], cells: int) -> dict[str, dict[int, int]]:
    """Per column and cell from 1 on, the least value with that share of all rows, cell / cells, or more below it.

    Exact. Each round counts the rows of a step; a step of several values in
    which a border lies is counted again on a scale between its own least and
    greatest value, so an outlier costs a round and no precision. A round is
    one pass over all columns that are not done; whole numbers of 64 bits take
    eight at most. Nulls lie below all values.
    """
    ends = df.agg(F.count("*"), *[f(c) for c in columns for f in (F.count, F.min, F.max)]).first()
    total = ends[0]
    borders: dict[str, dict[int, int]] = {c: {} for c in columns}
    # Open spans of a column: least and greatest value, rows below, the value after the span, borders in it.
    opened = {}
    for i, c in enumerate(columns):
        n, least, most = ends[1 + 3 * i : 4 + 3 * i]
        if n:
            opened[c] = [(least, most, total - n, None, range(1, cells))]
    while opened:
        counted = _counted(df, {c: [s[:2] for s in spans] for c, spans in opened.items()})
        further: dict[str, list] = {}
        for c, spans in opened.items():
            for i, (_, _, below, after, wanted) in enumerate(spans):
                steps = [t[1:] for t in counted[c] if t[0] == i]
                inside: dict[int, list[int]] = {}
                for k in wanted:
                    before = below
                    for j, (n, least, _) in enumerate(steps):
                        if before * cells >= k * total:
                            borders[c][k] = least
                            break
                        if (before + n) * cells > k * total and steps[j][1] != steps[j][2]:
                            inside.setdefault(j, []).append(k)
                            break
                        before += n
                    else:
                        if after is not None:
                            borders[c][k] = after
                for j, ks in inside.items():
                    next_value = steps[j + 1][1] if j + 1 < len(steps) else after
                    start = below + sum(n for n, _, _ in steps[:j])
                    further.setdefault(c, []).append((*steps[j][1:], start, next_value, ks))
        opened = further
    return borders


def with_cells(df: DataFrame, dimensions: list[Dimension], bits: int = BITS) -> DataFrame:
    """``df`` with a column __cell_i per dimension: 2**bits times the share of rows with a smaller value, in whole numbers.

    Nulls are in cell 0; equal values share a cell. What comes to the driver is
    at most ``FINE`` counts per dimension and round, whatever the number of rows.
    """
    df = df.withColumns({f"__value_{i}": d.value.cast("long") for i, d in enumerate(dimensions)})
    values = [f"__value_{i}" for i in range(len(dimensions))]
    borders = quantile_borders(df, values, 1 << bits)
    made = {}
    for i, c in enumerate(values):
        number = F.lit(0)
        for cell, least in sorted(borders[c].items()):
            number = F.when(F.col(c) >= F.lit(least).cast("long"), cell).otherwise(number)
        made[f"__cell_{i}"] = number
    return df.withColumns(made).drop(*values)


def with_curve(df: DataFrame, axes: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """``df`` with the position of a row's cell along the Hilbert curve; the axes' columns go.

    Undo the rotations from the top bit down, Gray-encode, interleave the bits.
    Each step is a column of its own, so that expressions do not multiply.
    """
    first = axes[0]
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for c in axes:
            # A set bit turns the lower bits of the first axis over, else they change places with this axis's.
            kept = f"`{first}` & ~{low}"
            turned = f"CASE WHEN `{c}` & {q} <> 0 THEN `{first}` ^ {low} ELSE ({kept}) | (`{c}` & {low}) END"
            given = f"CASE WHEN `{c}` & {q} <> 0 THEN `{c}` ELSE (`{c}` & ~{low}) | (`{first}` & {low}) END"
            steps = {first: F.expr(turned)}
            if c != first:
                steps[c] = F.expr(given)
            df = df.withColumns(steps)
    for before, c in zip(axes, axes[1:], strict=False):
        df = df.withColumn(c, F.expr(f"`{c}` ^ `{before}`"))
    flip = " ^ ".join(f"IF(`{axes[-1]}` & {1 << level} <> 0, {(1 << level) - 1}, 0)" for level in range(bits - 1, 0, -1))
    df = df.withColumn("__flip", F.expr(flip or "0"))
    terms = [
        f"CAST((`{c}` ^ __flip) & {1 << level} AS BIGINT) * {1 << (level * len(axes) + len(axes) - 1 - i - level)}"
        for level in range(bits)
        for i, c in enumerate(axes)
    ]
    return df.withColumn(name, F.expr(" + ".join(terms))).drop("__flip", *axes)


def shard_rows(df: DataFrame, order: list[str], n_shards: int = N_SHARDS) -> DataFrame:
    """``df`` with shard and slot: rows in the given order, cut into runs of counts at most one apart.

    The rows are range-partitioned by the order and sorted within partitions,
    so no task holds more than its range; only the row counts of the partitions
    are summed up in one place. The last sort key is a row's place in the
    stored files ``df`` scans, so rows equal in ``order`` spread over tasks too.
    The sorted rows are written before they are counted: numbers and counts
    come from the same files whatever is lost later. An empty table gives no
    rows. Columns called shard or slot are replaced.
    """
    df = df.drop("shard", "slot")
    numbered = df.withColumn("__tie", F.monotonically_increasing_id())
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = numbered.repartitionByRange(n_parts, *order, "__tie").sortWithinPartitions(*order, "__tie")
    # The id counts rows within a partition from its number times 2**33.
    sorted_rows = settle(ordered.withColumn("__at", F.monotonically_increasing_id()), "shard-sorted")
    part = F.shiftright("__at", 33)
    counts = sorted_rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = counts.selectExpr(
        "__part", "sum(__n) OVER (ORDER BY __part) - __n AS __start", "sum(__n) OVER () AS __all"
    )
    # One row per partition of the sort: its size is bounded by their number.
    placed = sorted_rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("__place", place)
    shard = F.expr(f"(__place * {n_shards}) div __all")
    placed = placed.withColumn("shard", shard.cast("int"))
    slot = F.expr(f"__place - ((shard * __all + {n_shards - 1}) div {n_shards})")
    return placed.withColumn("slot", slot).select(*df.columns, "shard", "slot")


def hilbert_shards(
    df: DataFrame, dimensions: list[Dimension], ties: list[str], n_shards: int = N_SHARDS, bits: int = BITS
) -> DataFrame:
    """``df`` with curve (index), shard and slot; ``ties`` order the rows of one cell.

    Nulls of a dimension sort before its values, a dimension of one value adds
    nothing, equal rows in ``ties`` follow their place in the files, repeated
    rows are rows of their own, empty texts are values like others, an empty
    table gives no rows. Columns called curve, shard or slot are replaced,
    others of any name kept. ``df`` is a scan of stored
    files and should be narrow: join its result to the wide rows by their key and write them with
    ``write_shards``.
    """
    celled = with_cells(df, dimensions, bits)
    curved = with_curve(celled, [f"__cell_{i}" for i in range(len(dimensions))], bits)
    return shard_rows(curved, ["curve", *ties], n_shards)


def write_shards(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write rows that have shard and slot as one folder per shard, in files that are runs of its slots.

    Rows are dealt by shard and run of slots, about ``file_rows`` to a task, so
    a shard of any size is written by as many tasks as it needs. Every file is
    in slot order. The number of tasks comes from one count; an empty table
    writes no files.
    """
    n = df.count()
    if n:
        df = df.repartitionByRange(-(-n // file_rows), "shard", "slot").sortWithinPartitions("shard", "slot")
    df.write.mode("errorifexists").partitionBy("shard").parquet(path)


def op10_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards along a curve through language, source, size and age (document number)."""
    docs = table(spark, folder, "documents")
    narrow = settle(
        docs.select(
            "doc_id",
            F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        ),
        "shard-keys",
    )
    dimensions = [
        Dimension("lang", text_value(narrow, "lang")),
        Dimension("source", text_value(narrow, "source")),
        Dimension("size", log_value("size")),
        Dimension("doc_id", F.col("doc_id")),
    ]
    sharded = hilbert_shards(narrow, dimensions, ["text_crc32", "doc_id"])
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def _text_value_sql(name: str) -> str:
    low, high = (f"(SELECT hex(encode({f}({name}))) FROM documents)" for f in ("min", "max"))
    same = f"substr({low}, 1, 2 * i) = substr({high}, 1, 2 * i) AND 2 * i <= least(length({low}), length({high}))"
    shared = f"(SELECT max(i) FROM range(0, 100) t(i) WHERE {same})"
    return f"('0x' || rpad(substr(hex(encode({name})), 2 * {shared} + 1, 10), 10, '0'))::BIGINT"


def _curve_sql(source: str, axes: list[str], bits: int = BITS) -> str:
    """Rows of ``source`` with curve: one nested SELECT per step of the transform."""
    first, sql = axes[0], f"SELECT * FROM {source}"
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for c in axes:
            moved = f"CASE WHEN {c} & {q} <> 0 THEN xor({first}, {low}) ELSE ({first} & {15 - low}) | ({c} & {low}) END AS {first}"
            other = f", CASE WHEN {c} & {q} <> 0 THEN {c} ELSE ({c} & {15 - low}) | ({first} & {low}) END AS {c}" if c != first else ""
            sql = f"SELECT * REPLACE ({moved}{other}) FROM ({sql})"
    for before, c in zip(axes, axes[1:], strict=False):
        sql = f"SELECT * REPLACE (xor({c}, {before}) AS {c}) FROM ({sql})"
    flips = [f"CASE WHEN {axes[-1]} & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END" for level in range(bits - 1, 0, -1)]
    flip = flips[0]
    for f in flips[1:]:
        flip = f"xor({flip}, {f})"
    bit = [
        f"((xor({c}, flip) >> {level}) & 1) << {level * len(axes) + len(axes) - 1 - i}" for level in range(bits) for i, c in enumerate(axes)
    ]
    return f"SELECT *, CAST({' + '.join(f'({b})' for b in bit)} AS BIGINT) AS curve FROM (SELECT *, {flip} AS flip FROM ({sql}))"


_DIMS_SQL = {"lang": _text_value_sql("lang"), "source": _text_value_sql("source"), "size": "", "doc_id": "doc_id"}
_DIMS_SQL["size"] = "length(bin(size)) * 64 + (((size << 6) >> (length(bin(size)) - 1)) & 63)"
_AXES = [f"x{i}" for i in range(len(_DIMS_SQL))]
_VALUES = ", ".join(f"{v} AS v{i}" for i, v in enumerate(_DIMS_SQL.values()))
_CELLS = ", ".join(
    f"CASE WHEN v{i} IS NULL THEN 0 ELSE CAST(((rank() OVER (ORDER BY v{i} NULLS FIRST) - 1) * {1 << BITS}) // count(*) OVER () AS INTEGER) END AS x{i}"
    for i in range(len(_DIMS_SQL))
)
_CRC_POLYNOMIAL = 0xEDB88320
OP10_SQL = f"""
WITH RECURSIVE rounds(b, k, c) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_CRC_POLYNOMIAL}) ELSE c >> 1 END FROM rounds WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM rounds WHERE k = 8),
sized AS (
  SELECT doc_id, lang, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda b: ('0x' || b)::BIGINT)), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM documents, crc),
valued AS (SELECT *, {_VALUES} FROM sized),
celled AS (SELECT *, {_CELLS} FROM valued),
curved AS ({_curve_sql("celled", _AXES)}),
placed AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM curved)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((place * {N_SHARDS}) // n AS INTEGER) AS shard,
  CAST(place - (((place * {N_SHARDS}) // n) * n + {N_SHARDS - 1}) // {N_SHARDS} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, curve
FROM placed
"""
