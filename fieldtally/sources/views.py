"""A folder of order, line item, customer, event and document tables seen as survey tables.

Orders are interviews, customers are the households of the sample frame, line
items are rosters, events are paradata and documents are open answers. The
tables hold no NULLs, so expressions put some in to exercise missing answers.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.session import spread

RESULTS = {1: "Completed", 2: "Partial", 3: "Refused"}
CONCERN_LEVELS = ["Very concerned", "Concerned", "Neutral", "Not concerned"]
ETHNIC_GROUPS = ["Mestizo/Hispanic/Latino", "Creole", "Mennonite", "Garifuna", "Maya"]
OPTIONS = [f"m__{i}" for i in range(1, 6)]
CONCERNS = [f"a1_{i}" for i in range(1, 4)]

# Columns of the tables read here; giving them spares a pass over the footers.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def _labels(expr: str, labels: list[str], first: int = 0) -> str:
    whens = " ".join(f"WHEN {expr} = {i} THEN '{label}'" for i, label in enumerate(labels, start=first))
    return f"CASE {whens} END"


class SurveyTables:
    """Survey tables of one folder. Every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def spread(self, *names: str) -> SurveyTables:
        """The same, with shuffles that start with partitions enough for the named tables."""
        spread(self.spark, *[f"{self.folder}/{name}.parquet" for name in names])
        return self

    @cached_property
    def interviews(self) -> DataFrame:
        """One row per interview, answers included."""
        key = "o_orderkey"
        concerns = {
            c: f"coalesce({_labels(f'(o_custkey + {i} * {key}) % 5', CONCERN_LEVELS, first=1)}, 'Not stated')"
            for i, c in enumerate(CONCERNS, start=1)
        }
        options = {
            c: f"CASE WHEN {key} % 7 = 0 THEN NULL WHEN (o_custkey + {i} * {key}) % 3 = 0 THEN 1 ELSE 0 END"
            for i, c in enumerate(OPTIONS, start=1)
        }
        columns = {
            "interview_key": key,
            "interview_id": f"concat('iv-', {key})",
            "address_id": "o_custkey",
            "result_code": f"CASE WHEN {key} % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1 "
            "WHEN o_orderstatus = 'P' THEN 2 ELSE 3 END",
            "result": f"CASE WHEN {key} % 13 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Completed' "
            "WHEN o_orderstatus = 'P' THEN 'Partial' ELSE 'Refused' END",
            "responsible": f"concat('interviewer', {key} % 7)",
            "round": "o_orderpriority",
            "q1": f"CASE WHEN {key} % 11 = 0 THEN NULL ELSE o_orderpriority END",
            "q2": f"CASE ({key} + o_custkey) % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Yes' WHEN 2 THEN 'Yes' "
            "WHEN 5 THEN 'DK' WHEN 6 THEN NULL ELSE 'No' END",
            "amount": "o_totalprice",
            **concerns,
            **options,
            "m_1": f"CASE WHEN {key} % 50 = 0 THEN 'other' END",
        }
        return self.raw("orders").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])

    @cached_property
    def places(self) -> DataFrame:
        """Household address, community and strata by ``address_id``."""
        nation, region = self.raw("nation"), self.raw("region")
        joined = (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        )
        return joined.selectExpr(
            "c_custkey AS address_id",
            "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE n_name END AS community",
            "r_name AS district",
            "c_nationkey AS ed",
            "CASE WHEN n_nationkey IN (1, 2) THEN 'A' ELSE 'B' END AS strata",
            "c_mktsegment AS segment",
            "CAST(c_custkey div 100 AS INT) AS building_number",
            "CAST((c_custkey div 5) % 10 AS INT) AS dwelling_number",
            "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS INT) END AS household_number",
            "c_name AS head_name",
        )

    @cached_property
    def households(self) -> DataFrame:
        """Interviews with their place."""
        return self.interviews.join(self.places, "address_id", "left")

    @cached_property
    def roster(self) -> DataFrame:
        """Household members, many per interview."""
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS interview_key",
            "l_linenumber AS rel",
            "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS sex",
            "CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_partkey % 83 AS INT) END AS age",
            f"{_labels('l_suppkey % 5', ETHNIC_GROUPS)} AS ethnicity",
            "CASE WHEN l_suppkey % 23 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS ed_attending",
            "CASE WHEN l_suppkey % 29 = 0 THEN 999999 ELSE CAST(l_quantity AS INT) % 21 END AS ed_clevel",
            "CASE WHEN l_partkey % 37 = 0 THEN 999999 ELSE CAST(l_partkey % 22 AS INT) END AS ed_llevel",
            "CAST(1 + l_partkey % 2 AS INT) AS employed",
            "CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 7 THEN 888888 WHEN 8 THEN 999999 "
            "ELSE CAST(l_partkey % 9 AS INT) END AS workertype",
        )

    @cached_property
    def ratings(self) -> DataFrame:
        """Rated items, seven at most per interview in a clean survey."""
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS interview_key",
            "l_linenumber AS rated_item",
            "CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) % 5 + 1 END AS rate",
        )

    @cached_property
    def weights(self) -> DataFrame:
        """Design weights as delivered, DECIMAL(18,8); partial interviews have none and some weigh 0."""
        return (
            self.raw("orders")
            .filter("o_orderstatus <> 'P'")
            .selectExpr(
                "o_orderkey AS interview_key",
                "CAST(CAST(o_orderkey % 8 AS DECIMAL(2,0)) * CAST(2.0625 AS DECIMAL(5,4)) AS DECIMAL(18,8)) AS hh_weight",
                "CAST(CAST(o_orderkey % 17 AS DECIMAL(2,0)) * CAST(1.25 AS DECIMAL(5,4)) AS DECIMAL(18,8)) AS ind_weight",
            )
        )

    @cached_property
    def frame(self) -> DataFrame:
        """Sample frame: every household with address, community and coordinates as text.

        Every thirteenth stands at an address where nobody was interviewed.
        """
        return self.raw("customer").join(
            self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
        ).selectExpr(
            "c_custkey AS frame_id",
            "n_name AS frame_community",
            "c_nationkey AS ed",
            "c_name AS frame_head",
            "CAST(c_custkey div 100 AS INT) AS building_number",
            "CAST((c_custkey div 5) % 10 AS INT) AS dwelling_number",
            "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 9 ELSE CAST(c_custkey % 5 AS INT) END "
            "AS household_number",
            "CASE WHEN c_custkey % 31 = 0 THEN 'no fix' ELSE CAST(-88 - (c_custkey % 100) / 1000.0D AS STRING) END AS lon",
            "CASE WHEN c_custkey % 31 = 0 THEN '' ELSE CAST(17 + (c_custkey % 37) / 1000.0D AS STRING) END AS lat",
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Actions log; a purchase plays the part of completing an interview."""
        return self.raw("events").selectExpr(
            "user_id AS interview_key",
            "CASE event_type WHEN 'purchase' THEN 'Completed' ELSE event_type END AS action",
            "ts AS date",
            "event_id AS action_id",
            "value AS amount",
        )

    @cached_property
    def diagnostics(self) -> DataFrame:
        """Paradata: duration text and interviewer per interview."""
        return self.raw("events").selectExpr(
            "event_id AS interview_key",
            "concat('interviewer', event_id % 7) AS responsible",
            "CASE WHEN event_id % 97 = 0 THEN 'unknown' ELSE concat('0', event_id % 3, '.', "
            "lpad(CAST(event_id % 24 AS STRING), 2, '0'), ':', lpad(CAST(event_id % 60 AS STRING), 2, '0'), ':', "
            "lpad(CAST((event_id * 7) % 60 AS STRING), 2, '0')) END AS duration",
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Open answers, whole texts."""
        return self.raw("documents").selectExpr("doc_id AS answer_id", "text AS answer", "lang", "source")

    @cached_property
    def polygons(self) -> DataFrame:
        """Building outlines, one row per vertex: rectangles and L-shapes, closed or not, turned either way,
        numbered with gaps or across parts; triangles, lines and points."""
        shapes = [
            [(1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, 0, 0)],
            [(10, 0, 0), (20, 3, 0), (30, 3, 1), (50, 1, 1), (60, 1, 3), (9000, 0, 3)],
            [(1, 0, 0), (2, 0, 2), (4, 3, 0)],
            [(7, 0, 0), (8, 0, 3), (9, 1, 3), (10, 1, 1), (11, 3, 1), (5000, 3, 0), (5001, 0, 0)],
            [(3, 2, 2)],
            [(1, 0, 0), (2, 4, 2), (3, 0, 0)],
        ]
        rings = ["array(" + ", ".join(f"struct({s}, {x}, {y})" for s, x, y in shape) + ")" for shape in shapes]
        whens = " ".join(f"WHEN {i} THEN {ring}" for i, ring in enumerate(rings))
        corners = f"CASE c_custkey % {len(shapes)} {whens} END"
        return (
            self.raw("customer")
            .select("c_custkey", F.explode(F.expr(corners)).alias("v"))
            .selectExpr(
                "c_custkey AS polygon_id",
                "v.col1 AS seq",
                "-88 - (c_custkey % 100) / 1000.0D + v.col2 * (1 + c_custkey % 7) * 0.001D AS lon",
                "17 + (c_custkey % 37) / 1000.0D + v.col3 * (1 + c_custkey % 5) * 0.001D AS lat",
            )
        )
