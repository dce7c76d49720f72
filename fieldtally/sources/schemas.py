"""Columns of the tables a household survey export delivers.

Fixed values: names and types of the export. Question columns differ by
questionnaire and are appended by the caller, e.g. ``with_questions(HOUSEHOLD, k1="int")``.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    """``name TYPE, ...`` as a schema, without needing a session."""
    named = {
        "STRING": T.StringType(),
        "INT": T.IntegerType(),
        "DOUBLE": T.DoubleType(),
        "TIMESTAMP": T.TimestampType(),
        "WEIGHT": T.DecimalType(18, 8),
    }
    fields = [part.split() for part in ddl.replace("\n", " ").split(",")]
    return T.StructType([T.StructField(name, named[kind]) for name, kind in fields])


def with_questions(schema: T.StructType, **questions: str) -> T.StructType:
    """The schema with question columns added, types as ``int`` or ``string``."""
    extra = _schema(", ".join(f"{name} {kind.upper()}" for name, kind in questions.items()))
    return T.StructType([*schema.fields, *extra.fields])


HOUSEHOLD = _schema(
    """interview__key STRING, interview__id STRING, ctv STRING, ed STRING, building_number INT, dwelling_number INT,
    household_number INT, head_name STRING, result INT"""
)
MEMBERS = _schema(
    """interview__key STRING, rel INT, sex INT, age INT, ethnicity STRING, ed_attending INT, ed_clevel INT, ed_llevel INT,
    employed INT, workertype INT"""
)
RATINGS = _schema("interview__key STRING, k2_roster__id INT, k2_rate INT")
DIAGNOSTICS = _schema("interview__key STRING, responsible STRING, interview__duration STRING")
ACTIONS = _schema("interview__key STRING, action STRING, date TIMESTAMP, originator STRING, role STRING")
WEIGHTS = _schema("interview__key STRING, hh_final_weight WEIGHT, ind_weights WEIGHT")
FRAME = _schema(
    """interview_key STRING, ed STRING, head_name STRING, ctv_official STRING, building_number INT, dwelling_number INT,
    household_number INT, lat STRING, lon STRING"""
)
ASSIGNMENTS = _schema(
    """ctv INT, building_number INT, dwelling_number INT, household_number INT, description STRING, head_name STRING,
    language INT, ed STRING, team INT, lat DOUBLE, lon DOUBLE, responsible STRING, quantity INT, interview STRING"""
)
VERTICES = _schema("polygon_id STRING, seq INT, lon DOUBLE, lat DOUBLE")
