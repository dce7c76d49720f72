from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldtally.session import settle, shared_dir
from fieldtally.sources import readers, schemas, writers


def test_weights_from_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("interview__key,hh_final_weight,ind_weights\n11-22,16.71428571,0\n33-44,,2.5\n")
    df = readers.read_weights(spark, str(tmp_path / "w.csv"))
    assert df.schema == schemas.WEIGHTS
    assert rows(df) == [("11-22", Decimal("16.71428571"), Decimal("0E-8")), ("33-44", None, Decimal("2.50000000"))]


def test_malformed_number_is_an_error(spark, tmp_path):
    (tmp_path / "w.csv").write_text("interview__key,hh_final_weight,ind_weights\n11-22,abc,1\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_weights(spark, str(tmp_path / "w.csv")).collect()


def test_assignments_round_trip(spark, tmp_path):
    row = (2, 26, 9, 9, "wood, yellow", "Head\tOne", 1, "01", 1, None, None, "interviewer1", 1, "13-47")
    df = spark.createDataFrame([row], schemas.ASSIGNMENTS)
    writers.write_tsv(df, str(tmp_path / "list"))
    assert rows(readers.read_assignments(spark, str(tmp_path / "list"))) == [row]


def test_frame_coordinates_become_numbers(spark):
    columns = "interview_key string, ed string, head_name string, ctv_official string, building_number int, " \
        "dwelling_number int, household_number int, lat string, lon string, extra string"
    raw = spark.createDataFrame([("k", "1", "h", "c", 1, 2, 3, "17.25", "west", "x")], columns)
    frame = readers.as_frame(raw)
    assert frame.columns == schemas.FRAME.names
    assert (frame.first()["lat"], frame.first()["lon"]) == (17.25, None)


def test_log_keeps_earlier_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_log(spark, path, "ann", "login", "America/Costa_Rica")
    writers.append_log(spark, path, "bo", "export")
    log = spark.read.parquet(path)
    assert rows(log.select("user", "action")) == [("ann", "login"), ("bo", "export")]
    by_user = {r.user: r.timestamp for r in log.collect()}
    assert round((by_user["bo"] - by_user["ann"]).total_seconds() / 3600) == 6


def test_tables_are_replaced_and_read_by_column(spark):
    first = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id int, name string")
    writers.replace_tables({"households_t": first, "members_t": first})
    writers.replace_tables({"households_t": first.filter("id < 3")})
    assert readers.read_table(spark, "households_t").count() == 3
    assert readers.read_table(spark, "members_t", ["name"], limit=2).columns == ["name"]
    assert readers.read_table(spark, "members_t", ["name"], limit=2).count() == 2
    spark.sql("DROP TABLE households_t")
    spark.sql("DROP TABLE members_t")


def test_export_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    for fmt in ("parquet", "csv"):
        writers.export_dataset(df, str(tmp_path / fmt), fmt)
    assert rows(readers.read_dataset(spark, str(tmp_path / "parquet"), ["id"])) == [(1,), (2,)]
    assert rows(readers.read_delimited(spark, str(tmp_path / "csv"), df.schema)) == rows(df)
    with pytest.raises(ValueError, match="xlsx"):
        writers.export_dataset(df, str(tmp_path / "x"), "xlsx")
    writers.replace_dataset(df, str(tmp_path / "parts"), ["id"])
    assert (tmp_path / "parts" / "id=1").is_dir()


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Context.master = "local[2]"
    assert shared_dir(Session())


def test_settled_rows_have_no_lineage(spark):
    df = spark.range(10).withColumn("x", F.rand(seed=None))
    stored = settle(df, "rand")
    assert rows(stored) == rows(stored)
    assert "Range" not in stored._jdf.queryExecution().optimizedPlan().toString()


def test_columns_by_prefix_and_position(spark):
    from fieldtally.operators import columns

    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "key int, unitList__1 int, k4__1 int, k4__2 int, sex int")
    assert columns.prefixed(df, "k4__") == ["k4__1", "k4__2"]
    assert columns.without_prefixed(df, "unitList", "k4").columns == ["key", "sex"]
    assert columns.between(df, "unitList__1", "k4__2") == ["unitList__1", "k4__1", "k4__2"]
    assert columns.move_after(df, ["sex"], "key").columns == ["key", "sex", "unitList__1", "k4__1", "k4__2"]
    with pytest.raises(ValueError, match="after"):
        columns.between(df, "sex", "key")
