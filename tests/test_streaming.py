"""A stream run over arriving files must equal the batch query over all of them."""

from __future__ import annotations

import shutil

import pytest
from conftest import rows

from fieldtally.sources.views import SCHEMAS, SurveyTables
from fieldtally.streaming import live

ORDER = ["ts", "event_id"]
COLUMNS = ["ts", "event_id", "event_type"]


@pytest.fixture()
def landing(spark, folder, tmp_path):
    """Events in five files, a late one among them, kept back from the folder."""
    events = SurveyTables(spark, folder).raw("events")
    stock = tmp_path / "stock"
    for i in range(5):
        events.filter(f"event_id % 5 = {4 - i}").coalesce(1).write.parquet(str(stock / str(i)))
    target = tmp_path / "landing"
    target.mkdir()

    def arrive(i):
        for f in (stock / str(i)).glob("*.parquet"):
            shutil.copy(f, target / f"{i}.parquet")

    return events, target, arrive


def test_latest_record_over_arriving_files(spark, landing, tmp_path):
    events, folder, arrive = landing
    target, progress = str(tmp_path / "latest"), str(tmp_path / "progress")

    def run():
        stream = live.landing_stream(spark, str(folder), SCHEMAS["events"], files_per_batch=1)
        query = live.keep_latest(stream, target, progress, "user_id", ORDER, COLUMNS)
        query.awaitTermination()
        return live.read_latest(spark, target, "user_id", ORDER, COLUMNS)

    arrive(0), arrive(1)
    part = events.filter("event_id % 5 in (4, 3)")
    assert rows(run()) == rows(live.latest_per_key(part, ["user_id"], ORDER, COLUMNS))
    arrive(2), arrive(3), arrive(4)
    whole = rows(live.latest_per_key(events, ["user_id"], ORDER, COLUMNS))
    assert rows(run()) == whole
    assert len(list((tmp_path / "latest").glob("batch_id=*"))) == 5
    assert rows(run()) == whole


def batch_folders(target):
    return {p.name for p in target.iterdir()}


def test_compaction_goes_on_from_the_last_one(spark, tmp_path):
    target, order, columns = str(tmp_path / "latest"), ["t"], ["v"]
    batches = [[(1, 1, "a"), (2, 5, "b")], [(1, 2, "c")], [(2, 4, "late"), (3, 1, "new"), (1, 9, "d")], [(4, 1, "e")]]

    def store(i):
        live.publish(spark.createDataFrame(batches[i], "key int, t int, v string"), target, i)

    def present():
        return rows(live.read_latest(spark, target, "key", order, columns))

    store(0), store(1)
    assert live.compact_latest(spark, target, "key", order, columns) == 1
    assert present() == [(1, "c"), (2, "b")]
    store(2)
    # Covered batches stay until the next compaction, but they are not opened.
    files = live.changes(spark, target).inputFiles()
    assert not any("batch_id=0" in f or "batch_id=1" in f for f in files)
    assert present() == [(1, "d"), (2, "b"), (3, "new")]
    assert live.compact_latest(spark, target, "key", order, columns) == 2
    assert batch_folders(tmp_path / "latest") == {"batch_id=2", "upto=1", "upto=2"}
    store(3)
    assert all("upto=2" in f or "batch_id=3" in f for f in live.changes(spark, target).inputFiles())
    assert present() == [(1, "d"), (2, "b"), (3, "new"), (4, "e")]
    assert live.compact_latest(spark, target, "key", order, columns) == 3
    assert batch_folders(tmp_path / "latest") == {"batch_id=3", "upto=2", "upto=3"}
    # Nothing new: nothing to do.
    assert live.compact_latest(spark, target, "key", order, columns) == 3
    assert present() == [(1, "d"), (2, "b"), (3, "new"), (4, "e")]


def test_counts_are_compacted_too(spark, tmp_path):
    target = str(tmp_path / "counts")
    for i, batch in enumerate([[("a", 1), ("b", 2)], [("a", 4)], [("c", 1)]]):
        live.publish(spark.createDataFrame(batch, "status string, n long"), target, i)
        live.compact_status(spark, target, ["status"]) if i == 1 else None
    assert rows(live.read_status(spark, target, ["status"])) == [("a", 4), ("b", 2), ("c", 1)]
    live.publish(spark.createDataFrame([("a", 9)], "status string, n long"), target, 3)
    assert live.compact_status(spark, target, ["status"]) == 3
    assert rows(live.read_status(spark, target, ["status"])) == [("a", 9), ("b", 2), ("c", 1)]


def test_a_half_written_batch_is_not_read(spark, tmp_path):
    target = tmp_path / "latest"
    live.publish(spark.createDataFrame([(1, 1, "a")], "key int, t int, v string"), str(target), 0)
    spark.createDataFrame([(1, 9, "half")], "key int, t int, v string").write.parquet(str(target / "batch_id=1" / "x"))
    (target / "batch_id=1" / "x" / "_SUCCESS").unlink()
    assert rows(live.read_latest(spark, str(target), "key", ["t"], ["v"])) == [(1, "a")]
    live.publish(spark.createDataFrame([(1, 8, "whole")], "key int, t int, v string"), str(target), 1)
    assert rows(live.read_latest(spark, str(target), "key", ["t"], ["v"])) == [(1, "whole")]


def test_status_counts_over_arriving_files(spark, landing, tmp_path):
    events, folder, arrive = landing
    target, progress = str(tmp_path / "counts"), str(tmp_path / "progress")

    def run():
        stream = live.landing_stream(spark, str(folder), SCHEMAS["events"], "*.parquet", files_per_batch=2)
        live.count_status(stream, target, progress, ["event_type"]).awaitTermination()
        return rows(live.read_status(spark, target, ["event_type"]))

    for i in range(3):
        arrive(i)
    assert run() == rows(events.filter("event_id % 5 > 1").groupBy("event_type").count())
    arrive(3), arrive(4)
    assert run() == rows(events.groupBy("event_type").count())


def test_repeated_batch_counts_once(spark, tmp_path):
    """A batch that is run again adds nothing."""
    target = str(tmp_path / "latest")
    batch = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "key int, t int, v string")
    for _ in range(2):
        live.publish(live.latest_per_key(batch, ["key"], ["t"], ["t", "v"]), target, 0)
    assert rows(live.read_latest(spark, target, "key", ["t"], ["t", "v"])) == [(1, 2, "b")]
    assert live.changes(spark, target).count() == 1
