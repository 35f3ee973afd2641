"""Commits of a log: repeated and failed writes, and streams that follow them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import topicspark as ts
from topicspark.sources import committed, topics


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id INT, name STRING").repartition(3)


def places(log):
    held = {}
    for r in log.orderBy("partition", "offset").collect():
        held.setdefault(r["partition"], []).append(r["offset"])
    return held


def dense(log):
    return all(offsets == list(range(len(offsets))) for offsets in places(log).values())


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch, ids in (("q-0", range(20)), ("q-0", range(20)), ("q-1", range(20, 50)), ("q-0", range(20)), ("q-1", range(5))):
        ts.write_log(rows(spark, *ids), "id", "t.one", path, batch=batch)
    log = ts.read_topic(spark, path)
    assert sorted(int(r["key"]) for r in log.collect()) == list(range(50)) and dense(log)
    told = committed.commits(spark, path).groupBy().agg(F.sum("records")).first()[0]
    assert told == 50


def test_a_job_killed_midway_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    ts.write_log(rows(spark, *range(10)), "id", "t.one", path, batch="a")

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(topics, "write_commit", killed)
        with pytest.raises(RuntimeError):
            ts.write_log(rows(spark, *range(10, 30)), "id", "t.one", path, batch="b")
    assert ts.read_topic(spark, path).count() == 10
    stream = ts.read_topic(spark, path, streaming=True)
    assert ts.run_available_now(stream.select("key"), "append").count() == 10
    ts.write_log(rows(spark, *range(40, 47)), "id", "t.one", path, batch="c")  # another write meanwhile
    ts.write_log(rows(spark, *range(10, 30)), "id", "t.one", path, batch="b")
    log = ts.read_topic(spark, path)
    assert sorted(int(r["key"]) for r in log.collect()) == [*range(30), *range(40, 47)] and dense(log)


def test_other_writers_files_are_read_too(spark, make_log, tmp_path):
    path = str(tmp_path / "log")
    make_log([("t.one", p, i, i, f"k{p}{i}", "{}") for p in range(4) for i in range(3)]).write.partitionBy("topic").parquet(path)
    ts.write_log(rows(spark, *range(8)), "id", "t.one", path)
    log = ts.read_topic(spark, path, ["t.one"])
    assert log.count() == 20 and dense(log)


def test_latest_goes_on_from_its_checkpoint(spark, tmp_path):
    path, out, state = (str(tmp_path / name) for name in ("log", "out", "state"))
    ts.write_log(rows(spark, *range(10)), "id", "t.one", path)
    ts.write_log(rows(spark, *range(10)), "id", "t.two", path)

    def run():
        stream = ts.read_topic(spark, path, ["t.one"], mode="latest", streaming=True)
        ts.start_insert(stream.select("topic", "key", "timestamp"), out, state, once=True).awaitTermination()

    run()  # starts at the end
    for ids in ((10, 11), (12,)):  # come while it is down
        ts.write_log(rows(spark, *ids), "id", "t.one", path)
        ts.write_log(rows(spark, *ids), "id", "t.two", path)
    run()
    ts.write_log(rows(spark, 13), "id", "t.one", path)
    run()
    run()
    found = spark.read.parquet(out)
    assert sorted(int(r["key"]) for r in found.collect()) == [10, 11, 12, 13]
    assert {r["topic"] for r in found.collect()} == {"t.one"}
    log = ts.read_topic(spark, path, ["t.one"])
    want = {r["key"]: r["timestamp"] for r in log.collect()}
    assert all(want[r["key"]] == r["timestamp"] for r in found.collect())


def test_a_stream_into_a_log_and_out_again(spark, tmp_path):
    first, second, state = (str(tmp_path / name) for name in ("first", "second", "state"))
    ts.write_log(rows(spark, *range(10)), "id", "t.one", first)
    for ids in ((), (10, 11)):
        if ids:
            ts.write_log(rows(spark, *ids), "id", "t.one", first)
        stream = ts.read_topic(spark, first, streaming=True).select("key", "value")
        ts.start_log_insert(stream, "key", "t.copy", second, state, "copy", once=True).awaitTermination()
    log = ts.read_topic(spark, second)
    assert sorted(int(r["key"]) for r in log.collect()) == list(range(12)) and dense(log)


def test_names_that_are_no_folders(spark, tmp_path):
    with pytest.raises(ValueError):
        ts.write_log(rows(spark, 1), "id", "t/../x", str(tmp_path / "log"))


def test_an_empty_write(spark, tmp_path):
    path = str(tmp_path / "log")
    ts.write_log(rows(spark, 1).filter("id > 5"), "id", "t.one", path, batch="a")
    ts.write_log(rows(spark, 1), "id", "t.one", path, batch="b")
    assert ts.read_topic(spark, path).count() == 1
