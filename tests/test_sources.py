import json
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import topicspark as ts
from tests.conftest import START, rows_of


def test_plain_options():
    assert ts.kafka_options("host:1") == {"kafka.bootstrap.servers": "host:1"}


def test_ssl_options():
    options = ts.kafka_options("host:1", "ssl", truststore_path="/t.jks", truststore_password="p", key_password="k")
    assert options == {
        "kafka.bootstrap.servers": "host:1",
        "kafka.security.protocol": "SSL",
        "kafka.ssl.truststore.location": "/t.jks",
        "kafka.ssl.truststore.password": "p",
        "kafka.ssl.key.password": "k",
    }


def test_sasl_options():
    options = ts.kafka_options("host:1", "CONFLUENT_CLOUD", api_key="name", api_secret="word")
    assert options["kafka.security.protocol"] == "SASL_SSL"
    assert options["kafka.sasl.mechanism"] == "PLAIN"
    assert 'username="name"' in options["kafka.sasl.jaas.config"]
    assert 'password="word"' in options["kafka.sasl.jaas.config"]


@pytest.fixture()
def stored(make_log, tmp_path):
    rows = [("a", 0, i, i * 1000, f"k{i}", f"v{i}") for i in range(5)] + [("b.c", 0, 0, 9000, None, None)]
    path = str(tmp_path / "log")
    make_log(rows).write.partitionBy("topic").parquet(path)
    return path


def test_read_topic(spark, stored):
    assert ts.read_topic(spark, stored).count() == 6
    only = ts.read_topic(spark, stored, ["a"])
    assert only.columns == ts.LOG_COLUMNS and only.count() == 5
    assert re.search(r"PartitionFilters: \[.*topic#\d+ = a", only._jdf.queryExecution().toString())


def test_read_latest_starts_at_a_time(spark, stored):
    log = ts.read_topic(spark, stored, mode="latest", since=START + timedelta(seconds=3))
    assert {row["key"] for row in log.collect()} == {"k3", "k4", None}
    assert ts.read_topic(spark, stored, mode="unknown").count() == 6
    with pytest.raises(ValueError):
        ts.read_topic(spark, stored, mode="latest")


def test_read_stream(spark, stored):
    stream = ts.read_topic(spark, stored, ["a"], streaming=True)
    assert stream.isStreaming
    assert ts.run_available_now(stream.select("key"), "append").count() == 5
    since = START + timedelta(days=1)
    latest = ts.read_topic(spark, stored, mode="latest", streaming=True, since=since)
    assert ts.run_available_now(latest.select("key"), "append").count() == 0
    with pytest.raises(ValueError):  # the clock at a restart would pass over what came while the query was down
        ts.read_topic(spark, stored, mode="latest", streaming=True)


def test_write_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id INT, name STRING")
    ts.write_log(rows, "id", "t.one", path)
    ts.write_log(rows, F.concat(F.lit("k"), F.col("id")), "t.one", path)
    ts.write_log(rows, "id", "t.two", path)
    log = ts.read_topic(spark, path, ["t.one"])
    assert sorted(row["key"] for row in log.collect()) == ["1", "2", "k1", "k2"]
    places = {}
    for row in log.orderBy("partition", "offset").collect():
        places.setdefault(row["partition"], []).append((row["offset"], row["key"].startswith("k")))
    for held in places.values():
        assert [offset for offset, _ in held] == list(range(len(held)))  # without gaps
        assert [later for _, later in held] == sorted(later for _, later in held)
    assert ts.topic_stats(log).first()["messages"] == 4
    assert json.loads(log.filter("key = 'k2'").first()["value"]) == {"id": 2, "name": "y"}


def test_export(spark, tmp_path):
    frame = spark.createDataFrame([(1, ["a"], {"k": 2})], "id INT, tags ARRAY<STRING>, m MAP<STRING,INT>")
    ts.export(frame, str(tmp_path / "csv"))
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert row["id"] == "1" and "a" in row["tags"]
    ts.export(frame, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).first()["m"]["k"] == 2
    with pytest.raises(ValueError):
        ts.export(frame, str(tmp_path / "x"), "xlsx")


def test_tail_is_the_true_last_n(make_log):
    rows = [("t", 0, i, i, None, str(i)) for i in range(30)] + [("t", 1, i, 1000 - i, None, None) for i in range(3)]
    log = make_log(rows)
    last = ts.tail_records(log, 5)
    assert sorted((r["partition"], r["offset"]) for r in last.collect()) == [(0, 28), (0, 29), (1, 0), (1, 1), (1, 2)]
    assert sorted(r["value"] for r in ts.sample_messages(log, 5).collect()) == ["28", "29"]


@pytest.mark.parametrize("n", [100, 20_000])  # with and without Spark's own limit on ranks
def test_tail_of_a_topic_spread_over_salts(spark, n):
    offsets = spark.range(0, 3_000_000, 1, 8).select(
        F.lit("hot").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"),
        F.timestamp_millis(F.pmod(F.xxhash64("id"), F.lit(10_000_000_000))).alias("timestamp"),
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"),
    )
    want = offsets.orderBy(F.desc("timestamp"), F.desc("offset")).limit(n).select("offset")
    assert rows_of(ts.tail_records(offsets, n).select("offset")) == rows_of(want)


def test_records_since_filters_every_record(make_log):
    as_of = START + timedelta(minutes=60)
    log = make_log([("t", 0, i, minute * 60_000, None, None) for i, minute in enumerate([10, 50, 20, 40, 55])])
    kept = ts.records_since(log, 20, 2, as_of).collect()
    assert sorted(r["offset"] for r in kept) == [1, 3]
    assert ts.records_since(log, 20, None, as_of).count() == 3


def test_many_first_records(make_log):
    log = make_log([("t", i % 2, i, (i * 37) % 3000 * 60_000, None, "v") for i in range(3000)])
    as_of = START + timedelta(minutes=3000)
    kept = ts.records_since(log, 2500, 1500, as_of)
    assert sorted((i * 37) % 3000 for i in (r["offset"] for r in kept.collect())) == list(range(500, 2000))
    assert sorted(r["offset"] for r in ts.head_sample(log, 1200).collect()) == list(range(0, 2400, 2))


def test_head_sample_reads_partition_zero(make_log):
    log = make_log([("t", 1, 0, 0, None, "no"), ("t", 0, 0, 5, None, None), ("t", 0, 1, 1, None, "b"), ("t", 0, 2, 0, None, "c")])
    assert [r["value"] for r in ts.head_sample(log, 1).collect()] == ["b"]


def test_catalog(make_log):
    log = make_log([("a", 0, 10, 0, None, None), ("a", 0, 14, 0, None, None), ("a", 1, 0, 0, None, None), ("b", 0, 0, 0, None, None)])
    assert rows_of(ts.topic_stats(log)) == [("a", 6), ("b", 1)]
    assert rows_of(ts.topic_stats(log, ["a", "gone"])) == [("a", 6), ("gone", 0)]
    row = ts.topic_descriptor(log).filter("topic = 'a'").first()
    assert (row["partitions"], row["min_offsets"], row["max_offsets"]) == (2, {0: 10, 1: 0}, {0: 15, 1: 1})
    assert (row["format"], row["estimated_size"]) == ("AUTO", 6)
    text = ts.tail_offsets(log, 3).first()[0]
    assert json.loads(text) == {"a": {"0": 12, "1": 0}, "b": {"0": 0}}


def test_filters(spark):
    stats = spark.createDataFrame(
        [("order.a", 5), ("order.b.DLT", 2), ("other.Order", 0)], "topic STRING, messages BIGINT"
    )
    names = lambda **kwargs: sorted(r["topic"] for r in ts.filter_topics(stats, **kwargs).collect())
    assert names(prefix="order.") == ["order.a", "order.b.DLT"]
    assert names(name="order.a") == ["order.a"]
    assert names(contains="ORDER") == ["order.a", "order.b.DLT", "other.Order"]
    assert names(hide_dlt=True) == ["order.a", "other.Order"]
    assert names(non_empty=True) == ["order.a", "order.b.DLT"]
    row = ts.dashboard(spark.createDataFrame([], ts.LOG_SCHEMA), stats).first()
    assert tuple(row) == (3, 7, 1, 1, 1)


def test_preview_and_sql(spark, values_log):
    log = values_log("c", "b", "a")
    assert [r["value"] for r in ts.preview(log, 2).collect()] == ["c", "b"]
    assert ts.run_sql(spark, "SELECT * FROM {log}", 2, log=log).count() == 2
    assert ts.run_sql(spark, "SELECT * FROM {log}", None, log=log).count() == 3
    text = "SELECT count(*) AS n FROM {topic} WHERE value > :least"
    assert ts.run_template(spark, text, log, {"least": "a"}).first()["n"] == 2


def test_time_zone_of_as_of(make_log):
    log = make_log([("t", 0, 0, 0, None, None)])
    zone = timezone(timedelta(hours=5))
    assert ts.records_since(log, 1, None, datetime(2024, 1, 1, 5, 0, 30, tzinfo=zone)).count() == 1
