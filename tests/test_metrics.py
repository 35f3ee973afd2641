import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import topicspark as ts
from tests.conftest import START, rows_of

TOPIC = "internal.metrics.config"


def config(id_, **fields):
    return json.dumps({"id": id_, "name": id_, "type": "GAUGE", "sql": "SELECT 1 AS metric_value", **fields})


def registry(make_log, *records):
    rows = [(TOPIC, 0, i, i, key, value) for i, (key, value) in enumerate(records)]
    return {r["id"]: r for r in ts.metric_registry(make_log(rows)).collect()}


def test_presets_of_an_empty_registry(make_log):
    assert sorted(registry(make_log)) == ["business_events_by_type", "business_events_total"]
    deleted = ("m", config("m", errorMessage="DELETED"))
    assert len(registry(make_log, ("m", config("m")), deleted)) == 2


def test_save_and_delete(make_log):
    saved = [("m", config("m")), ("k", config("k"))]
    assert sorted(registry(make_log, *saved)) == ["k", "m"]
    assert sorted(registry(make_log, *saved, ("m", config("m", errorMessage="DELETED")))) == ["k"]


def test_update_by_id(make_log):
    found = registry(make_log, ("m", config("m")), ("m", config("m", name="new", warningThreshold=3, history=[1, 2.5])))
    assert (found["m"]["name"], found["m"]["warningThreshold"], found["m"]["history"]) == ("new", 3.0, [1.0, 2.5])


def test_latest_by_key_with_tombstone(make_log):
    log = make_log([("t", 0, 0, 0, "a", "1"), ("t", 0, 1, 0, "a", "2"), ("t", 0, 2, 0, "b", "1"), ("u", 0, 0, 0, "a", "9")])
    assert rows_of(ts.latest_by_key(log).select("topic", "key", "value")) == [("t", "a", "2"), ("t", "b", "1"), ("u", "a", "9")]
    assert rows_of(ts.latest_by_key(log, F.col("value") == "2").select("topic", "key")) == [("t", "b"), ("u", "a")]


def test_evaluation(spark):
    frame = spark.createDataFrame([("B", 2, None), ("A", 3, "x")], "k STRING, n INT, e STRING")
    rows = ts.eval_metric(spark, "SELECT n AS METRIC_VALUE, k AS Kind, e AS Extra FROM {t} ORDER BY n", t=frame)
    assert [(r["metric_value"], r["labels"], r["seq"]) for r in rows.orderBy("seq").collect()] == [
        (2.0, {"kind": "B", "extra": "null"}, 0),
        (3.0, {"kind": "A", "extra": "x"}, 1),
    ]
    assert ts.eval_metric(spark, "SELECT k AS metric_value FROM {t}", t=frame).count() == 0
    assert ts.eval_metric(spark, "SELECT CAST(NULL AS INT) AS metric_value FROM {t}", t=frame).count() == 0
    assert ts.eval_metric(spark, "SELECT n AS metric_value FROM {t}", 1, t=frame).count() == 1
    ratio = "SELECT COUNT(*) * 100.0 / (SELECT COUNT(*) FROM {t}) AS metric_value FROM {t} WHERE k = 'A'"
    assert ts.eval_metric(spark, ratio, t=frame).first()["metric_value"] == 50.0


@pytest.fixture(scope="module")
def refreshed(spark):
    metrics = [
        ("ok", "SELECT n AS metric_value, k FROM {t} ORDER BY n"),
        ("text", "SELECT k AS metric_value FROM {t}"),
        ("empty", "SELECT n AS metric_value FROM {t} WHERE false"),
        ("broken", "SELECT nothing FROM {t}"),
        ("fails", "SELECT n / 0 AS metric_value FROM {t}"),
    ]
    frame = spark.createDataFrame([("B", 2), ("A", 3)], "k STRING, n INT")
    registry = spark.createDataFrame(metrics, "id STRING, sql STRING")
    return ts.refresh_metrics(spark, registry, {"t": frame}, START)


def test_refresh(refreshed):
    rows = {(r["id"], r["seq"]): r for r in refreshed.collect()}
    assert (rows["ok", 0]["metric_value"], rows["ok", 1]["labels"]) == (2.0, {"k": "A"})
    assert rows["empty", 0]["error"] == "No rows returned"
    assert rows["broken", 0]["error"] and rows["fails", 0]["error"]
    assert ("text", 0) not in rows


def test_state_after_refresh(spark, refreshed):
    ids = ["ok", "text", "empty", "broken"]
    before = spark.createDataFrame(
        [(i, 9.0, 1, "old") for i in ids], "id STRING, lastValue DOUBLE, lastUpdateTime BIGINT, errorMessage STRING"
    )
    after = {r["id"]: r for r in ts.metric_state(before, refreshed).collect()}
    now = round(START.timestamp() * 1000)
    assert tuple(after["ok"])[1:] == (2.0, now, None)
    assert tuple(after["text"])[1:] == (9.0, 1, "old")
    assert tuple(after["empty"])[1:] == (9.0, now, "No rows returned")
    assert after["broken"]["lastValue"] == 9.0 and after["broken"]["errorMessage"] != "old"


def test_history_keeps_the_last_fifty(spark):
    values = spark.createDataFrame(
        [("m", START + timedelta(seconds=i), float(i)) for i in range(60)] + [("k", START, 5.0)],
        "id STRING, refreshed_at TIMESTAMP, metric_value DOUBLE",
    )
    history = {r["id"]: r["history"] for r in ts.metric_history(values).collect()}
    assert history == {"m": [float(i) for i in range(10, 60)], "k": [5.0]}


def test_a_refresh_extends_the_history(spark):
    config = spark.createDataFrame(
        [("new", None, None, None, None), ("full", 1.0, 1, None, [float(i) for i in range(50)]), ("failed", 3.0, 1, None, [3.0])],
        "id STRING, lastValue DOUBLE, lastUpdateTime BIGINT, errorMessage STRING, history ARRAY<DOUBLE>",
    )
    values = spark.createDataFrame(
        [("new", 0, 4.0, None, START), ("full", 0, 50.0, None, START), ("full", 1, 99.0, None, START), ("failed", 0, None, "no", START)],
        "id STRING, seq BIGINT, metric_value DOUBLE, error STRING, refreshed_at TIMESTAMP",
    )
    after = {r["id"]: r["history"] for r in ts.metric_state(config, values).collect()}
    assert after == {"new": [4.0], "full": [float(i) for i in range(1, 51)], "failed": [3.0]}


def test_window_texts():
    from topicspark.plans.sql import with_windows

    plain = "SELECT * FROM {events} WHERE x = 'TABLE(x)'"
    assert with_windows(plain) == plain
    text = with_windows("SELECT 1 FROM table(hop(data => TABLE `my`.t, timecol => DESCRIPTOR(ts), slide => INTERVAL '5' MINUTES, size => INTERVAL '1' HOUR)) w")
    assert "window(ts, '1 HOUR', '5 MINUTES')" in text and "FROM `my`.t" in text and text.endswith(" w")
    with pytest.raises(ValueError):
        with_windows("SELECT 1 FROM TABLE(HOP(TABLE t, DESCRIPTOR(ts), INTERVAL '5' MINUTES))")
    with pytest.raises(ValueError):
        with_windows("SELECT 1 FROM TABLE(TUMBLE(TABLE t, DESCRIPTOR(ts), INTERVAL '5' MINUTES, INTERVAL '1' HOUR))")
