"""Results that samples, caps and prefixes would get wrong."""

import pytest

import topicspark as ts
from tests.conftest import rows_of


def test_a_trace_takes_n_as_given(make_log):
    log = make_log([("t", 0, i, i, None, "hit") for i in range(1400)])
    assert ts.trace_hits(log, "hit", n=1400).count() == 1400


def test_results_are_not_cut(spark):
    frame = spark.range(200).selectExpr("id AS metric_value", "concat('s', id) AS series")
    assert ts.run_sql(spark, "SELECT * FROM {f}", f=frame).count() == 200
    rows = ts.eval_metric(spark, "SELECT * FROM {f}", f=frame).orderBy("seq").collect()
    assert len(rows) == 200
    assert [r["metric_value"] for r in rows[:3]] == [0.0, 1.0, 10.0]  # by value and label as text


def test_equal_ids_outside_the_first_partition(make_log):
    log = make_log([("t", 1, i, i, None, '{"id": 5}') for i in range(5)])
    row = ts.topic_audit(log).first()
    assert (row["format"], row["duplicate_count"], row["health"]) == ("JSON", 1, "UNHEALTHY")


def test_late_types_and_columns(make_log):
    values = ['{"x": %d}' % i for i in range(10)] + ['{"x": 1.5, "y": "z"}']
    log = make_log([("t", 0, i, i, None, value) for i, value in enumerate(values)])
    view = ts.topic_table(log, ts.schema_struct(ts.infer_schema(log), "t"))
    assert (1.5, "z") in rows_of(view.select("x", "y"))


def test_keys_that_do_not_fit_their_column(make_log):
    values = ['{"id": %d}' % i for i in range(10)] + ['{"id": "ORD-%d"}' % i for i in range(5)]
    row = ts.topic_audit(make_log([("t", 0, i, i, None, value) for i, value in enumerate(values)])).first()
    assert (row["duplicate_count"], row["health"]) == (0, "HEALTHY")


def test_truncated_values_are_poison(make_log):
    row = ts.topic_audit(make_log([("t", 0, i, i, None, '{"id": %d, "na' % i) for i in range(20)])).first()
    assert (row["poison_count"], row["health"]) == (20, "UNHEALTHY")


def test_any_field_name_is_a_key(make_log):
    log = make_log([("t", 0, i, i, None, '{"buyer\'s id": %d}' % i) for i in range(4)])
    assert rows_of(ts.duplicate_keys(log, {"t": "buyer's id"})) == [("t", 0)]


def test_offsets_beat_clocks(make_log):
    log = make_log([("t", 0, 1, 1000, "k", "old"), ("t", 0, 2, 10, "k", "new")])
    assert ts.latest_by_key(log).first()["value"] == "new"


def test_only_queries_run(spark):
    spark.range(3).createOrReplaceTempView("kept_view")
    for text in ("DROP VIEW kept_view", "INSERT INTO kept_view VALUES (1)", "CREATE TEMP VIEW v AS SELECT 1"):
        with pytest.raises(ValueError):
            ts.run_sql(spark, text)
    assert ts.run_sql(spark, "WITH a AS (SELECT * FROM kept_view) SELECT * FROM a").count() == 3


def test_unknown_security_is_refused():
    with pytest.raises(ValueError):
        ts.kafka_options("broker:9092", "SASL_SSL")


def test_skipped_and_kept_empty_steps(spark, make_log):
    log = make_log([("a.b.1", 0, 0, 0, "k", '{"id": 1}'), ("a.b.2", 0, 0, 5, "k", '{"id": 1}')])
    catalog = spark.createDataFrame([("a.b.1", 1), ("a.b.2", 1), ("a.b.3", 0)], "topic STRING, messages BIGINT")
    steps = ts.flow_audit(log, catalog=catalog).select("topic", "message_count", "drop_off")
    assert rows_of(steps) == [("a.b.1", 1, None), ("a.b.2", 1, 0), ("a.b.3", 0, 1)]
    assert ts.flow_audit(log, catalog=catalog, skip_empty=True).count() == 2


def test_no_value_is_sorted_for_the_newest_records(make_log):
    log = make_log([("t", i % 3, i, i, None, f"v{i}") for i in range(200)] + [("u", 0, 0, 5, None, None)])
    newest = ts.tail_records(log, 4)
    assert sorted((r["topic"], r["offset"]) for r in newest.collect()) == [("t", i) for i in range(196, 200)] + [("u", 0)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan
