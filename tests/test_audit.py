import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import topicspark as ts
from tests.conftest import rows_of
from topicspark.operators import profile, shared

HOUR = 3_600_000


@pytest.fixture(scope="module")
def demo(make_log):
    """Two steps of a flow: 100 orders, 80 of them half a second later in the next topic."""
    rows = [("demo.test.1", 0, i, i * 10_000, None, f'{{"id": "o{i}"}}') for i in range(100)]
    rows += [("demo.test.2", 0, i, i * 10_000 + 500, None, f'{{"id": "o{i}"}}') for i in range(80)]
    return make_log(rows)


def test_audit_of_a_flow(demo):
    audit = ts.topic_audit(demo)
    assert [(r["topic"], r["message_count"], r["health"], r["issues"]) for r in audit.orderBy("topic").collect()] == [
        ("demo.test.1", 100, "HEALTHY", []),
        ("demo.test.2", 80, "HEALTHY", []),
    ]
    steps = ts.flow_audit(demo).orderBy("ordinal").collect()
    assert [(s["flow"], s["topic"], s["throughput_pct"], s["drop_off"], s["avg_latency_ms"], s["health_score"]) for s in steps] == [
        ("demo.test", "demo.test.1", 100.0, None, None, 80.0),
        ("demo.test", "demo.test.2", 80.0, 20, 500, 80.0),
    ]
    report = ts.audit_report(audit, ts.flow_audit(demo, audit=audit), "run-1").first()
    assert (report["total_topics"], report["total_messages"], report["unhealthy_topics"]) == (2, 180, 0)
    assert [t["name"] for t in report["topic_audits"]] == ["demo.test.1", "demo.test.2"]
    assert [s["avg_latency_ms"] for s in report["flow_steps"]] == [None, 500]
    assert "timestamp" in report["stats"]


def test_report_goes_to_the_history_log(spark, demo, tmp_path):
    audit = ts.topic_audit(demo)
    report = ts.audit_report(audit, ts.flow_audit(demo, audit=audit), "run-1")
    path = str(tmp_path / "log")
    ts.write_log(report, "audit_id", "internal.audit.history", path)
    ts.write_log(report.withColumn("unhealthy_topics", F.lit(7)), "audit_id", "internal.audit.history", path)
    ts.write_log(report.withColumn("audit_id", F.lit("run-2")), "audit_id", "internal.audit.history", path)
    history = ts.audit_history(ts.read_topic(spark, path))
    assert rows_of(history.select("audit_id", "total_messages", "unhealthy_topics")) == [("run-1", 180, 7), ("run-2", 180, 0)]


def test_issues(spark, make_log):
    rows = [("bad", 0, i, i, None, v) for i, v in enumerate(['{"id": 1}', '{"id": 1.0}', '{"id": "1"}', "text", None])]
    catalog = spark.createDataFrame([("bad", 5), ("lost", 3), ("empty", 0)], "topic STRING, messages BIGINT")
    audit = {r["topic"]: r for r in ts.topic_audit(make_log(rows), catalog=catalog).collect()}
    assert audit["bad"]["poison_count"] == 1
    assert audit["bad"]["issues"][0] == "Detected 1 malformed messages in sample."
    assert audit["bad"]["health"] == audit["lost"]["health"] == "UNHEALTHY"
    assert audit["lost"]["issues"] == ["The broker reports messages, but none was read."]
    assert (audit["empty"]["health"], audit["empty"]["format"], audit["empty"]["message_count"]) == ("HEALTHY", "AUTO", 0)


def test_duplicates_count_repeated_values_and_null_as_one(make_log):
    values = ['{"id": 1}', '{"id": 1}', '{"id": 1}', '{"id": 2}', "{}", "broken"]
    log = make_log([("t", 0, i, i, None, v) for i, v in enumerate(values)] + [("u", 0, 0, 0, None, "x"), ("u", 0, 1, 0, None, "x")])
    assert rows_of(ts.duplicate_keys(log, {"t": "id"})) == [("t", 2), ("u", 0)]


def test_more_key_names_than_get_a_path_of_their_own(make_log):
    rows = [(f"t{t}", 0, i, i, None, '{"k%d": %d}' % (t, i % 2)) for t in range(20) for i in range(4)]
    counts = ts.duplicate_keys(make_log(rows), {f"t{t}": f"k{t}" for t in range(20)})
    assert rows_of(counts) == sorted((f"t{t}", 2) for t in range(20))


def test_equal_keys_under_the_column_type(spark, make_log):
    log = make_log([("t", 0, 0, 0, None, '{"id": 1}'), ("t", 0, 1, 0, None, '{"id": "1"}'), ("t", 0, 2, 0, None, '{"id": 2}')])
    keys = spark.createDataFrame([("t", "id", "BIGINT")], "topic STRING, key_field STRING, key_type STRING")
    assert rows_of(ts.duplicate_keys(log, keys)) == [("t", 1)]


def test_key_field_falls_back_to_the_first_column(make_log):
    log = make_log([("t", 0, i, i, None, '{"state": "x", "n": %d}' % i) for i in range(3)])
    assert ts.topic_audit(log).first()["duplicate_count"] == 1
    assert ts.topic_audit(log, strict=True).first()["duplicate_count"] == 0


@pytest.mark.parametrize(
    "mode, json_bad, xml_bad", [("prefix", 1, 1), ("parse", 2, 3)]
)
def test_poison(spark, make_log, mode, json_bad, xml_bad):
    rows = [("j", 0, i, i, None, v) for i, v in enumerate(["{}", "[]", "text", '{"id": "ERR-01"'])]
    rows += [("x", 0, i, i, None, v) for i, v in enumerate(["<a/>", "text", "<a>", "<!DOCTYPE a><a/>"])]
    rows += [("auto", 0, 0, 0, None, "anything")]
    formats = spark.createDataFrame([("j", "JSON"), ("x", "XML"), ("auto", "AUTO")], "topic STRING, format STRING")
    for n in (10, None):
        counts = dict(rows_of(ts.poison_counts(make_log(rows), formats, mode, n)))
        assert counts == {"j": json_bad, "x": xml_bad, "auto": 0}


def test_flow_names(spark):
    counts = [("plain", 5), ("one.flow", 1), ("a.b", 0), ("a.b.c", 4), ("a.b.d.e", 2), ("x.y.1", 10), ("x.y.2", 5)]
    audit = spark.createDataFrame(counts, "topic STRING, message_count BIGINT")
    steps = ts.flow_steps(audit).orderBy("flow", "ordinal").collect()
    assert [(s["flow"], s["ordinal"], s["topic"], s["throughput_pct"], s["health_score"]) for s in steps] == [
        ("a.b", 1, "a.b", 100.0, 100.0),
        ("a.b", 2, "a.b.c", 100.0, 100.0),
        ("a.b", 3, "a.b.d.e", 100.0, 100.0),
        ("x.y", 1, "x.y.1", 100.0, 50.0),
        ("x.y", 2, "x.y.2", 50.0, 50.0),
    ]
    skipped = ts.flow_steps(audit, skip_empty=True).filter("flow = 'a.b'").orderBy("ordinal").collect()
    assert [(s["topic"], s["throughput_pct"]) for s in skipped] == [("a.b.c", 100.0), ("a.b.d.e", 50.0)]


@pytest.mark.parametrize("seed", range(3))
def test_latency_equals_the_mean_over_all_pairs(make_log, seed):
    rng = random.Random(seed)
    rows = []
    for step in (1, 2, 3):
        for i in range(400):
            # Few keys, one of them hot; times that collide, and spread over many buckets.
            key = rng.choice(["hot", "hot", "hot", "a", "b", None, f"rare{i}"])
            at = rng.choice([rng.randrange(20), rng.randrange(50) * HOUR, rng.randrange(30 * HOUR)])
            rows.append((f"f.g.{step}", 0, i, at, key, None))
    times = defaultdict(list)
    for topic, _, _, at, key, _ in rows:
        if key is not None:
            times[topic, key].append(at)
    wanted = {}
    for step in (2, 3):
        gaps = [
            b - a
            for (topic, key), later in times.items() if topic == f"f.g.{step}"
            for b in later
            for a in times.get((f"f.g.{step - 1}", key), []) if b > a
        ]
        wanted[f"f.g.{step}"] = sum(gaps) // len(gaps)
    log = make_log(rows)
    got = ts.step_latency(log, ts.flow_steps(ts.exact_counts(log)), key="key").collect()
    assert {r["topic"]: r["avg_latency_ms"] for r in got} == {"f.g.1": None, **wanted}


def _plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_latency_sorts_no_more_rows_in_a_task_on_larger_logs(spark, make_log, monkeypatch, capsys):
    rows = [(t, 0, i, at + i, str(i % 50), "{}") for t, at in (("s.f.1", 0), ("s.f.2", 7)) for i in range(100)]
    log = make_log(rows)
    steps = ts.flow_steps(ts.exact_counts(log))
    plain = sorted(ts.step_latency(log, steps, key="key").collect())
    monkeypatch.setattr(shared, "TASK_ROWS", 40)
    found = ts.step_latency(log, steps, key="key")
    # 200 moments, each of them of two steps: 10 tasks, whatever re-planning thinks of their bytes.
    assert len(re.findall(r"hashpartitioning\(.*, 10\), REPARTITION_BY_NUM", _plan(found, capsys))) == 2
    assert sorted(found.collect()) == plain and plain[1]["avg_latency_ms"] is not None


def test_a_topics_key_texts_stay_where_they_are(make_log, monkeypatch, capsys):
    log = make_log([("p", 0, i, i, None, f'{{"id": {i % 7}, "v": 1}}') for i in range(30)])
    partial = ts.scan_values(log)
    keys = shared.checkpointed(log.select("topic", F.lit("id").alias("key_field"), F.lit("BIGINT").alias("key_type")).distinct())
    told, _ = profile.candidate_tallies(partial, keys)
    plan = _plan(told, capsys)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    # Beyond that many topics the rows are dealt by the texts too.
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    spread, _ = profile.candidate_tallies(partial, keys)
    assert sorted(spread.collect()) == sorted(told.collect()) and told.count() == 7


def test_flows_and_audit_from_one_scan(make_log):
    rows = [(f"s.f.{t}", 0, i, 10 * i + t, None, f'{{"id": {i % 9}, "v": 1}}') for t in (1, 2, 3) for i in range(40)]
    log = make_log(rows)
    parts = ts.scan_values(log, moments=True)
    unread = log.withColumn("value", F.raise_error(F.lit("the values are read")).cast("string"))
    audit = ts.topic_audit(unread, parts=parts)
    assert sorted(audit.collect()) == sorted(ts.topic_audit(log).collect())
    assert sorted(ts.flow_audit(unread, audit=audit, parts=parts).collect()) == sorted(ts.flow_audit(log).collect())


def test_latency_of_one_key_with_very_many_pairs(spark):
    n = 200_000
    ids = spark.range(n).select(F.col("id").alias("offset"))
    side = lambda topic, shift: ids.select(
        F.lit(topic).alias("topic"), F.lit(0).alias("partition"), "offset",
        F.timestamp_millis(F.lit(1704067200000) + F.col("offset") * 1000 + shift).alias("timestamp"),
        F.lit("hot").alias("key"), F.lit(None).cast("string").alias("value"),
    )
    log = side("f.g.1", 0).union(side("f.g.2", 500))
    got = ts.step_latency(log, ts.flow_steps(ts.exact_counts(log)), key="key").filter("ordinal = 2").first()
    # Pairs (i, j) with j >= i: the difference is (j - i) * 1000 + 500.
    pairs = n * (n + 1) // 2
    total = sum((n - d) * (d * 1000 + 500) for d in range(n))
    assert got["avg_latency_ms"] == total // pairs


def test_latency_without_matches_is_null(make_log):
    log = make_log([("f.g.1", 0, 0, 10, "a", None), ("f.g.2", 0, 0, 10, "a", None), ("f.g.2", 0, 1, 99, "b", None)])
    got = ts.step_latency(log, ts.flow_steps(ts.exact_counts(log)), key="key").collect()
    assert [r["avg_latency_ms"] for r in got] == [None, None]


def test_many_topics_join_without_broadcast(spark, make_log, monkeypatch):
    from topicspark.operators import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 1)
    log = make_log([(f"t{t}", 0, i, i, None, '{"id": %d}' % (i % 3)) for t in range(5) for i in range(9)])
    audit = ts.topic_audit(log).collect()
    assert Counter((r["message_count"], r["duplicate_count"]) for r in audit) == {(9, 3): 5}
