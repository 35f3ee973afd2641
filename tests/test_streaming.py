import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import topicspark as ts
from tests.conftest import START, rows_of
from topicspark.streaming.duplicates import first_only
from topicspark.streaming.runs import start_refresh

MINUTE = 60_000


@pytest.fixture()
def feed(spark, make_log, tmp_path):
    """A growing Parquet log: ``add`` appends records, ``stream`` reads them."""

    class Feed:
        path = str(tmp_path / "log")
        offset = 0

        def add(self, *records):
            rows = []
            for topic, at, key in records:
                rows.append((topic, 0, Feed.offset, at, key, None))
                Feed.offset += 1
            make_log(rows).write.mode("append").partitionBy("topic").parquet(self.path)

        def stream(self, topics=None):
            return ts.read_topic(spark, self.path, topics, streaming=True).withColumnRenamed("timestamp", "event_time")

        def batch(self):
            return ts.read_topic(spark, self.path).withColumnRenamed("timestamp", "event_time")

    return Feed()


def test_windows_give_the_batch_rows(feed):
    feed.add(*[("t", i * 7 * MINUTE, f"k{i % 3}") for i in range(40)])
    cases = [
        lambda df: ts.tumble(df, "1 hour", by=["key"]),
        lambda df: ts.hop(df, "30 minutes", "10 minutes", aggs=[F.max("offset").alias("last")]),
        lambda df: ts.session(df, "20 minutes", by=["key"]),
    ]
    for window in cases:
        wanted = rows_of(window(feed.batch()))
        assert wanted and rows_of(ts.run_available_now(window(feed.stream()))) == wanted


def test_sessions_against_spark_own(feed):
    rng = random.Random(1)
    rows = [("t", rng.choice([rng.randrange(500), 20 * MINUTE * rng.randrange(200), rng.randrange(900 * MINUTE)]), k)
            for k in ("a", "b", None) for _ in range(150)]
    feed.add(*rows)
    df = feed.batch()
    aggs = [F.count("*").alias("n"), F.max("offset").alias("last"), F.avg("offset").alias("mean")]
    for by in (["key"], []):
        window = F.session_window("event_time", "20 minutes").alias("w")
        own = df.groupBy(window, *by).agg(*aggs)
        wanted = rows_of(own.select(F.col("w.start"), F.col("w.end"), *by, "n", "last", "mean"))
        assert rows_of(ts.session(df, "20 minutes", by=by, aggs=aggs)) == wanted
        assert rows_of(ts.session(df, "20 minutes", by=by)) == [row[: 3 + len(by)] for row in wanted]


def test_late_records_do_not_reopen_a_closed_window(feed, tmp_path):
    def run():
        windows = ts.tumble(feed.stream(), "1 minute")
        ts.start_insert(windows, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
        out = feed.batch().sparkSession.read.parquet(str(tmp_path / "out"))
        return rows_of(out.select(F.unix_millis("window_start") - round(START.timestamp() * 1000), "messages"))

    feed.add(("t", 10, "a"), ("t", 20, "b"), ("t", 10 * MINUTE, "c"))
    assert run() == [(0, 2)]
    feed.add(("t", 30, "late"), ("t", 20 * MINUTE, "d"))
    assert run() == [(0, 2), (10 * MINUTE, 1)]


def test_duplicates(feed):
    feed.add(("t", 0, "a"), ("t", 1, "b"), ("t", 2, "a"))
    assert rows_of(ts.run_available_now(ts.duplicates_stream(feed.stream(), ["key"]))) == [("a", 2)]
    firsts = ts.run_available_now(first_only(feed.stream(), ["key"]).select("key"), "append")
    assert rows_of(firsts) == [("a",), ("b",)] == rows_of(first_only(feed.batch(), ["key"]).select("key"))


def test_latency_join_gives_the_batch_rows(feed):
    feed.add(*[("a", i * MINUTE, f"k{i % 4}") for i in range(12)], ("a", 0, None))
    feed.add(*[("b", i * MINUTE + 30_000, f"k{i % 4}") for i in range(12)], ("b", 5, None))
    stream = ts.step_latency_stream(feed.stream(["a"]), feed.stream(["b"]), "key", "5 minutes")
    batch = feed.batch()
    wanted = ts.step_latency_stream(batch.filter("topic = 'a'"), batch.filter("topic = 'b'"), "key", "5 minutes")
    got = rows_of(ts.run_available_now(stream, "append"))
    assert got == rows_of(wanted)
    assert {row[3] for row in got} == {30_000, 4 * MINUTE + 30_000}


def test_refresh_on_a_stream(spark, feed, tmp_path):
    feed.add(("t", 0, "a"), ("t", 1, "b"))
    out = str(tmp_path / "values")

    def refresh(batch, batch_id):
        session = batch.sparkSession  # a stream's batches live in a session of their own
        registry = session.createDataFrame([("n", "SELECT COUNT(*) AS metric_value FROM {t}")], "id STRING, sql STRING")
        as_of = START + timedelta(seconds=batch_id)
        values = ts.refresh_metrics(session, registry, {"t": batch}, as_of)
        values.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = start_refresh(feed.stream(), refresh, str(tmp_path / "state"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert [r["metric_value"] for r in spark.read.parquet(out).collect()] == [2.0]


def test_nothing_to_read(feed):
    feed.add(("t", 0, "a"))
    none = feed.stream(["other"]).select("key")
    assert ts.run_available_now(none, "append").count() == 0


@pytest.mark.parametrize("stretch", [1, 3, 1 << 14])
def test_sessions_without_keys(spark, monkeypatch, stretch):
    from topicspark.streaming import windows

    monkeypatch.setattr(windows, "STRETCH", stretch)
    draw = random.Random(stretch)
    for gaps in ([1], [61], [1, 30, 59, 60, 61, 200], [60], [59, 5000]):
        at, rows = 0, []
        for _ in range(150):
            at += draw.choice(gaps)
            rows += [(START + timedelta(seconds=at),)] * draw.randrange(1, 3)
        frame = spark.createDataFrame(draw.sample(rows, len(rows)), "event_time TIMESTAMP").repartition(3)
        own = frame.groupBy(F.session_window("event_time", "1 minute").alias("w")).agg(F.count("*").alias("n"))
        want = rows_of(own.select("w.start", "w.end", "n"))
        found = ts.session(frame, "1 minute")
        assert rows_of(found) == want
        assert rows_of(ts.session(frame, "1 minute", aggs=[F.count("*").alias("n")])) == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange SinglePartition") == 1
    under = plan[plan.index("Exchange SinglePartition") :].splitlines()[1]
    assert "Aggregate(keys=[_stretch" in under


def test_bounded_reads(spark, tmp_path):
    path = str(tmp_path / "in")
    for i in range(4):
        spark.range(i * 10, i * 10 + 10, 1, 1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("id LONG").option("maxFilesPerTrigger", 1).parquet(path)
    for rows, batches in ((1, 1), (10, 1), (11, 2), (40, 4)):
        assert ts.read_bounded(stream, rows=rows).count() == 10 * batches
    assert ts.read_bounded(stream, rows=1000, seconds=6).count() in (10, 20, 30, 40)
    assert ts.read_bounded(stream, seconds=0).count() in (0, 10)
    with pytest.raises(ValueError):
        ts.read_bounded(stream)


def test_a_failing_bounded_read_is_raised(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path)
    broken = spark.readStream.schema("id LONG").parquet(path).select(F.raise_error(F.lit("broken")).cast("int").alias("x"))
    with pytest.raises(Exception, match="broken"):
        ts.read_bounded(broken, rows=1, seconds=60)


def test_a_metric_view_merges_each_batch_once(spark, tmp_path):
    path, state, checkpoint = (str(tmp_path / name) for name in ("in", "state", "checkpoint"))
    view = ts.MetricView(["k"], {"n": ("count", None), "v": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "m": ("avg", "v")})
    assert view.read(spark, state) is None
    draw, rows = random.Random(6), []
    for size in (20, 1, 30):
        new = [(draw.choice(["a", "b", None]), draw.choice([None, 1.0, 2.5, -4.0])) for _ in range(size)]
        rows += new
        spark.createDataFrame(new, "k STRING, v DOUBLE").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("k STRING, v DOUBLE").parquet(path)
        for _ in range(2):  # the second start finds nothing new
            ts.start_metric(stream, view, state, checkpoint, once=True).awaitTermination()
        whole = spark.createDataFrame(rows, "k STRING, v DOUBLE")
        want = whole.groupBy("k").agg(F.count("*"), F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.avg("v"))
        assert rows_of(view.read(spark, state)) == rows_of(want)
    # A batch that is run again after a failure starts from the state of the one before.
    again = spark.createDataFrame(rows[-30:], "k STRING, v DOUBLE")
    view.refresh(again, 2, state)
    view.refresh(again, 2, state)
    assert rows_of(view.read(spark, state)) == rows_of(want)
    assert spark.read.parquet(state).count() <= 6


def test_what_cannot_be_merged_is_refused():
    for agg in (("median", "v"), ("sum", None)):
        with pytest.raises(ValueError):
            ts.MetricView([], {"x": agg})
