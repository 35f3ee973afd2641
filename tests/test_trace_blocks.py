"""Searches through a trace index give what a scan gives, and read little for a rare key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import topicspark as ts
from tests.conftest import rows_of
from topicspark.operators import trace_blocks


@pytest.fixture(scope="module")
def mixed_log(make_log):
    draw = random.Random(4)
    rows = []
    for topic in ("a", "b", "c"):
        for i in range(400):
            word = "".join(draw.choice("abcdeé") for _ in range(draw.randrange(2, 9)))
            value = draw.choice([
                f'{{"id": "ORD-{i}", "n": {i}.50, "w": "{word}"}}', f'{{"id": "\\u004fRD-{i}", "w": "{word}"}}',
                f"<o><id>ORD-{i}</id><w>{word}</w></o>", f"<o><id>OR&#68;-{i}</id></o>", f"plain ORD-{i} {word}", None, "", "x",
            ])
            rows.append((topic, i % 3, i // 3, i, draw.choice([None, f"key-{i}", word]), value))
    return make_log(rows).repartition(5)


KEYS = ["ORD-17", "key-250", "é", "17.50", "abcde"]


@pytest.mark.parametrize(("block", "ranges"), [(16, 200), (16, 0), (1024, 200)])
def test_same_hits_as_a_scan(mixed_log, monkeypatch, block, ranges):
    monkeypatch.setattr(trace_blocks, "RANGES", ranges)
    index = ts.trace_index(mixed_log, block=block, bits=1 << 12).cache()
    for key in KEYS:
        for path in (None, "$.id", "/o/id") if key.startswith("ORD") else (None, "$.n"):
            want = rows_of(ts.trace_hits(mixed_log, key, path=path))
            assert rows_of(ts.trace_hits(mixed_log, key, path=path, index=index)) == want, (key, path)


@pytest.mark.parametrize("ranges", [200, 0])
def test_records_behind_the_index_are_searched(mixed_log, monkeypatch, ranges):
    monkeypatch.setattr(trace_blocks, "RANGES", ranges)
    index = ts.trace_index(mixed_log.filter("topic <> 'c' AND NOT (topic = 'b' AND partition = 1) AND offset < 50"), block=16).cache()
    for key in ("ORD-17", "ORD-399", "key-250"):
        assert rows_of(ts.trace_hits(mixed_log, key, index=index)) == rows_of(ts.trace_hits(mixed_log, key))
        some = ts.trace_hits(mixed_log, key, index=index, topics=["b", "c"])
        assert rows_of(some) == rows_of(ts.trace_hits(mixed_log, key, topics=["b", "c"]))


def test_fallbacks(mixed_log, make_log):
    index = ts.trace_index(mixed_log)
    assert rows_of(ts.trace_hits(mixed_log, "ORD-1[78]$", regex=True, index=index)) == rows_of(ts.trace_hits(mixed_log, "ORD-1[78]$", regex=True))
    assert ts.trace_hits(mixed_log, None, index=index).count() == 0
    empty = ts.trace_index(make_log([]))
    assert empty.count() == 0
    assert rows_of(ts.trace_hits(mixed_log, "ORD-17", index=empty)) == rows_of(ts.trace_hits(mixed_log, "ORD-17"))
    with pytest.raises(ValueError):
        ts.trace_index(mixed_log, bits=1000)


def scanned(frame):
    """Rows that the plan's file scans gave, after it has run."""
    frame.collect()
    total, pending = 0, [frame._jdf.queryExecution().executedPlan()]
    while pending:
        node = pending.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            pending.append(node.executedPlan())
            continue
        if name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        if "QueryStage" in name:
            pending.append(node.plan())
        pending += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_rare_key_reads_little(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(40_000).select(
        F.lit("t").alias("topic"), (F.col("id") % 2).cast("int").alias("partition"), F.expr("id div 2").alias("offset"),
        F.timestamp_millis("id").alias("timestamp"), F.col("id").cast("string").alias("key"),
        F.format_string('{"id": "ORD-%07d"}', "id").alias("value"),
    )
    rows = rows.repartitionByRange(8, "partition", "offset").sortWithinPartitions("partition", "offset")
    rows.write.option("maxRecordsPerFile", 1000).partitionBy("topic").parquet(path)
    log = ts.read_topic(spark, path)
    ts.trace_index(log, block=500).write.parquet(str(tmp_path / "index"))
    hits = ts.trace_hits(log, "ORD-0012345", path="$.id", index=spark.read.parquet(str(tmp_path / "index")))
    assert [r["offset"] for r in hits.collect()] == [6172]
    assert 0 < scanned(hits) < 4_000
    assert scanned(ts.trace_hits(log, "ORD-0012345", path="$.id")) == 40_000
