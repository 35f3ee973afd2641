import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import topicspark as ts
from tests.conftest import START
from topicspark.operators import enrich

ROWS = "k STRING, at TIMESTAMP, n INT"
CHANGES = "k STRING, since TIMESTAMP, n INT"


def moment(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def wanted(rows, changes, how):
    out = []
    for k, at, n in rows:
        held = [(since, m) for c, since, m in changes if k is not None and c == k and None not in (at, since) and since <= at]
        if held or how == "left":
            out.append((k, at, n, max(held)[1] if held else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_against_plain_search(spark, monkeypatch, how, broadcast_rows):
    monkeypatch.setattr(enrich, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(len(how) + broadcast_rows)
    keys = ["hot", "hot", "hot", "a", "b", None]
    times = [None, *range(0, 90_000, 600)]
    rows = [(rng.choice(keys), rng.choice(times), i) for i in range(200)]
    # Hours apart, within an hour, and at one time.
    changes = [(rng.choice(keys[1:]), rng.choice(times), i) for i in range(60)] + [("b", 600, 1), ("b", 600, 2)]
    left = spark.createDataFrame([(k, moment(at), n) for k, at, n in rows], ROWS)
    right = spark.createDataFrame([(k, moment(at), n) for k, at, n in changes], CHANGES)
    found = ts.join_as_of(left, right, "k", "at", "since", how).withColumn("m", F.col("reference.n"))
    offset = START.timestamp()
    got = [
        (r["k"], None if r["at"] is None else round(r["at"].timestamp() - offset), r["n"], r["m"]) for r in found.collect()
    ]
    assert sorted(got, key=repr) == wanted(rows, changes, how)


def test_empty_sides_and_names(spark):
    rows = spark.createDataFrame([("a", moment(5), 1)], ROWS)
    changes = spark.createDataFrame([("a", moment(5), 7)], CHANGES)
    assert ts.join_as_of(rows, changes.limit(0), "k", "at", "since").count() == 0
    assert ts.join_as_of(rows, changes.limit(0), "k", "at", "since", "left").first()["reference"] is None
    assert ts.join_as_of(rows.limit(0), changes, "k", "at", "since", "left").count() == 0
    assert ts.join_as_of(rows, changes, "k", "at", "since", name="held").first()["held"]["n"] == 7
    with pytest.raises(ValueError):
        ts.join_as_of(rows, changes, "k", "at", "since", name="n")
    with pytest.raises(ValueError):
        ts.join_as_of(rows, changes, "k", "at", "since", "full")


def test_a_running_stream_takes_up_changes(spark, tmp_path):
    base = str(tmp_path)

    def put(folder, schema, *rows):
        spark.createDataFrame([(k, moment(at), n) for k, at, n in rows], schema).coalesce(1).write.mode("append").parquet(f"{base}/{folder}")

    put("changes", CHANGES, ("a", 0, 1))
    put("in", ROWS, ("a", 10, 1), ("b", 10, 2))
    query = ts.start_reference_join(
        spark.readStream.schema(ROWS).parquet(f"{base}/in"), lambda session: session.read.parquet(f"{base}/changes"),
        "k", "at", "since", f"{base}/out", f"{base}/state", "left", every="0 seconds",
    )
    try:
        query.processAllAvailable()
        put("changes", CHANGES, ("a", 20, 2), ("b", 0, 3))
        put("in", ROWS, ("a", 19, 3), ("a", 20, 4), ("b", 30, 5))
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.parquet(f"{base}/out").select("n", "reference.n").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1), (2, None), (3, 1), (4, 2), (5, 3)]
