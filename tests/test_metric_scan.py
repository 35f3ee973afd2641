import random

import pytest
from pyspark.sql import functions as F

import topicspark as ts
from tests.conftest import START
from topicspark.operators.metric_scan import plain_metric, scan_metrics
from topicspark.plans.sql import run_sql

SCHEMA = "Kind STRING, place INT, n INT, x DOUBLE, d DECIMAL(10,2), s STRING"


def frame_of(spark, size, seed=0):
    rng = random.Random(seed)
    from decimal import Decimal

    rows = [
        (
            rng.choice(["a", "b", "GROUP BY", None]), rng.choice([1, 2, None]), rng.choice([None, *range(9)]),
            rng.choice([None, 0.5, 1.25, -3.0]), rng.choice([None, Decimal("1.10"), Decimal("-2.55")]), rng.choice("pq1"),
        )
        for _ in range(size)
    ]
    return spark.createDataFrame(rows, SCHEMA)


PLAIN = {
    "all": "SELECT COUNT(*) AS metric_value FROM {t}",
    "some": "select count(n) Metric_Value from {t} where kind = 'a' and (place = 1 or n > 3)",
    "none": "SELECT COUNT(*) AS metric_value, 'x' AS why FROM {t} WHERE false",
    "no_sum": "SELECT SUM(n) AS metric_value FROM {t} WHERE kind = 'nothing'",
    "sum": "SELECT SUM(n) AS metric_value FROM {t} WHERE kind IS NULL OR kind <> 'b'",
    "mean": "SELECT AVG(n) AS metric_value, kind FROM {t} GROUP BY kind",
    "decimal": "SELECT kind AS a, SUM(d) AS metric_value, place AS b FROM {t} WHERE x > 0 GROUP BY kind, place",
    "least": "SELECT place, MIN(x) AS metric_value FROM {t} GROUP BY place, kind",
    "text": "SELECT MAX(n) AS metric_value, 'order, of' AS type FROM {t} GROUP BY 'order'",
    "text_none": "SELECT MAX(n) AS metric_value, 'o' AS type FROM {t} WHERE n > 99 GROUP BY 'order'",
    "words": "SELECT COUNT(*) AS metric_value, Kind FROM {t} WHERE kind = 'GROUP BY' GROUP BY kind",
    "no_group": "SELECT COUNT(*) AS metric_value, kind FROM {t} WHERE n > 99 GROUP BY kind",
}
OTHER = {
    "ratio": "SELECT COUNT(*) * 100.0 / (SELECT COUNT(*) FROM {t}) AS metric_value FROM {t} WHERE kind = 'a'",
    "ordered": "SELECT COUNT(*) AS metric_value, kind FROM {t} GROUP BY kind ORDER BY 1",
    "having": "SELECT COUNT(*) AS metric_value, kind FROM {t} GROUP BY kind HAVING count(*) > 1",
    "inner": "SELECT COUNT(*) AS metric_value FROM {t} WHERE n IN (SELECT 1)",
    "distinct": "SELECT COUNT(DISTINCT n) AS metric_value FROM {t}",
    "string": "SELECT MAX(s) AS metric_value FROM {t}",
    "ordinal": "SELECT COUNT(*) AS metric_value, kind FROM {t} GROUP BY 2",
    "alias": "SELECT COUNT(*) AS metric_value, kind AS k FROM {t} GROUP BY k",
    "union": "SELECT COUNT(*) AS metric_value FROM {t} WHERE n > 1 UNION ALL SELECT 1 AS metric_value FROM {t}",
    "comment": "SELECT COUNT(*) AS metric_value FROM {t} WHERE n > 1 -- OR true",
    "twice": "SELECT COUNT(*) AS metric_value, kind AS a, kind AS A FROM {t} GROUP BY kind",
}


def told(frame):
    rows = [(r["id"], r["seq"], r["metric_value"], tuple(sorted((r["labels"] or {}).items())), r["error"]) for r in frame.collect()]
    # Rows of one metric by their order: numbers may have gaps.
    return sorted(((i, v, k, e) for i, _, v, k, e in sorted(rows, key=lambda r: (r[0], r[1]))), key=lambda r: r[0])


def one_by_one(spark, metrics, frames):
    out = []
    for id_, sql in metrics.items():
        try:
            rows = ts.eval_metric(spark, sql, **frames).orderBy("seq").collect()
            if rows or run_sql(spark, sql, **frames).count():
                out += [(id_, r["metric_value"], tuple(sorted(r["labels"].items())), None) for r in rows]
            else:
                out.append((id_, None, (), "No rows returned"))
        except Exception as error:  # noqa: BLE001
            out.append((id_, None, (), str(error).split("\n", 1)[0]))
    return sorted(out, key=lambda r: r[0])


def test_what_is_plain(spark):
    frames = {"t": frame_of(spark, 3)}
    for id_, sql in {**PLAIN, **OTHER}.items():
        try:
            schema = run_sql(spark, sql, **frames).schema
        except Exception:  # noqa: BLE001
            assert id_ == "twice" or id_ in OTHER
            continue
        assert (plain_metric(id_, sql, frames, schema) is not None) == (id_ in PLAIN), id_


@pytest.mark.parametrize("size", [0, 200])
def test_shared_scans_give_what_each_query_gives(spark, size):
    frames = {"t": frame_of(spark, size)}
    metrics = {**PLAIN, **OTHER}
    registry = spark.createDataFrame(list(metrics.items()), "id STRING, sql STRING")
    assert told(ts.refresh_metrics(spark, registry, frames, START)) == one_by_one(spark, metrics, frames)


def test_a_hundred_metrics_read_their_frame_once(spark):
    read = spark.sparkContext.accumulator(0)
    rows = frame_of(spark, 50)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    frame = rows.mapInPandas(seen, rows.schema)
    metrics = [(f"m{i}", f"SELECT COUNT(*) AS metric_value, kind FROM {{t}} WHERE n > {i % 9} GROUP BY kind") for i in range(50)]
    metrics += [(f"s{i}", f"SELECT SUM(n) AS metric_value FROM {{t}} WHERE n <> {i % 9}") for i in range(50)]
    result = ts.refresh_metrics(spark, spark.createDataFrame(metrics, "id STRING, sql STRING"), {"t": frame}, START)
    # The sort's own sample of its input comes from the shuffled results, not from the frame.
    assert read.value == 50
    assert result.select("id").distinct().count() == 100 and read.value == 50


def test_one_that_fails_on_its_data_fails_alone(spark):
    frames = {"t": frame_of(spark, 100)}
    metrics = {f"m{i}": f"SELECT COUNT(*) AS metric_value FROM {{t}} WHERE n > {i}" for i in range(5)}
    metrics["fails"] = "SELECT COUNT(*) AS metric_value FROM {t} WHERE CAST(s AS INT) > 0"
    registry = spark.createDataFrame(list(metrics.items()), "id STRING, sql STRING")
    got = {r["id"]: r for r in ts.refresh_metrics(spark, registry, frames, START).collect()}
    assert len(got) == 6 and [id_ for id_, r in got.items() if r["error"]] == ["fails"]
    for i in range(5):
        assert got[f"m{i}"]["metric_value"] == frames["t"].filter(F.col("n") > i).count()


def test_repeated_and_null_ids(spark):
    frames = {"t": frame_of(spark, 10)}
    sql = "SELECT COUNT(*) AS metric_value FROM {t}"
    registry = spark.createDataFrame([("m", sql), ("m", sql), (None, sql), ("k", sql)], "id STRING, sql STRING")
    rows = ts.refresh_metrics(spark, registry, frames, START).collect()
    assert sorted((str(r["id"]), r["metric_value"]) for r in rows) == [("None", 10.0), ("k", 10.0), ("m", 10.0), ("m", 10.0)]


def test_one_grouping_needs_no_copies(spark):
    frames = {"t": frame_of(spark, 10)}
    schema = run_sql(spark, PLAIN["all"], **frames).schema
    metrics = [plain_metric(id_, PLAIN[id_], frames, schema) for id_ in ("all", "some", "sum")]
    plan = scan_metrics(frames["t"], metrics)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Aggregate") == 1
