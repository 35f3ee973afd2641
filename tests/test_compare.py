import random
from collections import Counter, defaultdict

import pytest

import topicspark as ts
from tests.conftest import rows_of


def frame(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, x STRING, y DOUBLE")


def flat(rows):
    return sorted(
        (
            (r["id"], r["status"], r["messages_a"], r["messages_b"], tuple(r["x"]), tuple(r["y"]))
            for r in rows.collect()
        ),
        key=repr,
    )


def test_unique_ids(spark):
    a = frame(spark, [(1, "p", 1.0), (2, "p", 1.0), (3, "p", None), (None, "n", 0.0)])
    b = frame(spark, [(1, "p", 1.0), (2, "p", 2.0), (4, "p", 1.0), (None, "n", 0.0)])
    assert flat(ts.compare_topics(a, b, "id")) == sorted(
        [
            (1, "equal", 1, 1, ("p", "p", True), (1.0, 1.0, True)),
            (2, "modified", 1, 1, ("p", "p", True), (1.0, 2.0, False)),
            (3, "only_a", 1, 0, ("p", None, False), (None, None, False)),
            (4, "only_b", 0, 1, (None, "p", False), (None, 1.0, False)),
            (None, "equal", 1, 1, ("n", "n", True), (0.0, 0.0, True)),
        ],
        key=repr,
    )
    assert {r["status"] for r in ts.compare_topics(a, b, "id", diff_only=True).collect()} == {"modified", "only_a", "only_b"}
    assert {r["status"] for r in ts.compare_topics(a, b, "id", cols=["x"]).filter("id = 2").collect()} == {"equal"}


@pytest.mark.parametrize("seed", range(3))
def test_repeated_ids_against_multisets(spark, seed):
    rng = random.Random(seed)
    side = lambda: [
        (rng.choice([7, 7, 7, None, *range(6)]), rng.choice("pqr"), float(rng.randrange(2))) for _ in range(60)
    ]
    a, b = side(), side()
    count_a, count_b = Counter(a), Counter(b)
    rest = defaultdict(lambda: ([], []))
    wanted = []
    for row in count_a.keys() | count_b.keys():
        id_, x, y = row
        common = min(count_a[row], count_b[row])
        if common:
            wanted.append((id_, "equal", common, common, (x, x, True), (y, y, True)))
        for s, n in ((0, count_a[row] - common), (1, count_b[row] - common)):
            if n:
                rest[id_][s].append((x, y, n))
    for id_, (in_a, in_b) in rest.items():
        status = "modified" if in_a and in_b else "only_a" if in_a else "only_b"
        if len(in_a) <= 1 and len(in_b) <= 1:
            (xa, ya, na), (xb, yb, nb) = (in_a or [(None, None, 0)])[0], (in_b or [(None, None, 0)])[0]
            both = status == "modified"
            wanted.append((id_, status, na, nb, (xa, xb, both and xa == xb), (ya, yb, both and ya == yb)))
        else:
            wanted += [(id_, status, n, 0, (x, None, False), (y, None, False)) for x, y, n in in_a]
            wanted += [(id_, status, 0, n, (None, x, False), (None, y, False)) for x, y, n in in_b]
    got = ts.compare_topics(frame(spark, a), frame(spark, b), "id")
    assert flat(got) == sorted(wanted, key=repr)
    totals = got.agg({"messages_a": "sum", "messages_b": "sum"}).first()
    assert sorted(totals) == [60, 60]


@pytest.mark.parametrize("seed", range(3))
def test_differences_by_digest_are_those_of_the_whole_comparison(spark, seed):
    rng = random.Random(seed)
    side = lambda: [
        (rng.choice([7, 7, None, *range(12)]), rng.choice(["p", "q", None]), rng.choice([0.0, -0.0, None, float("nan")]))
        for _ in range(50)
    ]
    a, b = frame(spark, side()), frame(spark, side())
    whole = ts.compare_topics(a, b, "id")
    # NaN is not equal to itself once it is out of Spark: compare texts.
    wanted = [repr(row) for row in flat(whole.filter("status <> 'equal'"))]
    assert [repr(row) for row in flat(ts.compare_topics(a, b, "id", diff_only=True))] == wanted
    summary = ts.compare_summary(a, b, "id").first()
    kinds = Counter(r["status"] for r in whole.collect())
    assert (summary["differences"], summary["modified"]) == (len(wanted), kinds["modified"])
    assert (summary["only_a"], summary["only_b"]) == (kinds["only_a"], kinds["only_b"])
    assert (summary["messages_a"], summary["messages_b"]) == (50, 50)


def test_nulls_in_other_columns_and_types_in_digests(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "1", None)], "id INT, x STRING, y STRING")
    b = spark.createDataFrame([(1, "x", None), (2, "1", None)], "id BIGINT, x STRING, y STRING")
    assert [r["id"] for r in ts.compare_topics(a, b, "id", diff_only=True).collect()] == [1]
    a = spark.createDataFrame([(1, 5), (2, 6)], "id INT, x INT")
    b = spark.createDataFrame([(1, 5), (2, 7)], "id INT, x BIGINT")
    assert [r["id"] for r in ts.compare_topics(a, b, "id", diff_only=True).collect()] == [2]
    assert ts.compare_summary(a, b, "id").first()["modified"] == 1
    nested = spark.createDataFrame([(1, [1, None]), (2, [None])], "id INT, x ARRAY<INT>")
    other = spark.createDataFrame([(1, [None, 1]), (2, [None])], "id INT, x ARRAY<INT>")
    assert [r["id"] for r in ts.compare_topics(nested, other, "id", diff_only=True).collect()] == [1]
    assert ts.compare_summary(nested, other, "id").first()["differences"] == 1
    empty = a.limit(0)
    row = ts.compare_summary(empty, empty, "id").first()
    assert (row["differences"], row["messages_a"], row["messages_b"]) == (0, 0, 0)
    assert ts.compare_topics(empty, empty, "id", diff_only=True).count() == 0
    only_ids = a.select("id")
    assert ts.compare_summary(only_ids, only_ids.limit(1), "id").first()["differences"] == 1


def test_a_summary_shuffles_no_contents(spark, tmp_path):
    for name in "ab":
        frame(spark, [(i, "text", 1.0) for i in range(10)]).write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in "ab")
    plan = ts.compare_summary(a, b, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("x#" in line or "content" in line for line in exchanged)


def test_missing_records(spark):
    a, b = frame(spark, [(1, "p", 1.0), (2, "p", 1.0), (2, "q", 1.0)]), frame(spark, [(1, "z", 9.0), (3, "p", 1.0)])
    assert rows_of(ts.missing_records(a, b, "id")) == [(2, "a", 2), (3, "b", 1)]


def test_summary(spark):
    a = frame(spark, [(1, "p", 1.0), (2, "p", 1.0)]).selectExpr("*", "timestamp_seconds(id) AS t")
    b = frame(spark, [(1, "q", 1.0), (3, "p", 1.0)]).selectExpr("id", "x", "CAST(y AS FLOAT) AS y", "timestamp_seconds(0) AS t")
    row = ts.compare_summary(a, b, "id", ["x"], "t").first()
    assert (row["differences"], row["modified"], row["only_a"], row["only_b"]) == (3, 1, 1, 1)
    assert (row["messages_a"], row["msg_per_s_a"], row["messages_b"], row["msg_per_s_b"]) == (2, 2.0, 2, None)
    assert row["schema_mismatches"] == 1
    assert ts.compare_summary(a, b, "id", ["x"]).first()["msg_per_s_a"] is None


def test_schema_mismatch(values_log):
    a = ts.infer_schema(values_log('{"id": 1, "x": 1, "only": true}'))
    b = ts.infer_schema(values_log('{"id": 1, "x": "1"}'))
    assert rows_of(ts.schema_mismatch(a, b)) == [("only", "BOOLEAN", None), ("x", "BIGINT", "STRING")]


def test_throughput(make_log):
    log = make_log([("a", 0, 0, 0, None, None), ("a", 0, 1, 500, None, None), ("b", 0, 0, 0, None, None)])
    assert rows_of(ts.throughput(log)) == [("a", 2, 4.0), ("b", 1, None)]
