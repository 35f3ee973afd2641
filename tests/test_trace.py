import random
from collections import defaultdict

import pytest

import topicspark as ts
from tests.conftest import START, rows_of

HOUR = 3_600_000


@pytest.fixture(scope="module")
def three(make_log):
    return make_log(
        [
            ("topic1", 0, 0, 100, "key1", "value1"),
            ("topic2", 0, 0, 200, "key2", "contains-key1"),
            ("topic3", 0, 0, 300, "key3", "value3"),
        ]
    )


def test_key_or_value(three):
    hits = ts.trace_hits(three, "key1")
    assert [(n["id"], n["label"], n["type"], n["seq"]) for n in ts.trace_nodes(hits).orderBy("seq").collect()] == [
        ("topic1", "topic1", "topic", 1),
        ("topic2", "topic2", "topic", 2),
    ]
    assert [(e["from"], e["to"], e["label"]) for e in ts.trace_edges(hits).collect()] == [("topic1", "topic2", "flow")]


def test_scope(three):
    assert ts.trace_hits(three, None).count() == 0
    assert ts.trace_hits(three, "").count() == 3
    assert ts.trace_hits(three, "key", topics=["topic1", "topic3"]).count() == 2
    assert ts.trace_hits(three, "key", minutes=1, as_of=START).count() == 3
    with pytest.raises(ValueError):
        ts.trace_hits(three, "key", minutes=1)


@pytest.mark.parametrize("path, key, nodes", [("$.orderId", "ORD-123", 1), ("$.orderId", "ORD-999", 0), ("$.wrongPath", "ORD-123", 0)])
def test_json_path(values_log, path, key, nodes):
    log = values_log('{"orderId": "ORD-123", "status": "CREATED"}')
    assert ts.trace_nodes(ts.trace_hits(log, key, path=path)).count() == nodes


@pytest.mark.parametrize("pattern, nodes", [("user-.* failed", 1), (r"user-\d{4} failed", 0)])
def test_regex(values_log, pattern, nodes):
    log = values_log("ERROR: user-456 failed to login")
    assert ts.trace_nodes(ts.trace_hits(log, pattern, regex=True)).count() == nodes


def test_n_takes_the_newest_records(values_log):
    log = values_log(*[f"m{i}" for i in range(1200)])
    assert ts.trace_hits(log, "m").count() == 1200
    assert ts.trace_hits(log, "m", n=10).agg({"offset": "min"}).first()[0] == 1190
    assert ts.trace_hits(log, "m", n=1100).count() == 1100


def brute_edges(hits):
    """(from, to, from_at, to_at) over hits in order of (time, topic, partition, offset)."""
    ordered = sorted(hits, key=lambda h: (h[3], h[0], h[1], h[2]))
    return [(a[0], b[0], a[3], b[3]) for a, b in zip(ordered, ordered[1:]) if a[0] != b[0]]


@pytest.mark.parametrize("seed", range(3))
def test_edges_against_a_sequential_pass(make_log, seed):
    rng = random.Random(seed)
    rows, seen = [], set()
    for _ in range(600):
        place = (rng.choice(["a", "b", "c.d"]), rng.randrange(2), rng.randrange(5000))
        if place in seen:
            continue
        seen.add(place)
        time = rng.choice([5, 5, rng.randrange(40) * HOUR, rng.randrange(20 * HOUR)])
        rows.append((*place, time, rng.choice(["hot", "hot", "k1", "k2", None]), None))
    log = make_log(rows)
    by_key = defaultdict(list)
    for row in rows:
        if row[4] is not None:
            by_key[row[4]].append(row)
    wanted = sorted((key, *edge) for key, hits in by_key.items() for edge in brute_edges(hits))
    got = ts.trace_all(log).selectExpr("key", "`from`", "`to`", "unix_millis(from_ts)", "unix_millis(to_ts)").collect()
    base = round(START.timestamp() * 1000)
    assert sorted((k, f, t, x - base, y - base) for k, f, t, x, y in got) == wanted

    hot = ts.trace_edges(ts.trace_hits(log, "hot"))
    got = hot.selectExpr("`from`", "`to`", "unix_millis(from_ts)", "unix_millis(to_ts)").collect()
    assert sorted((f, t, x - base, y - base) for f, t, x, y in got) == sorted(brute_edges(by_key["hot"]))
    assert sum(r["n"] for r in ts.edge_counts(hot).collect()) == len(brute_edges(by_key["hot"]))


def test_bucket_length_does_not_change_the_edges(make_log):
    log = make_log([("ab"[i % 2], 0, i, i * 700_000, "k", None) for i in range(50)])
    wanted = rows_of(ts.trace_all(log))
    assert len(wanted) == 49
    assert rows_of(ts.trace_all(log, bucket_ms=1000)) == wanted == rows_of(ts.trace_all(log, bucket_ms=10**12))
