"""One scan of the values: what it gives, that it is one, and that its parts can be put together."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import topicspark as ts
from tests.conftest import rows_of
from topicspark.operators import audit, profile, schema, shared

HOUR = 3_600_000


def plans_of(monkeypatch, work):
    """The physical plans of everything that ``work`` stores, and of its result."""
    seen = []

    def noting(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.checkpointed(df)

    for module in (audit, profile, schema):
        monkeypatch.setattr(module, "checkpointed", noting)
    from topicspark.operators import flows

    monkeypatch.setattr(flows, "checkpointed", noting)
    result = work()
    return [*seen, result._jdf.queryExecution().executedPlan().toString()]


def scans_of_values(plans):
    return sum(len(re.findall(r"ReadSchema: struct<[^>]*value:string", plan)) for plan in plans)


@pytest.fixture
def stored_log(spark, make_log, tmp_path):
    rows = [("a.b.1", 0, i, i * 1000, None, f'{{"id": {i % 40}, "v": {i}}}') for i in range(80)]
    rows += [("a.b.2", 0, i, i * 1000 + 500, None, f'{{"id": {i}, "v": "x"}}') for i in range(30)]
    rows += [("x.y", 0, i, i, None, f"<a><b>{i}</b></a>") for i in range(5)]
    path = str(tmp_path / "log")
    make_log(rows).write.partitionBy("topic").parquet(path)
    return ts.read_topic(spark, path)


def test_one_scan_of_the_values(stored_log, monkeypatch):
    assert scans_of_values(plans_of(monkeypatch, lambda: ts.topic_audit(stored_log))) == 1
    monkeypatch.undo()
    assert scans_of_values(plans_of(monkeypatch, lambda: ts.flow_audit(stored_log))) == 1
    monkeypatch.undo()
    assert scans_of_values(plans_of(monkeypatch, lambda: ts.infer_schema(stored_log))) == 1


def test_a_moved_first_column_is_counted_everywhere(make_log):
    """The key is the first record's first column, which other records have elsewhere or beside a key's name."""
    draw = random.Random(5)
    rows = [("t", 0, 0, 0, None, '{"k": "a", "z": 1}')]
    for i in range(1, 120):
        k = draw.choice("abcdefgh")
        value = draw.choice([f'{{"k": "{k}", "z": 1}}', f'{{"z": 2, "k": "{k}"}}', '{"z": 3}', '{"k": null}', "text", None, "[1]"])
        rows.append(("t", 0, i, i, None, value))
    log = make_log(rows)
    keys = Counter()
    for *_, value in rows:
        found = re.search(r'"k": "(.)"', value or "")
        keys[found[1] if found else None] += 1
    got = ts.topic_audit(log).first()
    assert got["duplicate_count"] == sum(1 for n in keys.values() if n > 1)
    assert got["message_count"] == 120
    assert got["poison_count"] == sum(1 for *_, v in rows if v == "text")


def test_late_key_names_win_over_first_columns(make_log):
    rows = [("t", 0, 0, 0, None, '{"a": 1}'), ("t", 0, 1, 1, None, '{"b": 1, "ORDER_ID": 1.0}'), ("t", 0, 2, 2, None, '{"ORDER_ID": 1}')]
    assert ts.topic_audit(make_log(rows)).first()["duplicate_count"] == 1
    assert rows_of(schema.topic_profile(make_log(rows))) == [("t", "JSON", "ORDER_ID", "DOUBLE")]
    rows.append(("t", 0, 3, 3, None, '{"id": "1"}'))
    assert rows_of(schema.topic_profile(make_log(rows))) == [("t", "JSON", "id", "STRING")]
    assert ts.topic_audit(make_log(rows)).first()["duplicate_count"] == 1  # the three without an id


def test_columns_keep_the_order_of_the_first_value(make_log):
    values = ['{"b": 1, "a": true}', '{"c": 1.5, "b": 2.5}', '{"a": false, "d": {"x": 1}, "c": 12345678901234567890}', "{}", "[{}]", "7"]
    log = make_log([("t", 3, i, i, None, v) for i, v in enumerate(values)] + [("t", 1, 0, 0, None, '{"z": null}')])
    assert rows_of(ts.infer_schema(log).select("ordinal", "column", "type")) == [
        (0, "z", "STRING"), (1, "b", "DOUBLE"), (2, "a", "BOOLEAN"), (3, "c", "STRING"), (4, "d", "STRING")
    ]


def test_xml_and_mixed_topics(make_log):
    rows = [("x", 0, 0, 0, None, " <r><b/><a/><b/></r>"), ("x", 0, 1, 1, None, '{"q": 1}'), ("x", 0, 2, 2, None, "<r><c/>"), ("x", 0, 3, 3, None, "<r/>")]
    rows += [("n", 0, 0, 0, None, "plain"), ("n", 0, 1, 1, None, None), ("e", 0, 0, 0, None, None)]
    log = make_log(rows)
    assert rows_of(ts.infer_schema(log).select("topic", "column", "type")) == [("x", "a", "STRING"), ("x", "b", "STRING")]
    found = {r["topic"]: (r["format"], r["poison_count"], r["message_count"], r["duplicate_count"]) for r in ts.topic_audit(log).collect()}
    assert found == {"x": ("XML", 2, 4, 0), "n": ("AUTO", 0, 2, 0), "e": ("AUTO", 0, 1, 0)}


def test_parts_put_together_give_the_whole(make_log):
    draw = random.Random(9)
    rows = []
    for i in range(300):
        value = draw.choice([f'{{"id": {i % 70}, "v": {i}}}', f'{{"v": "t", "id": "{i % 7}"}}', f"<a><b{i % 3}/></a>", "bad", None])
        rows.append((draw.choice(["p", "q", "r"]), i % 3, i, i, None, value))
    log = make_log(rows)
    parts = [ts.scan_values(make_log(rows[a : a + 75])) for a in range(0, 300, 75)]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    assert rows_of(ts.topic_audit(log, parts=united)) == rows_of(ts.topic_audit(log))
    assert rows_of(profile.merged_columns(united, profile.topic_facts(united))) == rows_of(ts.infer_schema(log))


def test_nothing(make_log):
    log = make_log([])
    assert ts.topic_audit(log).count() == 0 and ts.infer_schema(log).count() == 0 and ts.flow_audit(log).count() == 0
