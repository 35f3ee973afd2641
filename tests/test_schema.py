from pyspark.sql import functions as F

import topicspark as ts


def columns(log, **kwargs):
    rows = ts.infer_schema(log, **kwargs).orderBy("topic", "ordinal").collect()
    return [(row["column"], row["type"]) for row in rows]


def test_json_types(values_log):
    log = values_log('{"run": 7, "crew": "night", "share": 0.25, "open": false}')
    assert columns(log) == [("run", "BIGINT"), ("crew", "STRING"), ("share", "DOUBLE"), ("open", "BOOLEAN")]


def test_json_other_values_are_text(values_log):
    log = values_log('{"z": null, "a": {"b": 1}, "m": [1], "big": 12345678901234567890, "whole": 10.0, "e": 1e3}')
    assert columns(log) == [
        ("z", "STRING"), ("a", "STRING"), ("m", "STRING"), ("big", "STRING"), ("whole", "DOUBLE"), ("e", "DOUBLE"),
    ]


def test_json_without_columns(values_log):
    assert columns(values_log("[1, 2]", "{broken", '{"a": 1')) == []


def test_types_widen_over_samples(values_log):
    log = values_log(
        '{"a": 1, "b": true, "c": true, "d": 1}', '{"a": 1.5, "b": 2, "c": "x", "d": 2, "e": false}', '{"e": 0.5}'
    )
    assert columns(log) == [("a", "DOUBLE"), ("b", "BIGINT"), ("c", "STRING"), ("d", "BIGINT"), ("e", "DOUBLE")]


def test_xml_children(values_log):
    log = values_log("<trip><stop>Lyon</stop><gate>B</gate><stop>Nice</stop></trip>")
    assert columns(log) == [("stop", "STRING"), ("gate", "STRING")]
    log = values_log("<trip><crew><lead>Ida</lead></crew><miles>40</miles></trip>")
    assert columns(log) == [("crew", "STRING"), ("miles", "STRING")]
    assert columns(values_log("<trip><stop>Lyon</gate></trip>")) == []
    assert columns(values_log("<!DOCTYPE trip><trip><stop>Lyon</stop></trip>")) == []


def test_format_of_first_telling_sample(values_log, make_log):
    assert ts.detect_format(values_log("plain", "<a/>", "{}")).first()["format"] == "XML"
    assert ts.detect_format(values_log("plain", " [1]")).first()["format"] == "JSON"
    assert ts.detect_format(values_log("plain")).first()["format"] == "AUTO"
    late = make_log([("t", 1, 0, 0, None, "{}")])  # partition 0 is empty
    assert ts.detect_format(late).first()["format"] == "JSON"
    assert ts.detect_format(late, n=10).first()["format"] == "AUTO"


def test_sample_size(values_log):
    log = values_log(*["{}"] * 10, '{"late": 1}')
    assert columns(log) == [("late", "BIGINT")]
    assert columns(log, n=10) == []


def test_json_topic_ignores_xml_samples(values_log):
    assert columns(values_log('{"a": 1}', "<r><b/></r>")) == [("a", "BIGINT")]


def key_of(spark, names, strict=False):
    rows = [("t", i, name, "STRING") for i, name in enumerate(names)]
    frame = spark.createDataFrame(rows, "topic STRING, ordinal INT, column STRING, type STRING")
    found = ts.find_key_field(frame, strict).collect()
    return found[0]["key_field"] if found else None


def test_key_field(spark):
    assert key_of(spark, ["ID", "id"]) == "id"
    assert key_of(spark, ["x", "ORDER_ID", "Id"]) == "ORDER_ID"
    assert key_of(spark, ["b", "a"]) == "b"
    assert key_of(spark, ["b", "a"], strict=True) is None
    assert key_of(spark, []) is None


def test_typed_view(spark, values_log):
    log = values_log('{"id": 7, "name": "x", "nested": {"a": 1}}', "broken", '{"id": "not a number", "name": "y"}')
    schema = ts.schema_struct(ts.infer_schema(log, n=1), "t")
    view = ts.topic_table(log, schema)
    assert view.columns == ["id", "name", "nested", "raw_value", "proc_time", "event_time"]
    assert dict(view.dtypes)["id"] == "bigint" and dict(view.dtypes)["event_time"] == "timestamp"
    rows = [tuple(row)[:4] for row in view.orderBy("event_time").collect()]
    assert rows[0] == (7, "x", '{"a":1}', '{"id": 7, "name": "x", "nested": {"a": 1}}')
    assert rows[1] == (None, None, None, "broken")
    assert rows[2][:2] == (None, "y")


def test_typed_view_of_xml(values_log):
    log = values_log("<order><id>1</id></order>")
    schema = ts.schema_struct(ts.infer_schema(log), "t")
    assert ts.topic_table(log, schema, "XML").columns == ["raw_value", "proc_time", "event_time"]


def test_topic_detail(values_log):
    row = ts.topic_detail(values_log('{"id": 1}', None, '{"id": 2}')).first()
    assert (row["format"], row["partitions"], row["estimated_size"]) == ("JSON", 1, 3)
    assert [c["column"] for c in row["columns"]] == ["id"]
    assert [s["value"] for s in row["samples"]] == ['{"id": 2}', '{"id": 1}']


def test_columns_named_with_spaces_and_dots(values_log):
    log = values_log('{"a.b": 1, "c d": "x"}')
    assert columns(log) == [("a.b", "BIGINT"), ("c d", "STRING")]
    row = ts.topic_table(log, ts.schema_struct(ts.infer_schema(log), "t")).select(F.col("`a.b`"), F.col("`c d`")).first()
    assert tuple(row) == (1, "x")
