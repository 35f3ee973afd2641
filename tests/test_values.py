import pytest
from pyspark.sql import functions as F

import topicspark as ts
from topicspark.functions import json_text

DOCTYPE = '<!DOCTYPE foo [<!ENTITY xxe SYSTEM "file:///etc/passwd">]><foo>&xxe;</foo>'


def evaluate(spark, values, column):
    """The column over each value, in order."""
    frame = spark.createDataFrame([(i, v, None) for i, v in enumerate(values)], "i INT, value STRING, key STRING")
    return [row[1] for row in frame.select("i", column.alias("c")).orderBy("i").collect()]


XML_CASES = {
    # Plain paths are followed in the same parse as the check; the others go to Spark's XPath functions.
    "/trip/stop": [
        ("<trip><stop>Lyon</stop></trip>", "Lyon"),
        ("<trip><stop/></trip>", ""),
        ("<trip><stop>first</stop><stop>second</stop></trip>", "first"),
        ("<trip><stop>Saint-<b>Malo</b> &amp; <![CDATA[<Dol>]]><!-- no --></stop><stop>x</stop></trip>", "Saint-Malo & <Dol>"),
        ("<trip><other><stop>deeper</stop></other><stop>own</stop></trip>", "own"),
        ("<trip><trip><stop>deeper</stop></trip></trip>", None),
        ("<stop><trip><stop>x</stop></trip></stop>", None),
        ("<trip><other>Lyon</other></trip>", None),
        (None, None),
        ("  \n ", None),
        ("\n <trip><stop>padded</stop></trip> ", "padded"),
        ("<trip><stop>early</stop>", "Error: malformed XML"),
        ("plain", "Error: malformed XML"),
        ("<trip><stop>1</stop></trip><b/>", "Error: malformed XML"),
        ("<!DOCTYPE trip><trip><stop>1</stop></trip>", "Error: malformed XML"),
    ],
    "/trip/stop/@id": [
        ('<trip><stop id="B7">Lyon</stop></trip>', "B7"),
        ('<trip><stop/><stop id="2"/><stop id="3"/></trip>', "2"),
        ('<trip id="1"><stop/></trip>', None),
    ],
    "/trip/crew/lead": [("<trip><crew><lead>Ida</lead></crew></trip>", "Ida")],
    "/foo": [(DOCTYPE, "Error: malformed XML")],
    "//lead": [("<trip><crew><lead>Ida</lead></crew></trip>", "Ida"), ("<a/>", None), ("<a", "Error: malformed XML")],
    "/a/b[2]": [("<a><b>1</b><b>2</b></a>", "2"), ("<a><b>1</b><b/></a>", ""), ("<a><b>1</b></a>", None), (None, None)],
    "/a[@k='v']/b": [("<a k='v'><b>1</b></a>", "1"), ("<a k='w'><b>1</b></a>", None)],
}


def test_xml_extract(spark):
    for path, cases in XML_CASES.items():
        values, expected = zip(*cases)
        assert evaluate(spark, values, ts.xml_extract("value", path)) == list(expected), path


def test_plain_paths_agree_with_spark(spark):
    documents = [text for cases in XML_CASES.values() for text, _ in cases if text and text.startswith("<")]
    for path in ("/trip/stop", "/trip/stop/@id", "/trip/crew", "/trip", "/a/b"):
        # The same nodes by a path that is not plain.
        native = evaluate(spark, documents, ts.xml_extract("value", f"{path}[true()]" if "@" not in path else path + "[.!='?']"))
        assert evaluate(spark, documents, ts.xml_extract("value", path)) == native, path


def test_several_paths_share_a_parse(spark):
    paths = {"stop": "/trip/stop", "id": "/trip/stop/@id", "lead": "/trip/crew/lead", "crew": "/trip/crew", "second": "/a/b[2]"}
    values = [text for cases in XML_CASES.values() for text, _ in cases] + ["<trip><crew><lead>Ida</lead>!</crew><stop/></trip>"]
    got = evaluate(spark, values, ts.xml_extract_all("value", paths))
    for name, path in paths.items():
        assert [row[name] for row in got] == evaluate(spark, values, ts.xml_extract("value", path)), path


def test_functions_in_sql_texts(spark):
    for path, cases in XML_CASES.items():
        frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i INT, value STRING")
        rows = ts.run_sql(spark, "SELECT i, XmlExtract(value, :path) AS x FROM {topic} ORDER BY i", args={"path": path}, topic=frame)
        assert [row["x"] for row in rows.collect()] == [expected for _, expected in cases], path
    for path, cases in JSON_CASES.items():
        frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i INT, value STRING")
        rows = ts.run_sql(spark, "SELECT i, JSON_VALUE(value, :path) AS x FROM {topic} ORDER BY i", args={"path": path}, topic=frame)
        assert [row["x"] for row in rows.collect()] == [expected for _, expected in cases], path


@pytest.mark.parametrize("path", ["count(/a)", "/a[", "'text'"])
def test_xml_extract_refuses_paths_without_nodes(spark, path):
    with pytest.raises(ValueError):
        ts.xml_extract("value", path)


JSON_CASES = {
    "$.a.b": [('{"a": {"b": 5}}', "5"), ('{"a": 1}', None)],
    "$.a": [
        ('{"a": 10.0}', "10.0"),
        ('{"a": "x"}', "x"),
        ('{"a": "{not an object}"}', "{not an object}"),
        ('{"a": true}', "true"),
        ('{"a": [1, 2]}', None),
        ('{"a": {"b": 5}}', None),
        ('{"a": null}', None),
        ('{"b": 1}', None),
        ('{"a": 1', None),
        (None, None),
    ],
    "$.a[1]": [('{"a": [1, 2]}', "2"), ('{"a": [1]}', None)],
}


def test_json_value(spark):
    for path, cases in JSON_CASES.items():
        values, expected = zip(*cases)
        assert evaluate(spark, values, ts.json_value("value", path)) == list(expected), path


def test_value_format(spark):
    cases = [("{}", "JSON"), ("\x00\t [1]", "JSON"), ("\r\n<a/>", "XML"), ("plain {", None), ("", None), ("   ", None), (None, None)]
    values, expected = zip(*cases)
    assert evaluate(spark, values, ts.value_format("value")) == list(expected)


MATCH_CASES = [
    ("contains-key1", "key1", False, True),
    ("contains-KEY1", "key1", False, False),
    ("user-456 failed", "user-.* failed", True, True),
    ("user-456 failed", r"user-\d{4} failed", True, False),
    ("a[b", "[", True, True),
    ("anything", "", False, True),
    ("anything", None, False, False),
    (None, "x", False, False),
]


def test_value_matches(spark):
    hits = [F.coalesce(ts.value_matches(F.lit(t).cast("string"), e, regex), F.lit(None)) for t, e, regex, _ in MATCH_CASES]
    assert list(spark.range(1).select(*hits).first()) == [hit for *_, hit in MATCH_CASES]


PATH_CASES = [
    ('{"orderId": "ORD-123"}', None, "ORD-123", "$.orderId", True),
    ('{"orderId": "ORD-123"}', None, "ORD-999", "$.orderId", False),
    ('{"orderId": "ORD-123"}', "ORD-123", "ORD-123", "$.wrongPath", False),
    ('{"items": [{"sku": "A"}, {"sku": "B"}]}', None, "B", "$.items[*].sku", True),
    ('{"p": {"items": [{"sku": "A"}, {"sku": "B"}]}}', None, "B", "$..sku", True),
    ('{"p": {"sku": 7}}', "8", "8", "$..sku", False),
    ('{"p": "sku', "p", "p", "$..sku", False),
    ("<o><id>7</id></o>", None, "7", "/o/id", True),
    ("<o><id>7</id></o>", "7", "7", "/o/other", False),
    ("<o><id>7</id>", "7", "7", "/o/id", False),
    ("<o><id>7</id><id>8</id></o>", None, "2", "count(/o/id)", True),
    ("<o><id>7</id></o>", "7", "7", "/o[", False),
    ("plain 7", None, "7", "$.id", True),
    (None, "7", "7", "$.id", True),
    ("anything 7", None, "7", None, True),
    ("anything 7", None, "7", "  ", True),
]


def test_match_path(spark):
    rows = [(i, value, key) for i, (value, key, *_) in enumerate(PATH_CASES)]
    frame = spark.createDataFrame(rows, "i INT, value STRING, key STRING")
    tests = [ts.match_path("value", expected, path=path).alias(f"c{i}") for i, (_, _, expected, path, _) in enumerate(PATH_CASES)]
    got = frame.select("i", *tests).orderBy("i").collect()
    assert [row[f"c{row['i']}"] for row in got] == [hit for *_, hit in PATH_CASES]


@pytest.mark.parametrize("path", ["$.items[?(@.sku == 'A')]", "$..", "$..*", "$.items.size()", "$.items[a]"])
def test_match_path_refuses_other_steps(spark, path):
    with pytest.raises(ValueError):
        ts.match_path("value", "x", path=path)


JSON_TEXT = '{"d": {"k": 1, "z": "é"}, "l": [1, 2, 3], "m": [{"q": 7}, {"q": null}], "\\u0061b": 5}'
JSON_PATHS = [
    ("$.d.*", '[1,"é"]'), ("$.l[-1]", "3"), ("$.l[-4]", None), ("$.l[0:2]", "[1,2]"), ("$.l[1:]", "[2,3]"), ("$.l[0,2]", "[1,3]"),
    ("$.l.length()", "3"), ("$.d.length()", "2"), ("$..q", "[7,null]"), ("$.m[-1].q", None), ("$.m[0:1].q", "[7]"), ("$.d.k", "1"),
    ("$.none[-1]", None), ("$..ab", "[5]"), ("/d/k", None),
]


def test_json_paths(spark):
    for path, expected in JSON_PATHS:
        assert evaluate(spark, [JSON_TEXT, "{broken", None], json_text("value", path)) == [expected, None, None], path


@pytest.mark.parametrize(
    "value, warning, critical, error, status",
    [
        (1.0, 5.0, 8.0, None, "green"),
        (5.0, 5.0, 8.0, None, "amber"),
        (8.0, 5.0, 8.0, None, "red"),
        (8.0, None, None, None, "green"),
        (None, 5.0, 8.0, None, "unknown"),
        (1.0, 5.0, 8.0, "failed", "red"),
    ],
)
def test_metric_status(spark, value, warning, critical, error, status):
    frame = spark.createDataFrame([(value, warning, critical, error)], "v DOUBLE, w DOUBLE, c DOUBLE, e STRING")
    assert frame.select(ts.metric_status("v", "w", "c", "e")).first()[0] == status


@pytest.mark.parametrize("size, topic, state", [(0, "a.DLT", "Empty"), (1, "a.DLT", "DLT"), (1, "a", "Healthy")])
def test_topic_state(spark, size, topic, state):
    assert spark.range(1).select(ts.topic_state(F.lit(size), F.lit(topic))).first()[0] == state
