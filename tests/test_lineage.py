import pytest

import topicspark as ts
from tests.conftest import rows_of

STATEMENTS = [
    ("orders_raw", "table", "CREATE TABLE orders_raw (..) WITH ('connector' = 'kafka', 'topic' = 'shop.orders')"),
    ("no_topic", "table", "CREATE TABLE no_topic (a INT)"),
    ("paid", "view", "CREATE VIEW paid AS\nSELECT * FROM (SELECT * FROM orders_raw) o left join rates r ON true"),
    ("daily", "view", "CREATE VIEW daily AS WITH d AS (SELECT * FROM paid), e(x) AS (SELECT 1) SELECT * FROM d, e, orders_raw AS o"),
    ("deadbeef-1", "job", "insert into sums(a, b) SELECT EXTRACT(hour FROM ts), 'FROM nowhere' FROM paid p, daily"),
    ("deadbeef-2", "job", "INSERT INTO one SELECT * FROM x -- FROM y\n; INSERT INTO two SELECT * FROM x JOIN LATERAL f(x) g ON true"),
    ("idle", "job", "SELECT * FROM orders_raw"),
]


@pytest.fixture(scope="module")
def statements(spark):
    return spark.createDataFrame(STATEMENTS, "id STRING, kind STRING, ddl STRING")


def test_edges(statements):
    assert rows_of(ts.lineage_edges(statements)) == sorted(
        [
            ("topic_shop.orders", "orders_raw", "source"),
            ("orders_raw", "paid", "depends"),
            ("rates", "paid", "depends"),
            ("paid", "daily", "depends"),
            ("orders_raw", "daily", "depends"),
            ("paid", "query_deadbeef-1", "reads"),
            ("daily", "query_deadbeef-1", "reads"),
            ("x", "query_deadbeef-2", "reads"),
            ("query_deadbeef-1", "sums", "writes"),
            ("query_deadbeef-2", "one", "writes"),
            ("query_deadbeef-2", "two", "writes"),
        ],
        key=repr,
    )


def test_known_sources_only(statements):
    edges = rows_of(ts.lineage_edges(statements, known_only=True))
    assert {e[0] for e in edges if e[2] in ("depends", "reads")} == {"orders_raw", "paid", "daily"}


def test_nodes(statements):
    assert rows_of(ts.lineage_nodes(statements)) == sorted(
        [
            ("orders_raw", "orders_raw", "table"),
            ("no_topic", "no_topic", "table"),
            ("topic_shop.orders", "shop.orders", "topic"),
            ("paid", "paid", "view"),
            ("daily", "daily", "view"),
            ("query_deadbeef-1", "INSERT", "query"),
            ("query_deadbeef-2", "INSERT", "query"),
        ],
        key=repr,
    )


@pytest.mark.parametrize(
    ("ddl", "reads", "writes"),
    [
        ("INSERT INTO s SELECT * FROM (SELECT * FROM t1) x, t2", {"t1", "t2"}, {"s"}),
        ("INSERT INTO s SELECT * FROM (SELECT * FROM t1) AS x, t2 y, `t 3` WHERE a = 1", {"t1", "t2", "t 3"}, {"s"}),
        ("insert  into s2 SELECT 1 FROM a", {"a"}, {"s2"}),
        ("INSERT\nINTO TABLE s2 SELECT 1 FROM a", {"a"}, {"s2"}),
        ("INSERT OVERWRITE TABLE `my sink` SELECT 1 FROM `my table` m, db.`b,c` JOIN d ON true", {"my table", "db.b,c", "d"}, {"my sink"}),
        ("INSERT INTO s SELECT sum(a) x, b FROM t GROUP BY f(c), d ORDER BY sum(a) DESC, b", {"t"}, {"s"}),
        ("INSERT INTO s SELECT f(g(a), b), row_number() OVER (PARTITION BY h(x), y) r, z FROM t", {"t"}, {"s"}),
        ("SELECT 'INSERT INTO s' FROM t", set(), set()),
    ],
)
def test_texts(spark, ddl, reads, writes):
    rows = rows_of(ts.lineage_edges(spark.createDataFrame([("j", "job", ddl)], "id STRING, kind STRING, ddl STRING")))
    assert {r[0] for r in rows if r[2] == "reads"} == reads
    assert {r[1] for r in rows if r[2] == "writes"} == writes
