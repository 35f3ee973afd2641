"""One query per construct of the SQL that reaches topics as text."""

from __future__ import annotations

from collections.abc import Callable

import topicspark as ts
from suite.registry import STEPS, case
from suite.scans import _typed

ORDERS = """(SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status, o_orderpriority AS priority,
  o_totalprice AS amount FROM orders)"""
CUSTOMERS = "(SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer)"
SHIPPED = "(SELECT l_orderkey AS id, count(*) AS lines FROM lineitem GROUP BY l_orderkey)"


def _surface(name: str, sql: str, oracle: str | None = None) -> Callable:
    """The same text for both engines; ``oracle`` where their dialects differ."""
    tables = {"orders": ORDERS, "customers": CUSTOMERS, "shipped": SHIPPED}
    topics = {"orders": STEPS[0], "customers": "shop.customers", "shipped": STEPS[1]}
    text = oracle or sql
    for table, source in tables.items():
        text = text.replace("{" + table + "}", source)

    @case(name, text)
    def query(spark, sf_dir):
        frames = {t: _typed(spark, sf_dir, topic) for t, topic in topics.items() if "{" + t + "}" in sql}
        return ts.run_sql(spark, sql, None, **frames)

    return query


_surface(
    "sql_left_join",
    """SELECT o.id, s.lines FROM {orders} o LEFT JOIN {shipped} s ON o.id = s.id""",
)
_surface(
    "sql_full_join",
    """SELECT o.id AS placed, s.id AS shipped FROM (SELECT id FROM {orders} WHERE status = 'F') o
    FULL OUTER JOIN (SELECT id FROM {shipped} WHERE lines > 3) s ON o.id = s.id""",
)
_surface(
    "sql_semi_join",
    """SELECT customer_id, name FROM {customers} c WHERE EXISTS
    (SELECT 1 FROM {orders} o WHERE o.customer_id = c.customer_id AND o.amount > 400000)""",
)
_surface(
    "sql_anti_join",
    """SELECT id FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {shipped} s WHERE s.id = o.id)""",
)
_surface(
    "sql_set_operations",
    """(SELECT id FROM {orders} WHERE status = 'F' INTERSECT SELECT id FROM {shipped} WHERE lines >= 2)
    EXCEPT SELECT id FROM {orders} WHERE priority = '5-LOW' UNION ALL SELECT id FROM {shipped} WHERE lines > 6""",
)
_surface(
    "sql_grouping_sets",
    """SELECT status, priority, COUNT(*) AS n, GROUPING(status) AS no_status FROM {orders}
    GROUP BY GROUPING SETS ((status), (priority), ())""",
    """SELECT status, priority, COUNT(*) AS n, CAST(GROUPING(status) AS TINYINT) AS no_status FROM {orders}
    GROUP BY GROUPING SETS ((status), (priority), ())""",
)
_surface("sql_cube", "SELECT status, priority, COUNT(*) AS n FROM {orders} GROUP BY CUBE (status, priority)")
_surface("sql_rollup", "SELECT status, priority, COUNT(*) AS n FROM {orders} GROUP BY ROLLUP (status, priority)")
_surface(
    "sql_count_distinct",
    """SELECT status, COUNT(DISTINCT customer_id) AS customers, COUNT(*) AS n FROM {orders} GROUP BY status
    HAVING COUNT(*) > 1""",
)
_surface(
    "sql_over_window",
    """SELECT id, customer_id, LAG(id) OVER (PARTITION BY customer_id ORDER BY id) AS before,
    COUNT(*) OVER (PARTITION BY customer_id ORDER BY id) AS so_far FROM {orders}""",
)
_surface(
    "sql_top_n",
    """SELECT segment, name, amount FROM (SELECT c.segment, c.name, o.id, o.amount, ROW_NUMBER() OVER
    (PARTITION BY c.segment ORDER BY o.amount DESC, o.id) AS place FROM {orders} o
    JOIN {customers} c ON o.customer_id = c.customer_id) ranked WHERE place <= 5""",
)
_surface(
    "sql_subqueries",
    """WITH totals AS (SELECT customer_id, SUM(amount) AS total FROM {orders} GROUP BY customer_id)
    SELECT customer_id, ROUND(total, 2) AS total FROM totals WHERE total > (SELECT 1.5 * AVG(total) FROM totals)""",
)
_surface(
    "sql_functions",
    """SELECT id, UPPER(status) AS s, SUBSTRING(priority, 3) AS p, ABS(id - 100) AS a, CASE WHEN amount > 250000 THEN 'big'
    ELSE 'small' END AS size, COALESCE(NULLIF(status, 'F'), '-') AS c, CHAR_LENGTH(priority) AS n FROM {orders}
    WHERE priority LIKE '%HIGH%' OR status <> 'O'""",
    """SELECT id, UPPER(status) AS s, SUBSTRING(priority, 3) AS p, ABS(id - 100) AS a, CASE WHEN amount > 250000 THEN 'big'
    ELSE 'small' END AS size, COALESCE(NULLIF(status, 'F'), '-') AS c, CAST(LENGTH(priority) AS INTEGER) AS n FROM {orders}
    WHERE priority LIKE '%HIGH%' OR status <> 'O'""",
)
_surface(
    "sql_arrays_maps",
    """SELECT id, element_at(split(priority, '-'), 2) AS word, map('s', status)['s'] AS s, size(array(id, customer_id)) AS n
    FROM {orders}""",
    """SELECT id, split_part(priority, '-', 2) AS word, status AS s, CAST(2 AS INTEGER) AS n FROM {orders}""",
)
_surface(
    "sql_order_limit",
    "SELECT id, amount FROM {orders} ORDER BY amount DESC, id LIMIT 20",
)
