"""Statements given as SQL text to a connection."""

from lakequill.plans.connection import Connection
from lakequill.plans.registry import ORACLES, QUERIES, query


def text_query(name: str, text: str, oracle: str, *values) -> None:
    """Register a statement in the engine's own dialect, with its twin."""

    def run(spark, sf_dir):
        return Connection(spark, sf_dir).query(text, *values)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle


text_query(
    "text_division",
    "SELECT o_orderkey, o_custkey / 7 AS q, o_custkey / (o_custkey % 3) AS z, o_totalprice / 4 AS r, o_custkey % 10 == 3 AS e, o_custkey & 0x0F AS h FROM orders",
    "SELECT o_orderkey, o_custkey // 7 AS q, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey // (o_custkey % 3) END AS z, o_totalprice / 4 AS r, o_custkey % 10 = 3 AS e, o_custkey & 15 AS h FROM orders",
)
text_query(
    "text_bare_max",
    "SELECT c_nationkey AS k, max(c_custkey) AS top, c_name, c_acctbal FROM customer GROUP BY k",
    "SELECT c_nationkey AS k, max(c_custkey) AS top, arg_max(c_name, c_custkey) AS c_name, arg_max(c_acctbal, c_custkey) AS c_acctbal FROM customer GROUP BY 1",
)
text_query(
    "text_alias_where",
    "SELECT p_partkey, p_size * 2 AS twice FROM part WHERE twice > 90 AND p_name GLOB '*[gt]' AND p_brand LIKE 'BRAND#1_' ORDER BY twice DESC, 1 LIMIT 5, 20",
    "SELECT p_partkey, p_size * 2 AS twice FROM part WHERE p_size * 2 > 90 AND regexp_full_match(p_name, '.*[gt]') AND p_brand LIKE 'Brand#1_' ORDER BY twice DESC, 1 LIMIT 20 OFFSET 5",
)
text_query(
    "text_recursive_union",
    "WITH RECURSIVE t(k) AS (SELECT 3 UNION SELECT (k * 7 + n_nationkey) % 25 FROM t JOIN nation ON n_regionkey = k % 5) SELECT k, n_name FROM t LEFT JOIN nation ON n_nationkey = k",
    "WITH RECURSIVE t(k) AS (SELECT 3 UNION SELECT (k * 7 + n_nationkey) % 25 FROM t JOIN nation ON n_regionkey = k % 5) SELECT CAST(k AS BIGINT) AS k, n_name FROM t LEFT JOIN nation ON n_nationkey = k",
)
text_query(
    "text_left_associative",
    "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region INTERSECT SELECT 2 UNION SELECT 7 EXCEPT SELECT 1",
    "SELECT * FROM (VALUES (2), (7)) v(k)",
)
text_query(
    "text_windows",
    "SELECT o_orderkey, sum(o_custkey) FILTER (WHERE o_orderstatus = 'F') OVER w2 AS s, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey), w2 AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "SELECT o_orderkey, CAST(sum(o_custkey) FILTER (WHERE o_orderstatus = 'F') OVER w2 AS BIGINT) AS s, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM orders WINDOW w2 AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
text_query(
    "text_functions",
    "SELECT c_custkey, substr(c_name, -4, 2) AS a, iif(c_acctbal > 0, 'pos', 'neg') AS b, max(c_nationkey, 10) AS c, typeof(c_acctbal) AS d, strftime('%m', '2024-0' || (c_custkey % 9 + 1) || '-15') AS e, json_extract('{\"n\":' || c_custkey || '}', '$.n') AS f, printf('%04d', c_nationkey) AS g FROM customer",
    "SELECT c_custkey, substr(c_name, length(c_name) - 3, 2) AS a, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS b, greatest(c_nationkey, 10) AS c, 'real' AS d, '0' || (c_custkey % 9 + 1) AS e, CAST(c_custkey AS VARCHAR) AS f, printf('%04d', c_nationkey) AS g FROM customer",
)
text_query(
    "text_json_lateral",
    "SELECT event_id, j.fullkey, j.atom FROM events, json_tree(props) AS j WHERE j.type = 'integer' AND events.value > ?1",
    "SELECT event_id, '$.k' AS fullkey, json_extract_string(props, '$.k') AS atom FROM events WHERE value > 50",
    50.0,
)
text_query(
    "text_correlated",
    "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, total(c_acctbal) AS t FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_custkey",
    "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS k, c_acctbal AS t FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
text_query(
    "text_pragma_table",
    "SELECT cid, name, type FROM pragma_table_info('orders') WHERE name <> 'o_orderdate'",
    "SELECT CAST(ordinal_position - 1 AS INTEGER) AS cid, column_name AS name, CASE WHEN data_type LIKE '%INT%' THEN 'INTEGER' WHEN data_type = 'DOUBLE' THEN 'REAL' ELSE 'TEXT' END AS type FROM information_schema.columns WHERE table_name = 'orders' AND column_name <> 'o_orderdate'",
)
text_query(
    "text_json_groups",
    "SELECT c_nationkey AS k, json_group_array(c_custkey ORDER BY c_custkey) AS a, json_group_object(c_name, json_array(c_custkey, c_mktsegment, NULL) ORDER BY c_custkey) FILTER (WHERE c_acctbal > 0) AS o FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey AS k, '[' || string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) || ']' AS a, '{' || coalesce(string_agg('\"' || c_name || '\":[' || c_custkey || ',\"' || c_mktsegment || '\",null]', ',' ORDER BY c_custkey) FILTER (WHERE c_acctbal > 0), '') || '}' AS o FROM customer GROUP BY c_nationkey",
)
text_query(
    "text_groups_frame",
    "SELECT *, sum(n.n_nationkey) OVER (ORDER BY n_regionkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, count(*) OVER w AS c FROM nation AS n WHERE n_nationkey <> 7 WINDOW w AS (ORDER BY n_regionkey DESC GROUPS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING)",
    "SELECT *, CAST(sum(n_nationkey) OVER (ORDER BY n_regionkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, count(*) OVER (ORDER BY n_regionkey DESC GROUPS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS c FROM nation WHERE n_nationkey <> 7",
)
_FRAMES = {
    "row": "PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW",
    "group": "PARTITION BY c_nationkey ORDER BY c_mktsegment RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP",
    "ties": "PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES",
    "none": "PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE NO OTHERS",
}
_SUMS = "sum(c_custkey) OVER ({frame}) AS s_{name}, count(*) OVER ({frame}) AS n_{name}, max(c_acctbal) OVER ({frame}) AS m_{name}"
_SUMS_TWIN = "CAST(sum(c_custkey) OVER ({frame}) AS BIGINT) AS s_{name}, count(*) OVER ({frame}) AS n_{name}, max(c_acctbal) OVER ({frame}) AS m_{name}"
text_query(
    "text_exclude",
    "SELECT c_custkey, " + ", ".join(_SUMS.format(frame=f, name=n) for n, f in _FRAMES.items()) + " FROM customer",
    "SELECT c_custkey, " + ", ".join(_SUMS_TWIN.format(frame=f, name=n) for n, f in _FRAMES.items()) + " FROM customer",
)
text_query(
    "text_recursive_order",
    "WITH RECURSIVE t(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, depth + 1 FROM t JOIN nation ON (n_nationkey - 1) / 2 = k AND n_nationkey > 0 ORDER BY 2 DESC, k LIMIT 9 OFFSET 2) SELECT k, depth, n_name FROM t JOIN nation ON n_nationkey = k",
    # depth first through the tree in which k has the children 2k + 1 and 2k + 2: places are paths, smaller child first
    "WITH RECURSIVE t(k, depth, place) AS (SELECT 0, 0, '0' UNION ALL SELECT n_nationkey, depth + 1, place || printf('.%02d', n_nationkey) FROM t JOIN nation ON (n_nationkey - 1) // 2 = k AND n_nationkey > 0) SELECT k, depth, n_name FROM (SELECT * FROM t ORDER BY place LIMIT 9 OFFSET 2) JOIN nation ON n_nationkey = k",
)
text_query(
    "text_recursive_arms",
    "WITH RECURSIVE t(k) AS (SELECT 1 UNION SELECT 2 UNION SELECT k + 5 FROM t WHERE k < 20 UNION SELECT n_nationkey FROM t JOIN nation ON n_regionkey = k) SELECT k, count(*) AS n FROM t GROUP BY k",
    "WITH RECURSIVE e(a, b) AS (SELECT k, k + 5 FROM range(0, 20) r(k) UNION SELECT n_regionkey, n_nationkey FROM nation), t(k) AS (SELECT 1 UNION SELECT 2 UNION SELECT b FROM t JOIN e ON a = k) SELECT CAST(k AS BIGINT) AS k, count(*) AS n FROM t GROUP BY k",
)
text_query(
    "text_recursive_deep",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 1500) SELECT count(*) AS c, sum(n) AS s, max(n) AS m FROM t",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 1500) SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS s, max(n) AS m FROM t",
)
text_query(
    "text_glob_columns",
    "SELECT n_name, r_name FROM nation JOIN region ON n_name GLOB '*' || substr(r_name, 1, 1) || '[A-Z]*' AND NOT glob('A*', n_name)",
    "SELECT n_name, r_name FROM nation JOIN region ON regexp_full_match(n_name, '.*' || substr(r_name, 1, 1) || '[A-Z].*') AND n_name NOT LIKE 'A%'",
)
text_query(
    "text_dates",
    "SELECT o_orderkey, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS last, datetime(o_orderdate, '+36 hours', 'weekday 0') AS sunday, strftime('%Y-%j %H:%M', o_orderdate, '-90 minutes') AS code, unixepoch(o_orderdate) AS epoch, julianday(o_orderdate) - julianday('1992-01-01') AS days, date(unixepoch(o_orderdate), 'unixepoch', '+1 year') AS later, date(o_orderkey, '+x') AS none, time('2024-02-29 23:59:59.987', 'subsec', '+1 second') AS fine FROM orders",
    "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS last, strftime(o_orderdate + INTERVAL 36 HOUR + to_days(CAST((7 - dayofweek(o_orderdate + INTERVAL 36 HOUR)) % 7 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS sunday, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%j %H:%M') AS code, CAST(epoch(o_orderdate) AS BIGINT) AS epoch, epoch(o_orderdate) / 86400.0 - 8035 AS days, strftime(CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN o_orderdate + INTERVAL 366 DAY ELSE o_orderdate + INTERVAL 1 YEAR END, '%Y-%m-%d') AS later, CAST(NULL AS VARCHAR) AS none, '00:00:00.987' AS fine FROM orders",
)
text_query(
    "text_hints",
    "WITH a AS MATERIALIZED (SELECT c_custkey AS k FROM customer WHERE likely(c_acctbal > 0)), b AS NOT MATERIALIZED (SELECT o_custkey AS k FROM orders WHERE unlikely(o_totalprice < 50000) OR likelihood(o_orderkey = 1, 0.5)) SELECT k, +k AS same, subtype(json('[1]')) AS j, subtype(k) AS p, changes() AS c FROM a WHERE k IN (SELECT k FROM b)",
    "SELECT c_custkey AS k, c_custkey AS same, 74 AS j, 0 AS p, 0 AS c FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice < 50000 OR o_orderkey = 1)",
)
text_query(
    "text_json_embedded",
    "SELECT event_id, json_set(props, '$.list', json_array(event_id, user_id), '$.text', '[1]') AS s, json_object('id', event_id, 'props', json(props)) AS o FROM events",
    "SELECT event_id, left(replace(props, ' ', ''), length(replace(props, ' ', '')) - 1) || ',\"list\":[' || event_id || ',' || user_id || '],\"text\":\"[1]\"}' AS s, '{\"id\":' || event_id || ',\"props\":' || replace(props, ' ', '') || '}' AS o FROM events",
)


@query("SELECT n_regionkey AS region, string_agg(upper(n_name), ',' ORDER BY n_name) AS names FROM nation WHERE n_nationkey > 3 GROUP BY 1")
def view_nested(spark, sf_dir):
    """A view with its own column names on a view."""
    db = Connection(spark, sf_dir)
    db.define_view("later_nations", "SELECT n_nationkey, n_regionkey, n_name FROM nation WHERE n_nationkey > 3", ["id", "region", "name"])
    db.define_view("named_regions", "SELECT region, group_concat(upper(name) ORDER BY name) AS names FROM later_nations GROUP BY region")
    return db.query("SELECT * FROM named_regions")
