"""Joins of every kind."""

from pyspark.sql import functions as F

from lakequill.operators.tables import banded_join
from lakequill.plans.registry import query, sql_query
from lakequill.session import table

sql_query("cross_small", "nation region", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
sql_query("inner_theta", "nation region", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey > r_regionkey AND n_name > r_name")
sql_query(
    "inner_chain_5",
    "lineitem orders customer nation region",
    """SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY r_name, n_name""",
)
sql_query(
    "left_on_vs_where",
    "customer orders",
    """SELECT 'on' AS kind, c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE c_acctbal > 5000
UNION ALL SELECT 'where', c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000 AND c_acctbal > 5000""",
)
sql_query("right_unmatched", "lineitem supplier", "SELECT s_suppkey, count(l_orderkey) AS n FROM (SELECT * FROM lineitem WHERE l_quantity > 49 AND l_discount = 0.1) l RIGHT JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey")
sql_query("full_equi", "customer supplier", "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9500) c FULL JOIN supplier ON c_nationkey = s_nationkey")
sql_query("full_theta", "nation region", "SELECT n_nationkey, r_regionkey FROM (SELECT * FROM nation WHERE n_name > 'NATION_2') n FULL JOIN region ON n_regionkey < r_regionkey - 2")
sql_query(
    "using_natural",
    "nation customer region",
    """SELECT k, a.n_name, b.n FROM (SELECT n_nationkey AS k, n_name FROM nation WHERE n_name < 'NATION_3') a
FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) b USING (k)
UNION ALL SELECT k, n_name, n FROM (SELECT n_regionkey AS k, n_name FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, CAST(99 AS BIGINT) AS n FROM region WHERE r_name > 'E') y""",
)
sql_query(
    "outer_chain",
    "region nation supplier customer",
    """SELECT r_name, n_name, s_suppkey, c_custkey FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_name > 'NATION_15'
LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 LEFT JOIN customer ON c_custkey = s_suppkey AND c_acctbal > 0""",
)


@query(
    """SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 1 AND 3600000000"""
)
def self_join_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    a = e.where("event_type = 'click'").select("event_id", "user_id", "at")
    b = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    pairs = banded_join(a, b, ["user_id"], "at", "at", 3_600_000_000, 1)
    return pairs.select(F.col("event_id").alias("a_id"), F.col("r_event_id").alias("b_id"))


sql_query(
    "semi_anti",
    "customer orders",
    """SELECT c_custkey, 'semi' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
UNION ALL SELECT c_custkey, 'anti' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT c_custkey, 'notin' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')""",
)
