"""Grouped and ungrouped aggregation."""

from pyspark.sql import functions as F

from lakequill.functions import json as J
from lakequill.operators import aggregates as A
from lakequill.plans.registry import query, sql_query
from lakequill.session import table

sql_query(
    "groupby_having",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
)
sql_query("group_by_alias_ordinal", "orders", "SELECT o_orderpriority AS p, o_totalprice > 200000 AS big, count(*) AS n FROM orders GROUP BY p, 2")


@query(
    """SELECT 'all' AS kind, count(*) AS n, count(nullif(l_linenumber % 4, 0)) AS nn, CAST(sum(l_linenumber) AS BIGINT) AS s, coalesce(sum(CAST(l_quantity AS DOUBLE)), 0.0) AS t, round(avg(l_discount), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem
UNION ALL SELECT 'none', count(*), count(l_linenumber), CAST(sum(l_linenumber) AS BIGINT), coalesce(sum(CAST(l_quantity AS DOUBLE)), 0.0), avg(l_discount), min(l_shipdate), max(l_shipdate) FROM lineitem WHERE false"""
)
def agg_all_basic(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")

    def row(df, kind):
        n = F.when(F.col("l_linenumber") % 4 != 0, 1)
        return df.agg(
            F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count(n).alias("nn"), F.sum("l_linenumber").alias("s"), A.total(F.col("l_quantity")).alias("t"),
            F.round(F.avg("l_discount"), 6).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"),
        )

    return row(l, "all").unionAll(row(l.where("false"), "none"))


sql_query("having_no_group", "lineitem", "SELECT count(*) AS n FROM lineitem HAVING count(*) > 100000000")


@query(
    """SELECT o_custkey, o_totalprice, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1"""
)
def minmax_bare(spark, sf_dir):
    return A.with_extreme(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey", "o_orderdate"], ties=["o_orderkey"])


@query("SELECT n_regionkey, arg_min(n_name, n_nationkey) AS first_name, arg_max(n_name, n_nationkey) AS last_name FROM nation GROUP BY n_regionkey")
def minmax_by(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.bare_of_min(F.col("n_name"), k).alias("first_name"), A.bare_of_max(F.col("n_name"), k).alias("last_name"))


@query(
    """SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names, string_agg(CASE WHEN n_nationkey > 90 THEN n_name END, '|' ORDER BY n_name) AS none, string_agg(n_name, ' - ' ORDER BY n_name) AS dashed
FROM nation GROUP BY n_regionkey"""
)
def concat_ordered(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.groupBy("n_regionkey").agg(
        A.group_concat(F.col("n_name"), ",", [-F.col("n_nationkey")]).alias("names"),
        A.group_concat(F.when(F.col("n_nationkey") > 90, F.col("n_name")), "|", [F.col("n_name")]).alias("none"),
        A.group_concat(F.col("n_name"), " - ", [F.col("n_name")]).alias("dashed"),
    )


sql_query(
    "agg_distinct_filter",
    "lineitem",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines,
  round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS discounted, count(*) FILTER (WHERE l_quantity < 0) AS none
FROM lineitem GROUP BY l_returnflag""",
)


@query(
    """SELECT n_regionkey, '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) || ']' AS names,
  '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_nationkey) || '}' AS keyed,
  '[' || string_agg(CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE 'null' END, ',' ORDER BY n_nationkey) || ']' AS evens
FROM nation GROUP BY n_regionkey"""
)
def json_group(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.groupBy("n_regionkey").agg(
        J.json_group_array(F.col("n_name"), [k]).alias("names"),
        J.json_group_object(F.col("n_name"), k, [k]).alias("keyed"),
        J.json_group_array(F.when(k % 2 == 0, k), [k]).alias("evens"),
    )


sql_query(
    "percentiles",
    "customer",
    """SELECT c_mktsegment, round(median(c_acctbal), 4) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal), 4) AS p90, percentile_disc(0.25) WITHIN GROUP (ORDER BY c_acctbal) AS p25
FROM customer GROUP BY c_mktsegment""",
)
sql_query(
    "nested_aggregate",
    "orders customer",
    """SELECT c_nationkey, max(n) AS most FROM (SELECT c_nationkey, c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey, c_custkey) t GROUP BY c_nationkey""",
)
sql_query(
    "agg_over_compound",
    "customer supplier",
    "SELECT k, count(*) AS n, round(sum(bal), 2) AS total FROM (SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) t GROUP BY k",
)
sql_query("any_value_bare", "nation", "SELECT n_regionkey, any_value(n_regionkey * 2) AS twice, count(*) AS n FROM nation GROUP BY n_regionkey")
