"""Window functions and frames."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakequill.functions import json_codec
from lakequill.operators import windows as W
from lakequill.plans.registry import query, sql_query
from lakequill.session import table

_RANKS = """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER r AS rk, dense_rank() OVER r AS dr,
  round(percent_rank() OVER r, 6) AS pr, round(cume_dist() OVER r, 6) AS cd, ntile(4) OVER w AS nt
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), r AS (PARTITION BY o_orderpriority ORDER BY o_custkey)"""
_BIG = _RANKS
for _name in ("row_number() OVER w", "rank() OVER r", "dense_rank() OVER r", "ntile(4) OVER w"):
    _BIG = _BIG.replace(f" {_name} AS", f" CAST({_name} AS INTEGER) AS")
sql_query("rank_family", "orders", _RANKS, _BIG)
sql_query(
    "lag_lead",
    "events",
    """SELECT event_id, lag(value) OVER w AS p1, lag(value, 2, -1.0) OVER w AS p2, lead(event_id) OVER w AS n1, lead(value, 3) OVER w AS n3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
sql_query(
    "first_last_nth",
    "events",
    """SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS l, nth_value(value, 3) OVER w AS n3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
sql_query(
    "agg_rows_range",
    "events",
    """SELECT event_id, round(sum(value) OVER w, 4) AS run, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c,
  round(sum(value) OVER (PARTITION BY event_type ORDER BY CAST(event_id AS DOUBLE) RANGE BETWEEN 50 PRECEDING AND 25 FOLLOWING), 2) AS band, min(value) OVER w AS lo, max(value) OVER w AS hi
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
sql_query("default_frame_peers", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS n FROM orders")


@query(
    """SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey % 50 GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s,
  count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey % 50 GROUPS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS n FROM orders"""
)
def groups_frame(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    by, order = ["o_orderpriority"], [F.col("o_custkey") % 50]
    one = W.groups_frame(o, by, order, -1, 1, {"s": F.sum("o_custkey")})
    two = W.groups_frame(one, by, order, W.UNBOUNDED_BEFORE, -2, {"n": F.count("*")})
    return two.select("o_orderkey", "s", "n")


_EXCLUDE = " UNION ALL ".join(
    f"""SELECT '{e}' AS kind, n_nationkey, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 2 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {e.upper()}) AS BIGINT) AS s FROM nation"""
    for e in ("no others", "current row", "group", "ties")
)


@query(_EXCLUDE)
def exclude_modes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    out = None
    for e in ("no others", "current row", "group", "ties"):
        fold = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y))
        part = W.excluding(n, ["n_regionkey"], [F.col("n_nationkey") % 2], F.col("n_nationkey").cast("bigint"), fold, e, "s", W.UNBOUNDED_BEFORE, W.UNBOUNDED_AFTER)
        part = part.select(F.lit(e).alias("kind"), "n_nationkey", "s")
        out = part if out is None else out.unionAll(part)
    return out


@query(_EXCLUDE.replace("nation", "orders").replace("n_orderskey", "o_custkey").replace("o_custkey, CAST", "o_orderkey, CAST").replace("n_regionkey", "o_orderpriority").replace("% 2", "% 40"))
def exclude_sums(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    out = None
    for e in ("no others", "current row", "group", "ties"):
        part = W.excluding_sum(o, ["o_orderpriority"], [F.col("o_custkey") % 40], F.col("o_custkey"), e, "s").select(F.lit(e).alias("kind"), "o_orderkey", "s")
        out = part if out is None else out.unionAll(part)
    return out


@query(
    """SELECT event_id, round(sum(value) FILTER (WHERE event_type = 'click') OVER w, 4) AS clicks, count(*) FILTER (WHERE value > 50) OVER w AS big
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def win_filter_named(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.round(W.filtered_over(F.sum, F.col("value"), F.col("event_type") == "click", w), 4).alias("clicks"),
        W.filtered_over(F.count, F.lit(1), F.col("value") > 50, w).alias("big"),
    )


sql_query(
    "win_over_group",
    "orders",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS all_n FROM orders GROUP BY o_orderpriority, o_orderstatus",
)
sql_query(
    "win_several",
    "orders",
    """SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS a, max(o_totalprice) OVER (PARTITION BY o_custkey) AS b, count(*) OVER () AS c FROM orders""",
)
sql_query(
    "win_over_derived",
    "customer orders",
    """SELECT c_nationkey, n, CAST(sum(n) OVER (ORDER BY n DESC, c_nationkey) AS BIGINT) AS run FROM (SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey) t""",
)
sql_query(
    "win_group_concat",
    "nation",
    "SELECT n_nationkey, array_join(collect_list(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), ',') AS names FROM nation",
    "SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS names FROM nation",
)


@query("SELECT n_nationkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || ']' AS keys FROM nation")
def win_json_array(spark, sf_dir):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    keys = F.collect_list("n_nationkey").over(w)
    encode = F.pandas_udf(lambda s: s.map(lambda v: json_codec.dump([json_codec.of_sql(int(x)) for x in v])), "string")
    return table(spark, sf_dir, "nation").withColumn("k", keys).select("n_nationkey", encode("k").alias("keys"))


@query("SELECT event_id, lag(value, CAST(event_id % 4 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events")
def lag_row_offset(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return W.lag_by(e, ["user_id"], [F.col("ts"), F.col("event_id")], "value", F.col("event_id") % 4, "v").select("event_id", "v")


@query("SELECT event_id, nth_value(value, 1 + event_id % 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events")
def nth_row_offset(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return W.nth_by(e, ["user_id"], [F.col("ts"), F.col("event_id")], "value", 1 + F.col("event_id") % 5, "v").select("event_id", "v")
