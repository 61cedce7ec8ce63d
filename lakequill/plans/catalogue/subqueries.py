"""Scalar, correlated and tuple subqueries, common table expressions and recursion."""

from pyspark.sql import functions as F

from lakequill.operators.recursive import fixpoint, queue
from lakequill.plans.registry import query, sql_query
from lakequill.session import table

sql_query(
    "scalar_corr",
    "customer orders",
    """SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done
FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)""",
)
sql_query(
    "scalar_first_row",
    "customer orders",
    """SELECT c_custkey, (SELECT min_by(o_orderkey, struct(-o_totalprice, o_orderkey)) FROM orders WHERE o_custkey = c_custkey) AS k FROM customer""",
    """SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS k FROM customer""",
)
sql_query(
    "exists_in_proj",
    "customer orders",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS has_big,
  c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_acctbal < 0 AS p FROM customer""",
)
sql_query("tuple_in", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, max(l_linenumber) FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey)")
sql_query(
    "tuple_not_in",
    "nation supplier",
    "SELECT n_nationkey, n_regionkey FROM nation WHERE (n_nationkey, n_regionkey) NOT IN (SELECT s_nationkey, CASE WHEN s_acctbal > 5000 THEN s_nationkey % 5 ELSE -1 END FROM supplier)",
)


@query(
    """SELECT r_regionkey, (SELECT count(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (
  SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 + 100 * r.r_regionkey)) AS n FROM region r"""
)
def two_level_corr(spark, sf_dir):
    """A subquery that looks two levels out: joined with its owner's keys, counted, and joined back."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rich = c.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"))
    hit = n.join(rich, n.n_nationkey == rich.c_nationkey).join(r, n.n_regionkey == r.r_regionkey).where("best > 9000 + 100 * r_regionkey")
    counts = hit.groupBy("n_regionkey").count()
    return r.join(counts, r.r_regionkey == counts.n_regionkey, "left").select("r_regionkey", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))


sql_query(
    "derived_order_limit",
    "orders",
    "SELECT o_orderpriority, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500) t GROUP BY o_orderpriority",
)
sql_query(
    "cte_multi",
    "orders customer",
    """WITH spent(k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey), big AS (SELECT * FROM spent WHERE total > 1000000)
SELECT (SELECT count(*) FROM spent) AS all_n, (SELECT count(*) FROM big) AS big_n, (SELECT count(*) FROM big JOIN customer ON c_custkey = k WHERE c_acctbal < 0) AS poor_n""",
)
sql_query(
    "cte_shadowed",
    "nation",
    "WITH a AS (SELECT n_regionkey AS k FROM nation), b AS (WITH a AS (SELECT k + 10 AS k FROM a) SELECT k FROM a) SELECT k, count(*) AS n FROM b GROUP BY k",
)
sql_query(
    "rec_union_all",
    "region",
    "WITH RECURSIVE t(n, s) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 50) SELECT n, s FROM t",
)
sql_query(
    "rec_join_table",
    "nation region",
    """WITH RECURSIVE t(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n_nationkey, depth + 1 FROM t JOIN nation ON n_nationkey = k + n_regionkey WHERE depth < 4 AND n_regionkey > 0)
SELECT depth, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM t GROUP BY depth""",
)
sql_query(
    "rec_two",
    "region",
    """WITH RECURSIVE a(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM a WHERE n < 6), b(m) AS (SELECT 10 UNION ALL SELECT m - 2 FROM b WHERE m > 2)
SELECT n, m, CAST(row_number() OVER (ORDER BY n, m) AS INT) AS rn FROM a LEFT JOIN b ON n = m""",
)


@query("WITH RECURSIVE t(k) AS (SELECT 3 UNION SELECT (k * 7 + n_nationkey) % 25 FROM t JOIN nation ON n_regionkey = k % 5) SELECT k FROM t")
def rec_union_dedup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    seed = spark.createDataFrame([(3,)], "k int")
    step = lambda t: t.join(n, n.n_regionkey == t.k % 5).select(((t.k * 7 + n.n_nationkey) % 25).alias("k"))
    return fixpoint(seed, step)


@query("SELECT k, depth FROM (VALUES (1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 2)) v(k, depth)")
def rec_limit(spark, sf_dir):
    seed = spark.createDataFrame([(1, 0)], "k int, depth int")
    step = lambda t: t.withColumn("k", F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1))).withColumn("depth", F.col("depth") + 1)
    return queue(seed, step, 7).select("k", "depth")


@query("SELECT turn, k FROM (VALUES (2, 2), (3, 4), (4, 8), (5, 9), (6, 5)) v(turn, k)")
def rec_limit_order(spark, sf_dir):
    """Depth first through a binary tree cut at 9, one row passed over."""
    seed = spark.createDataFrame([(1, 0)], "k int, depth int")

    def step(t):
        kids = t.withColumn("k", F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1))).withColumn("depth", F.col("depth") + 1)
        return kids.where("k <= 9")

    return queue(seed, step, 5, 1, [F.desc("depth"), F.col("k")]).select(F.col("_turn").alias("turn"), "k")
