"""Scans, projections, predicates, expression operators, order, limits and set operations."""

from pyspark.sql import functions as F

from lakequill.functions import scalars as S
from lakequill.operators.compound import compound, limited
from lakequill.operators.tables import values
from lakequill.plans.registry import query, sql_query
from lakequill.session import table

sql_query(
    "scan_filter_project",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) AS net
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-03-01 00:00:00' AND l_quantity < 24""",
)
sql_query("key_seek", "orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4217")
sql_query("key_range", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 180 AND o_orderkey <> 150")


@query("SELECT n_name, v.column2 AS tag FROM nation JOIN (VALUES (1, 'one'), (2, 'two'), (7, NULL)) v(column1, column2) ON n_nationkey = v.column1")
def values_no_from(spark, sf_dir):
    v = values(spark, [(1, "one"), (2, "two"), (7, None)], ["int", "string"])
    n = table(spark, sf_dir, "nation")
    return n.join(v, n.n_nationkey == v.column1).select("n_name", v.column2.alias("tag"))


sql_query("select_no_from", "region", "SELECT 1 + 2 AS a, 'x' || 'y' AS b, CAST(NULL AS INT) AS c")
sql_query("distinct_nulls", "lineitem", "SELECT DISTINCT CASE WHEN l_linenumber > 3 THEN l_linenumber END AS n, l_returnflag FROM lineitem")
sql_query(
    "star_expansion",
    "nation region",
    "SELECT r.*, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
)
sql_query(
    "alias_in_where",
    "part",
    "SELECT * FROM (SELECT p_partkey, p_retailprice * 2 AS twice FROM part) t WHERE twice > 2000",
)
sql_query("view_expansion", "customer", "WITH rich AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 5000) SELECT c_nationkey, count(*) AS n FROM rich GROUP BY c_nationkey")


@query(
    """SELECT o_orderkey, o_custkey // 7 AS q, CASE WHEN o_custkey % 5 <> 0 THEN o_orderkey // (o_custkey % 5) END AS qn,
  CASE WHEN o_custkey % 3 <> 0 THEN o_orderkey % (o_custkey % 3) END AS r,
  o_orderkey & 12 AS band, o_orderkey | 3 AS bor, ~o_orderkey AS bnot, CAST(o_orderkey << 3 AS BIGINT) AS shl, o_orderkey >> 2 AS shr
FROM orders"""
)
def arith_div_mod(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        "o_orderkey",
        S.int_divide(c, F.lit(7)).alias("q"),
        S.int_divide(k, c % 5).alias("qn"),
        S.modulo(k, c % 3).alias("r"),
        k.bitwiseAND(F.lit(12)).alias("band"),
        k.bitwiseOR(F.lit(3)).alias("bor"),
        F.bitwise_not(k).alias("bnot"),
        S.shift_left(k, F.lit(3)).alias("shl"),
        S.shift_right(k, F.lit(2)).alias("shr"),
    )


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 2 THEN CAST(9223372036854775800 + n_nationkey AS DOUBLE) ELSE CAST(9223372036854775800 AS DOUBLE) + n_nationkey END AS s FROM nation")
def overflow_to_real(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", S.add(F.lit(9223372036854775800), F.col("n_nationkey").cast("bigint")).alias("s"))


sql_query(
    "three_valued",
    "orders",
    """SELECT o_orderkey, nullif(o_custkey % 4, 0) IS DISTINCT FROM nullif(o_orderkey % 4, 0) AS d,
  nullif(o_custkey % 4, 0) IS NULL AS n, nullif(o_custkey % 4, 0) IN (1, NULL) AS i, nullif(o_custkey % 4, 0) NOT IN (2, 3) AS ni,
  o_totalprice BETWEEN 100000 AND 200000 AS b, NOT (nullif(o_custkey % 4, 0) > 1 AND o_totalprice > 1000) AS t,
  (nullif(o_custkey % 4, 0) > 1) IS TRUE AS ist, (nullif(o_custkey % 4, 0) > 1) IS NOT FALSE AS isnf
FROM orders""",
)


@query(
    """SELECT p_partkey, lower(p_name) LIKE 'r_d %' AS l, regexp_full_match(p_name, '.*[b-r]ed.*[^tx]') AS g, p_brand GLOB 'Brand#1*' AS gp, p_type LIKE 'E%Y' AS e
FROM part WHERE p_name GLOB '?*[a-z] *'"""
)
def like_glob(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(S.glob(F.col("p_name"), "?*[a-z] *"))
    return p.select(
        "p_partkey",
        S.like(F.col("p_name"), "R_d %").alias("l"),
        S.glob(F.col("p_name"), "*[b-r]ed*[^tx]").alias("g"),
        S.glob(F.col("p_brand"), "Brand#1*").alias("gp"),
        S.like(F.col("p_type"), "e%y").alias("e"),
    )


@query(
    r"""SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(substr(p_brand, 7) || p_type, '^\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS i,
  coalesce(TRY_CAST(nullif(regexp_extract(CAST(p_retailprice AS VARCHAR) || ' each', '^\s*([+-]?[0-9]+\.?[0-9]*)', 1), '') AS DOUBLE), 0.0) AS r,
  p_partkey % 2 = 1 AS t FROM part"""
)
def cast_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    price = F.concat(F.col("p_retailprice").cast("string"), F.lit(" each"))
    return p.select(
        "p_partkey",
        S.cast_integer(F.concat(F.substring("p_brand", 7, 20), "p_type")).alias("i"),
        S.cast_real(price).alias("r"),
        S.truth(F.concat((F.col("p_partkey") % 2).cast("string"), F.lit("x"))).alias("t"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_orderkey < 2000 OR (l_orderkey = 2000 AND l_linenumber < 4) AS lt,
  l_orderkey = 2001 AND l_linenumber = nullif(l_linenumber % 3, 0) AS eq
FROM lineitem"""
)
def row_value_cmp(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    row = [F.col("l_orderkey"), F.col("l_linenumber")]
    rest = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") % 3)
    return l.select(*row, S.row_less(row, [F.lit(2000), F.lit(4)]).alias("lt"), S.row_equal(row, [F.lit(2001), rest]).alias("eq"))


sql_query("collate_nocase", "part", "SELECT DISTINCT p_type FROM part WHERE p_type COLLATE UTF8_LCASE = 'ecoNOMY'", "SELECT DISTINCT p_type FROM part WHERE lower(p_type) = 'economy'")
sql_query("literals", "region", "SELECT X'0aFF' AS b, 16 AS h, 1000000 AS u, 1.5e3 AS f, 'it''s' AS s", "SELECT '\\x0A\\xFF'::BLOB AS b, 16 AS h, 1000000 AS u, 1.5e3 AS f, 'it''s' AS s")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 7000.0 AND CAST(NULL AS INT) IS NULL")
def bind_parameters(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return spark.sql("SELECT c_custkey, c_name FROM {c} WHERE c_nationkey = :n AND c_acctbal > :low AND :none IS NULL", args={"n": 3, "low": 7000.0, "none": None}, c=c)


sql_query(
    "case_forms",
    "orders",
    """SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS simple,
  CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS searched, count(*) AS n
FROM orders GROUP BY 1, 2, 3""",
)

# --- order and limits

sql_query("order_nulls_topk", "orders", "SELECT o_orderkey, nullif(o_custkey % 10, 3) AS k FROM orders ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 50")
sql_query("order_unprojected", "customer", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
sql_query("order_expression", "part", "SELECT p_partkey, p_size FROM part ORDER BY p_size % 7 DESC NULLS LAST, 2 ASC NULLS FIRST, 1 LIMIT 40")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey >= 20")
def limit_negative(spark, sf_dir):
    return limited(limited(table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey"), -1, 20), -1, -3)


@query("SELECT n_nationkey FROM nation WHERE false")
def limit_zero(spark, sf_dir):
    return limited(table(spark, sf_dir, "nation").select("n_nationkey"), 0)


# --- set operations


@query("(SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region WHERE r_name < 'M') INTERSECT SELECT r_regionkey FROM region WHERE r_name > 'AN' EXCEPT SELECT 3")
def setops_chain(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return compound(
        n.select(F.col("n_regionkey").alias("k")),
        ("union all", r.where("r_name < 'M'").select("r_regionkey")),
        ("intersect", r.where("r_name > 'AN'").select("r_regionkey")),
        ("except", spark.range(3, 4).select(F.col("id").cast("int"))),
    )


sql_query("union_all", "customer supplier", "SELECT c_nationkey AS k, c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, s_name FROM supplier")
sql_query("union_distinct", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("intersect_rows", "customer supplier", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000 INTERSECT SELECT s_nationkey FROM supplier")
sql_query("except_rows", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
sql_query("compound_order_limit", "customer supplier", "SELECT c_custkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier ORDER BY bal DESC, k LIMIT 15 OFFSET 3")
sql_query("values_arm", "region", "SELECT r_regionkey AS k, r_name AS v FROM region UNION ALL VALUES (10, 'ten'), (11, CAST(NULL AS STRING))", "SELECT r_regionkey AS k, r_name AS v FROM region UNION ALL (VALUES (10, 'ten'), (11, NULL))")
