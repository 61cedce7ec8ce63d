import datetime

import duckdb
import pytest

from lakequill.plans.connection import Connection, EngineError


@pytest.fixture(scope="module")
def db(spark):
    return Connection(spark, "/root/testdata/sf0.001")


def run(db, sql, *values, **named):
    return sorted((tuple(r) for r in db.query(sql, *values, **named).collect()), key=repr)


@pytest.mark.parametrize("sql,want", [
    ("SELECT 7/2, -7/2, 7/0, 7%3, 7.0/2, 1<<70, 5 == 5, 0x1F, 1_000", [(3, -3, None, 1, 3.5, 0, True, 31, 1000)]),
    ("SELECT 6*3/4, 2+3*4, -(2-5), 1 || 2, 'a' || NULL", [(4, 14, 3, "12", None)]),
    ("SELECT NULL IS NULL, 1 IS 1, 1 IS NOT NULL, 1 ISNULL, 1 NOTNULL, 2 IS NOT 3, NULL IS DISTINCT FROM 1", [(True, True, True, False, True, True, True)]),
    ("SELECT 'abc' LIKE 'A%', 'abc' GLOB 'a*', 'abc' GLOB 'A*', 'a' NOT LIKE 'b', 1 IN (), 2 NOT IN (1, 3), 5 BETWEEN 1 AND 6", [(True, True, False, True, False, True, True)]),
    ("SELECT substr('hello', -3, 2), substr('hello', 0, 3), length('é'), upper('aé'), trim('xxaxx', 'x'), instr('abc', 'c'), char(65, 66), unicode('A'), typeof(1.5), typeof(NULL)", [("ll", "he", 1, "Aé", "a", 3, "AB", 65, "real", "null")]),
    ("SELECT max(3, 9), min(1, NULL), iif(1 > 2, 'a', 'b'), coalesce(NULL, 4), ifnull(NULL, 5), nullif(1, 1), round(2.5), abs(-3)", [(9, None, "b", 4, 5, None, 3.0, 3)]),
    ("SELECT date('2024-01-31', '+1 month'), strftime('%Y-%j', '2024-03-01'), julianday('2000-01-01 12:00'), unixepoch('1970-01-02'), datetime('2024-05-15', 'start of month', '-1 day')", [("2024-03-02", "2024-061", 2451545.0, 86400, "2024-04-30 00:00:00")]),
    ("SELECT json_extract('{\"a\":[1,2]}', '$.a[1]'), '{\"a\":{\"b\":3}}' -> 'a', '{\"a\":\"t\"}' ->> 'a', json_array(1, 'x', NULL), json_type('[1]'), json_valid('{')", [("2", '{"b":3}', "t", '[1,"x",null]', "array", 0)]),
    ("SELECT printf('%05.1f|%s', 2.25, 'x'), quote('it''s'), hex('a'), CAST('12abc' AS INTEGER), CAST('x' AS REAL), CAST(3.9 AS INTEGER)", [("002.2|x", "'it''s'", "61", 12, 0.0, 3)]),
    ("VALUES (1, 'a'), (2, NULL)", [(1, "a"), (2, None)]),
    ("SELECT column2 FROM (VALUES (1, 'x'), (2, 'y')) WHERE column1 = 2", [("y",)]),
    ("SELECT 2 UNION ALL SELECT 2 INTERSECT SELECT 2", [(2,)]),
    ("SELECT log(100), log(2, 8), ln(0), sqrt(-1), mod(7, 0), pow(2, 3)", [(2.0, 3.0, None, None, None, 8.0)]),
    ("SELECT CASE 3 WHEN 3 THEN 'x' ELSE 'y' END, CASE WHEN 0 THEN 1 ELSE 2 END, NOT 1, 'a' = 'A' COLLATE NOCASE", [("x", 2, False, True)]),
    ("SELECT r_name FROM region ORDER BY r_regionkey LIMIT 1, 2", [("AMERICA",), ("ASIA",)]),
    ("SELECT count(*) FROM region LIMIT -1 OFFSET -5", [(5,)]),
    ("SELECT n_regionkey * 2 AS twice FROM nation WHERE twice > 6 GROUP BY twice", [(8,)]),
    ("SELECT max(n_nationkey), n_name FROM nation", [(24, "NATION_24")]),
    ("SELECT n_regionkey AS r, min(n_nationkey), n_name FROM nation WHERE r < 2 GROUP BY r", [(0, 0, "NATION_0"), (1, 1, "NATION_1")]),
    ("SELECT total(n_nationkey), group_concat(r_name, '|') FROM nation JOIN region ON n_nationkey = r_regionkey WHERE n_nationkey = 1", [(1.0, "AMERICA")]),
    ('SELECT "r_name" AS [the name] FROM region AS "R" INDEXED BY nothing WHERE R.r_regionkey = 1', [("AMERICA",)]),
    ("SELECT (SELECT n_name FROM nation ORDER BY n_nationkey DESC), EXISTS (SELECT 1 FROM region WHERE 0)", [("NATION_24", False)]),
    ("SELECT r_regionkey FROM region WHERE (r_regionkey, 'x') IN (SELECT n_nationkey, 'x' FROM nation WHERE n_nationkey > 2)", [(3,), (4,)]),
    ("WITH a AS MATERIALIZED (SELECT 1 AS x), b(y) AS NOT MATERIALIZED (SELECT x + 1 FROM a) SELECT x, y FROM a, b", [(1, 2)]),
    ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT sum(n) FROM t", [(10,)]),
    ("WITH RECURSIVE t(n) AS (SELECT 1 UNION SELECT (n + 3) % 7 FROM t) SELECT count(*) FROM t", [(7,)]),
    ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t LIMIT 4) SELECT max(n) FROM t", [(4,)]),
    ("SELECT j.key, j.value FROM region, json_each('[5,{\"a\":1}]') j WHERE r_regionkey = 0", [("0", "5"), ("1", '{"a":1}')]),
    ("SELECT n_nationkey, sum(n_nationkey) FILTER (WHERE n_nationkey % 2 = 0) OVER w2 FROM nation WHERE n_nationkey < 3 WINDOW w AS (PARTITION BY 1), w2 AS (w ORDER BY n_nationkey)", [(0, 0), (1, 0), (2, 2)]),
    ("SELECT a.n_nationkey, r_name FROM nation a LEFT JOIN region ON r_regionkey = a.n_nationkey WHERE a.n_nationkey IN (4, 5)", [(4, "MIDDLE EAST"), (5, None)]),
    ("SELECT name FROM pragma_table_info('region')", [("r_name",), ("r_regionkey",)]),
    ("PRAGMA table_info(region)", [(0, "r_regionkey", "INTEGER", 0, None, 0), (1, "r_name", "TEXT", 0, None, 0)]),
    ("PRAGMA no_such_thing", []),
    ("SELECT 1 -- a comment\n /* and another */ + 1", [(2,)]),
])
def test_statements(db, sql, want):
    assert run(db, sql) == sorted(want, key=repr)


@pytest.mark.parametrize("sql,want", [
    ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 130) SELECT count(*), sum(n), max(n) FROM t", [(130, 8515, 130)]),
    ("SELECT c FROM (WITH RECURSIVE x AS (SELECT 1 AS y), t AS (SELECT y AS n FROM x UNION ALL SELECT n + 1 FROM t WHERE n < 130) SELECT count(*) AS c FROM t)", [(130,)]),
    ("WITH RECURSIVE b(m) AS (SELECT 1 UNION SELECT (m + 1) % 3 FROM b), t(n) AS (SELECT m FROM b UNION ALL SELECT n + 10 FROM t WHERE n < 1200) SELECT count(*), max(n) FROM t", [(363, 1202)]),
    ("WITH RECURSIVE a(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM a WHERE n < 120), b(m) AS (SELECT max(n) FROM a UNION SELECT m - 50 FROM b WHERE m > 0) SELECT count(*), min(m) FROM b", [(4, -30)]),
])
def test_deep_recursion_in_any_session(spark, sql, want):
    """The depth is the statement's own: a session with Spark's default limit gives all rows."""
    plain = spark.newSession()
    plain.conf.set("spark.sql.cteRecursionLevelLimit", "100")
    assert run(Connection(plain, "/root/testdata/sf0.001"), sql) == want


@pytest.mark.parametrize("sql,want", [
    ("SELECT r_regionkey, (SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey % 7 DESC, n_name) FROM region", [(0, 20), (1, 6), (2, 12), (3, 13), (4, 19)]),
    ("SELECT r_regionkey, (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey DESC LIMIT 1 OFFSET 1) FROM region", [(0, 15), (1, 16), (2, 17), (3, 18), (4, 19)]),
    ("SELECT r_regionkey, (SELECT n_nationkey + 1 FROM nation AS n WHERE n_regionkey = r_regionkey ORDER BY (n.n_nationkey - 9 - r_regionkey) * (n.n_nationkey - 9 - r_regionkey), 1 DESC LIMIT 1) FROM region", [(0, 11), (1, 12), (2, 13), (3, 14), (4, 15)]),
    ("SELECT r_regionkey, (SELECT n_nationkey % 2 FROM nation WHERE n_regionkey = r_regionkey GROUP BY n_nationkey % 2 ORDER BY count(*), 1) FROM region", [(0, 1), (1, 0), (2, 1), (3, 0), (4, 1)]),
    ("SELECT r_regionkey FROM region WHERE 5 + r_regionkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name DESC LIMIT 1 + 1) AND r_regionkey > 2", [(3,), (4,)]),
    ("SELECT r_regionkey, (SELECT sum(k) FROM (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = r_regionkey ORDER BY -n_nationkey LIMIT 2)) FROM region", [(0, 35), (1, 37), (2, 39), (3, 41), (4, 43)]),
])
def test_order_of_correlated_rows(db, sql, want):
    """Each outer row's own rows are numbered by the order; a sort below an exchange is no order on several machines."""
    plan = db.query(sql)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [row_number()" in line]
    assert windows and all("ASC NULLS" in line or "DESC NULLS" in line for line in windows)
    assert run(db, sql) == sorted(want, key=repr)


_TIED = "PARTITION BY c_nationkey % 3 ORDER BY nullif(c_custkey % 7, 3) NULLS FIRST"
_STRICT = "PARTITION BY c_nationkey % 3 ORDER BY c_custkey % 7, c_custkey"
_KEPT = [
    f"{_TIED} GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING", f"{_TIED} GROUPS BETWEEN 3 PRECEDING AND 1 PRECEDING", f"{_TIED} GROUPS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING", f"{_TIED} GROUPS CURRENT ROW",
    f"{_TIED} GROUPS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING", f"{_TIED} RANGE UNBOUNDED PRECEDING", f"{_TIED} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING",
    f"{_STRICT} ROWS UNBOUNDED PRECEDING", f"{_TIED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", f"{_STRICT} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING",
]
_GATHERED = [f"{_TIED} RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING", f"{_STRICT} ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING"]


@pytest.mark.parametrize("what", ["CURRENT ROW", "GROUP", "TIES"])
@pytest.mark.parametrize("frames,merged", [(_KEPT[:4], True), (_KEPT[4:8], True), (_KEPT[8:], True), (_GATHERED, False)])
def test_exclusions(db, what, frames, merged):
    """Sums, counts and extremes over what a frame keeps are DuckDB's, and no frame is gathered that windows can say."""
    x = "nullif(c_custkey % 10, 4)"
    calls = [f"sum({x})", f"count({x}) FILTER (WHERE c_acctbal > 0)", "count(*)", f"min({x})", "max(c_acctbal)", "avg(c_acctbal)", "sum(c_acctbal) FILTER (WHERE c_custkey % 4 = 1)"]
    sql = "SELECT c_custkey, " + ", ".join(f"{c} OVER ({f} EXCLUDE {what}) AS a{i}_{j}" for i, f in enumerate(frames) for j, c in enumerate(calls)) + " FROM customer"
    df = db.query(sql)
    if merged:
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = duckdb.sql(sql.replace("FROM customer", "FROM '/root/testdata/sf0.001/customer.parquet'")).fetchall()
    got = df.collect()
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=lambda r: r[0]), sorted(want, key=lambda r: r[0])):
        assert a == tuple(pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for v in b)


def test_exclusions_of_a_large_group(db):
    """20,000 rows in one frame: what is kept is not gathered for each row."""
    rows = "(SELECT o_orderkey * 25 + n_nationkey AS n FROM orders, nation WHERE o_orderkey < 800)"
    frame = "ORDER BY n < 10000 RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE"
    sql = f"SELECT count(*), sum(s), sum(c), max(m) FROM (SELECT sum(n) OVER ({frame} CURRENT ROW) AS s, count(*) OVER ({frame} GROUP) AS c, max(n) OVER ({frame} TIES) AS m FROM {rows})"
    statement, _ = db.prepare(sql)
    assert statement.rows(timeout=120) == [(20000, 199990000 * 19999, 20000 * 10000, 19999)]


def test_parameters_and_lifecycle(db):
    s, rest = db.prepare("SELECT n_name FROM nation WHERE n_nationkey = ?1 OR n_name = :who; SELECT 2")
    assert s.parameters == ["p1", "who"] and rest.strip() == "SELECT 2"
    s.bind(3, who="NATION_4")
    assert sorted(s.rows()) == [("NATION_3",), ("NATION_4",)]
    s.clear_bindings()
    assert s.rows() == []
    s.bind(7)
    assert s.step() and s.column(0) == "NATION_7" and s.columns == [("n_name", "TEXT")]
    with pytest.raises(EngineError):
        s.bind(8)
    s.reset()
    s.bind(8)
    assert s.rows(timeout=60) == [("NATION_8",)]
    s.finalize()
    assert db.prepare("  -- nothing")[0] is None
    assert run(db, "SELECT o_orderdate FROM orders WHERE o_orderkey = ?", 1)[0][0].__class__ is datetime.datetime


@pytest.mark.parametrize("sql,kind", [
    ("INSERT INTO region VALUES (9, 'x')", "unsupported"), ("ATTACH 'x' AS y", "unsupported"), ("PRAGMA user_version = 3", "unsupported"), ("SELECT FROM", "sql"), ("SELECT nope FROM region", "sql"), ("SELECT 1 FROM nowhere", "sql"),
    ("SELECT row_number() FROM region", "sql"), ("SELECT sum(DISTINCT n_nationkey) OVER () FROM nation", "sql"), ("SELECT 'a' COLLATE nothing", "sql"), ("SELECT no_such(1)", "sql"), ("SELECT 'open", "sql"), ("SELECT 1 UNION SELECT 1, 2", "sql"),
])
def test_errors(db, sql, kind):
    with pytest.raises(EngineError) as e:
        db.query(sql).collect()
    assert e.value.kind == kind


def test_limits(db, spark):
    small = Connection(spark, "/root/testdata/sf0.001", max_rows=3, max_sql=60)
    s, _ = small.prepare("SELECT n_name FROM nation")
    with pytest.raises(EngineError) as e:
        s.rows()
    assert e.value.kind == "limit"
    with pytest.raises(EngineError):
        small.prepare("SELECT " + "1 + " * 50 + "1")
    with pytest.raises(EngineError) as e:
        db.query("SELECT 1; SELECT 2")
    assert e.value.kind == "misuse"
