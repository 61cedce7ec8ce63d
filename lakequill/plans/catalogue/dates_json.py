"""Dates, times, JSON and table metadata."""

from pyspark.sql import functions as F

from lakequill.functions import dates as D
from lakequill.functions import json as J
from lakequill.operators.tables import lateral_each
from lakequill.plans.registry import query
from lakequill.session import TABLES, table
from lakequill.sources.catalog import register, schema_table, table_info


@query(
    """SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS d, strftime(d + INTERVAL 10 DAY - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS dt,
  strftime(date_trunc('month', d), '%Y-%m-%d') AS sm, strftime(date_trunc('year', d), '%Y-%m-%d') AS sy, strftime(d + INTERVAL 1 MONTH, '%Y-%m-%d') AS fl,
  strftime(make_date(CAST(year(d + INTERVAL 1 MONTH) AS BIGINT), CAST(month(date_trunc('month', d) + INTERVAL 1 MONTH) AS BIGINT), 1) + CAST(day(d) - 1 AS INTEGER), '%Y-%m-%d') AS nm,
  strftime(d + INTERVAL 1 DAY * ((7 - dayofweek(d)) % 7), '%Y-%m-%d') AS sun, epoch_ms(d) // 1000 AS ux, round(epoch_ms(d) / 86400000.0 + 2440587.5, 6) AS jd,
  strftime(d + INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%H:%M:%S') AS tm, strftime(d + INTERVAL 14 MONTH, '%Y-%m') AS sh
FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)"""
)
def dates_shift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = D.of_timestamp(F.col("o_orderdate"))

    def mod(*names):
        out = m
        for n in names:
            out = out.modified(n)
        return out

    return o.select(
        "o_orderkey",
        D.date(m).alias("d"),
        D.datetime(mod("+10 days", "-90 minutes")).alias("dt"),
        D.date(mod("start of month")).alias("sm"),
        D.date(mod("start of year")).alias("sy"),
        D.date(mod("+1 month", "floor")).alias("fl"),
        D.date(mod("+1 month")).alias("nm"),
        D.date(mod("weekday 0")).alias("sun"),
        D.unixepoch(m).alias("ux"),
        F.round(D.julianday(m), 6).alias("jd"),
        D.time(mod("+05:30")).alias("tm"),
        D.strftime("%Y-%m", mod("+0001-02-00", "floor")).alias("sh"),
    )


@query(
    """SELECT event_id, strftime(ts, '%d|%H|%I|%j|%m|%M|%p|%S|%w|%u|%U|%W|%Y|%G|%V|%%') AS a, strftime(ts, '%Y-%m-%d %H:%M') AS b, CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS s,
  strftime(ts, '%H:%M:%S') AS t, CAST(day(ts) AS VARCHAR) AS e, CAST(hour(ts) AS VARCHAR) AS k FROM events"""
)
def strftime_codes(spark, sf_dir):
    m = D.of_timestamp(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        D.strftime("%d|%H|%I|%j|%m|%M|%p|%S|%w|%u|%U|%W|%Y|%G|%V|%%", m).alias("a"),
        D.strftime("%F %R", m).alias("b"),
        D.strftime("%s", m).alias("s"),
        D.strftime("%T", m).alias("t"),
        F.trim(D.strftime("%e", m)).alias("e"),
        F.trim(D.strftime("%k", m)).alias("k"),
    )


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 43200 SECOND, '%Y-%m-%d %H:%M:%S') AS z, epoch_ms(o_orderdate) // 1000 AS u, true AS bad
FROM orders"""
)
def dates_from_text(spark, sf_dir):
    """ISO text with and without a zone, unix seconds and Julian days read back to the same moment."""
    o = table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    julian = seconds / F.lit(86400.0) + 2440587.5
    return o.select(
        "o_orderkey",
        D.date(D.moment(julian, numeric=True)).alias("d"),
        D.datetime(D.moment(F.concat(text, F.lit(" 14:00:00+02:00")))).alias("z"),
        D.unixepoch(D.moment(seconds, "unixepoch", numeric=True)).alias("u"),
        D.date(D.moment(F.concat(F.lit("x"), text))).isNull().alias("bad"),
    )


@query(None)
def timediff_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = D.of_timestamp(F.col("o_orderdate")), D.moment(F.lit("1998-02-28 12:30:00"))
    return o.select("o_orderkey", D.timediff(a, b).alias("diff"))


# --- JSON


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS is_int, json_valid(props) AS ok, CAST(json_array_length('[1,[2],3]') AS BIGINT) AS n,
  '[' || json_extract_string(props, '$.k') || ',null]' AS two, replace(props, ' ', '') AS mini FROM events"""
)
def json_scalars(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        J.arrow_text(p, "k").cast("bigint").alias("k"),
        (J.json_type(p, "$.k") == "integer").alias("is_int"),
        (J.json_valid(p) == 1).alias("ok"),
        J.json_array_length(F.lit("[1,[2],3]")).cast("bigint").alias("n"),
        J.json_extract(p, "$.k", "$.none").alias("two"),
        J.json(p).alias("mini"),
    )


@query(
    """SELECT event_id, '["' || event_type || '",' || event_id || ',null,{"a":1}]' AS arr, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS obj, '"' || event_type || '"' AS q FROM events"""
)
def json_build(spark, sf_dir):
    t, i = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        J.json_array(t, i, F.lit(None).cast("string"), F.lit('{"a":1}'), is_json=(3,)).alias("arr"),
        J.json_object(F.lit("id"), i, F.lit("type"), t).alias("obj"),
        J.json_quote(t).alias("q"),
    )


@query(
    """SELECT event_id, '{"k":' || k || ',"new":"x"}' AS ins, '{"k":' || event_id || '}' AS rep, '{"k":0,"b":[1]}' AS st, '{}' AS rem, '{"k":' || k || ',"t":{"u":1}}' AS pat, '[1,9,2]' AS ai
FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)"""
)
def json_edit(spark, sf_dir):
    p, i = F.col("props"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        J.json_insert(p, "$.k", F.lit(0), "$.new", F.lit("x")).alias("ins"),
        J.json_replace(p, "$.k", i, "$.z", F.lit(1)).alias("rep"),
        J.json_set(p, "$.k", F.lit(0), "$.b", F.lit("[1]"), is_json=(1,)).alias("st"),
        J.json_remove(p, "$.k").alias("rem"),
        J.json_patch(p, F.lit('{"t":{"u":1,"v":null}}')).alias("pat"),
        J.json_array_insert(F.lit("[1,2]"), "$[1]", F.lit(9)).alias("ai"),
    )


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'integer' AS type, '$.k' AS fullkey, '$' AS path FROM events")
def lateral_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return lateral_each(e, F.col("props")).select("event_id", "key", "value", "type", "fullkey", "path")


@query(
    """SELECT n_nationkey, t.* FROM nation, LATERAL (VALUES ('$', 'object', CAST(NULL AS BIGINT)), ('$.n', 'integer', 0), ('$.a', 'array', 0), ('$.a[0]', 'text', 2), ('$.a[1]', 'object', 2), ('$.a[1].x', 'null', 4)) t(fullkey, type, parent)"""
)
def json_tree_walk(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    doc = F.format_string('{"n":%d,"a":["%s",{"x":null}]}', "n_nationkey", "n_name")
    return lateral_each(n, doc, deep=True).select("n_nationkey", "fullkey", "type", "parent")


@query("SELECT event_id, replace(props, ' ', '') AS again FROM events")
def jsonb_round_trip(spark, sf_dir):
    blob = J.jsonb(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", J.json(blob).alias("again"))


@query("SELECT n_nationkey, fullkey, again FROM nation, (VALUES ('$.a', '[1,{\"b\":2}]'), ('$.c', NULL)) v(fullkey, again)")
def jsonb_rows(spark, sf_dir):
    """Containers come as binary JSON and read back to the same text."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    rows = n.withColumn("r", F.explode(J.jsonb_each(F.lit('{"a":[1,{"b":2}],"c":3}'))))
    return rows.select("n_nationkey", "r.fullkey", J.json(F.col("r.blob")).alias("again"))


@query("SELECT n_nationkey, true AS same, true AS near FROM nation")
def dates_now(spark, sf_dir):
    """The current moment is one moment for a whole statement."""
    now = D.of_timestamp(F.current_timestamp())
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", (now.ms == F.unix_millis(F.current_timestamp())).alias("same"), D.date(now).between("2000-01-01", "9999-12-31").alias("near"))


@query("SELECT event_id, '{' || chr(10) || '    \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS pretty, 0 AS fault FROM events")
def json_pretty_print(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", J.json_pretty(p).alias("pretty"), J.json_error_position(p).alias("fault"))


# --- metadata


@query(
    """SELECT table_name AS tbl, CAST(ordinal_position - 1 AS INTEGER) AS cid, column_name AS name,
  CASE WHEN data_type LIKE '%INT%' AND data_type NOT LIKE '%[]' THEN 'INTEGER' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'REAL' WHEN data_type = 'VARCHAR' THEN 'TEXT' ELSE 'NUMERIC' END AS type
FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')"""
)
def metadata_frames(spark, sf_dir):
    names = TABLES[:8]
    register(spark, sf_dir, names)
    out = None
    for t in names:
        part = table_info(spark, t).select(F.lit(t).alias("tbl"), "cid", "name", "type")
        out = part if out is None else out.unionAll(part)
    return out


@query("SELECT 'table' AS type, table_name AS name FROM information_schema.tables WHERE table_name IN ('region', 'nation', 'orders')")
def schema_rows(spark, sf_dir):
    register(spark, sf_dir, ["region", "nation", "orders"])
    return schema_table(spark, ["region", "nation", "orders"]).select("type", "name")


