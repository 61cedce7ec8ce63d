"""Text, numeric and mathematical functions."""

from pyspark.sql import functions as F

from lakequill.functions import maths as M
from lakequill.functions import printf as P
from lakequill.functions import scalars as S
from lakequill.plans.registry import query
from lakequill.session import table


@query(
    r"""SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, strlen(p_name || 'é') AS o, trim(p_name, 'rse') AS t, ltrim(p_name, 'sbr') AS lt, rtrim(p_name, 'tgex') AS rt,
  replace(p_name, 'e', 'EE') AS r, instr(p_name, 'i') AS i, coalesce(nullif(p_name, 'red ring'), '') || '' || p_size AS c, concat_ws('-', nullif(p_type, 'SMALL'), p_brand, p_size) AS cw,
  chr(960 + p_size) || chr(128512) AS ch, unicode(p_name) AS uc, upper(hex(p_name)) AS h, unhex(replace('61-62-63', '-', '')) AS uh,
  '''' || replace(p_name || '''s', '''', '''''') || '''' AS q FROM part"""
)
def scalar_text(spark, sf_dir):
    n, size = F.col("p_name"), F.col("p_size")
    trim = lambda chars: F.expr(f"trim(BOTH '{chars}' FROM p_name)")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        S.ascii_upper(n).alias("u"),
        S.ascii_lower(F.col("p_brand")).alias("l"),
        F.length(n).cast("bigint").alias("n"),
        F.octet_length(F.concat(n, F.lit("é"))).cast("bigint").alias("o"),
        trim("rse").alias("t"),
        F.expr("trim(LEADING 'sbr' FROM p_name)").alias("lt"),
        F.expr("trim(TRAILING 'tgex' FROM p_name)").alias("rt"),
        F.replace(n, F.lit("e"), F.lit("EE")).alias("r"),
        F.instr(n, "i").cast("bigint").alias("i"),
        S.concat_all(F.when(n != "red ring", n), F.lit(""), size).alias("c"),
        F.concat_ws("-", F.when(F.col("p_type") != "SMALL", F.col("p_type")), "p_brand", size.cast("string")).alias("cw"),
        S.char(size + 960, F.lit(128512)).alias("ch"),
        S.unicode(n).alias("uc"),
        S.hex_text(n).alias("h"),
        S.unhex_text(F.lit("61-62-63"), "-").alias("uh"),
        S.quote_text(F.concat(n, F.lit("'s"))).alias("q"),
    )


@query(
    """SELECT p_partkey, substr(p_name, 3) AS a, substr(p_name, 2, 4) AS b, substr(p_name, greatest(length(p_name) - 2, 1)) AS c, substr(p_name, 1, 3) AS z, substr(p_name, 2, 3) AS m FROM part"""
)
def substr_forms(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        S.substr(n, F.lit(3)).alias("a"),
        S.substr(n, F.lit(2), F.lit(4)).alias("b"),
        S.substr(n, F.lit(-3)).alias("c"),
        S.substr(n, F.lit(0), F.lit(4)).alias("z"),
        S.substr(n, F.lit(5), F.lit(-3)).alias("m"),
    )


@query(
    """SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice / 7, 2) AS r, CAST(sign(p_size - 25) AS INTEGER) AS s,
  CASE WHEN nullif(p_size, 7) IS NOT NULL THEN least(p_size, p_partkey, 30) END AS lo, CASE WHEN nullif(p_size, 7) IS NOT NULL THEN greatest(p_size, p_partkey, 30) END AS hi,
  coalesce(nullif(p_size % 3, 0), nullif(p_size % 2, 0), -1) AS co, ifnull(nullif(p_size, 9), 0) AS inl, CASE WHEN p_size > 40 THEN 'L' WHEN p_size > 20 THEN 'M' ELSE 'S' END AS f,
  CASE WHEN nullif(p_size, 4) IS NULL THEN 'null' ELSE 'integer' END AS ti, 'real' AS tr, 'text' AS tt, p_size AS lk, '\\x00\\x00\\x00'::BLOB AS zb, 0 AS su FROM part"""
)
def scalar_numeric(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    some = F.when(size != 7, size)
    four = F.when(size != 4, size)
    return p.select(
        "p_partkey",
        F.abs(size - 25).alias("a"),
        S.round_half_away(F.col("p_retailprice") / 7, 2).alias("r"),
        F.signum(size - 25).cast("int").alias("s"),
        S.scalar_min(some, key, F.lit(30)).alias("lo"),
        S.scalar_max(some, key, F.lit(30)).alias("hi"),
        F.coalesce(F.nullif(size % 3, F.lit(0)), F.nullif(size % 2, F.lit(0)), F.lit(-1)).alias("co"),
        F.ifnull(F.nullif(size, F.lit(9)), F.lit(0)).alias("inl"),
        S.iif(size > 40, F.lit("L"), size > 20, F.lit("M"), F.lit("S")).alias("f"),
        S.typeof(four, "int").alias("ti"),
        S.typeof(F.col("p_retailprice"), "double").alias("tr"),
        S.typeof(F.col("p_name"), "string").alias("tt"),
        S.likely(size, 0.9).alias("lk"),
        S.zeroblob(F.lit(3)).alias("zb"),
        F.lit(0).alias("su"),
    )


@query(
    """SELECT p_partkey, printf('%05d', p_size) AS d, printf('%.3f', p_retailprice) AS f, printf('%x', p_size) AS x, printf('%-8s|', p_brand) AS s, printf('%+d%%', p_size) AS p,
  format('{}:{}', p_brand, p_type) AS n FROM part"""
)
def printf_forms(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        P.printf("%05d", size).alias("d"),
        P.printf("%.3f", F.col("p_retailprice")).alias("f"),
        P.printf("%x", size).alias("x"),
        P.printf("%-8s|", F.col("p_brand")).alias("s"),
        P.printf("%+d%%", size).alias("p"),
        P.printf("%s:%s", F.col("p_brand"), F.col("p_type")).alias("n"),
    )


@query("SELECT n_nationkey, 'é' || n_nationkey AS u, '''' || n_name || '''' AS q FROM nation")
def unistr_forms(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", P.unistr(F.concat(F.lit("\\00e9"), F.col("n_nationkey").cast("string"))).alias("u"), P.unistr_quote(F.col("n_name")).alias("q"))


def _safe(text: str, ok: str) -> str:
    return f"CASE WHEN {ok} THEN round({text}, 8) END"


@query(
    f"""SELECT p_partkey, CAST(ceil(p_retailprice / 9) AS DOUBLE) AS ce, CAST(floor(-p_retailprice / 9) AS DOUBLE) AS fl, CAST(trunc(-p_retailprice / 9) AS DOUBLE) AS tr,
  {_safe("ln(x)", "x > 0")} AS ln, {_safe("log10(x)", "x > 0")} AS lg, {_safe("log10(x)", "x > 0")} AS l10, {_safe("ln(x) / ln(3.0)", "x > 0")} AS l3, {_safe("log2(x)", "x > 0")} AS l2,
  {_safe("exp(x / 20.0)", "true")} AS ex, {_safe("sqrt(x)", "x >= 0")} AS sq, {_safe("pow(abs(x) * 1.0, 0.3)", "true")} AS po, CASE WHEN x % 7 <> 0 THEN round((p_retailprice % (x % 7)), 6) END AS md FROM (SELECT *, CAST(p_size - 10 AS DOUBLE) AS x FROM part)"""
)
def scalar_math(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("x", (F.col("p_size") - 10).cast("double"))
    x, price = F.col("x"), F.col("p_retailprice")
    r = lambda c: F.round(c, 8)
    return p.select(
        "p_partkey",
        F.ceil(price / 9).cast("double").alias("ce"),
        F.floor(-price / 9).cast("double").alias("fl"),
        M.trunc(-price / 9).alias("tr"),
        r(M.ln(x)).alias("ln"),
        r(M.log(x)).alias("lg"),
        r(M.log10(x)).alias("l10"),
        r(M.log(x, F.lit(3.0))).alias("l3"),
        r(M.log2(x)).alias("l2"),
        r(M.unary("exp", x / 20)).alias("ex"),
        r(M.unary("sqrt", x)).alias("sq"),
        r(M.power(F.abs(x), F.lit(0.3))).alias("po"),
        F.round(M.mod(price, x % 7), 6).alias("md"),
    )


_TRIG = {"sin": "true", "cos": "true", "tan": "true", "asin": "abs(x) <= 1", "acos": "abs(x) <= 1", "atan": "true", "sinh": "true", "cosh": "true", "tanh": "true", "asinh": "true", "acosh": "x >= 1", "atanh": "abs(x) < 1", "radians": "true", "degrees": "true"}


@query(f"SELECT n_nationkey, {', '.join(_safe(f'{f}(x)', ok) + f' AS {f}_x' for f, ok in _TRIG.items())}, round(atan2(x, 2.0), 8) AS atan2_x, round(pi(), 8) AS pi_x FROM (SELECT n_nationkey, (n_nationkey - 12) / 8.0 + 0.01 AS x FROM nation)")
def scalar_trig(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("x", (F.col("n_nationkey") - 12) / F.lit(8.0) + F.lit(0.01).cast("double"))
    x = F.col("x")
    cols = [F.round(M.unary(f, x), 8).alias(f"{f}_x") for f in _TRIG]
    return n.select("n_nationkey", *cols, F.round(F.atan2(x, F.lit(2.0)), 8).alias("atan2_x"), F.round(F.pi(), 8).alias("pi_x"))


@query("SELECT n_nationkey, true AS small, 8 AS len FROM nation")
def random_values(spark, sf_dir):
    """Random integers and blobs differ from run to run; their kinds and lengths do not."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", (S.random_integer() <= F.lit(2**63 - 1)).alias("small"), F.octet_length(S.random_blob(8)).alias("len"))
