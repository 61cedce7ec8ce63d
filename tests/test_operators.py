import pytest
from pyspark.sql import functions as F

from lakequill.operators import aggregates as A
from lakequill.operators import windows as W
from lakequill.operators.compound import compound, limited
from lakequill.operators.recursive import fixpoint, queue
from lakequill.operators.tables import banded_join, lateral_each, values
from lakequill.sources import catalog
from lakequill.streaming.cursor import Cursor, LimitError


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_values_and_compound(spark):
    v = values(spark, [(2, "a"), (2, None)], ["int", "string"])
    assert v.columns == ["column1", "column2"]
    two = spark.createDataFrame([(2,)], "k int")
    assert rows(compound(two, ("union all", two), ("intersect", two))) == [(2,)]
    assert rows(compound(two, ("union all", two), ("union", two))) == [(2,)]
    assert rows(compound(two, ("except", two), ("union all", two))) == [(2,)]
    with pytest.raises(ValueError):
        compound(two, ("union", v))
    assert limited(spark.range(5), -1, -1).count() == 5 and limited(spark.range(5), 0).count() == 0 and limited(spark.range(5), 2, 4).count() == 1


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "w"), ("b", None, "z")], "g string, v int, t string")
    assert rows(A.with_extreme(df, ["g"], "v", ["t"])) == [("a", 3, "w")]
    assert rows(A.with_extreme(df, ["g"], "v", ["t"], largest=False)) == [("a", 1, "x")]
    assert rows(A.with_extreme(df, ["g"], "t", ["v"])) == [("a", "y", 3), ("b", "z", None)]
    assert df.where("false").agg(A.total(F.col("v"))).first()[0] == 0.0
    assert rows(df.groupBy("g").agg(A.group_concat(F.col("v"), "-", [-F.col("v")]))) == [("a", "3-3-1"), ("b", None)]


def test_windows(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 1, 20), (1, 2, 30), (1, 3, 40), (2, 1, 5)], "p int, k int, v int")
    got = W.groups_frame(df, ["p"], [F.col("k")], -1, 0, {"s": F.sum("v")})
    assert rows(got.select("p", "v", "s")) == [(1, 10, 30), (1, 20, 30), (1, 30, 60), (1, 40, 70), (2, 5, 5)]
    fold = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    for e in ("no others", "current row", "group", "ties"):
        a = W.excluding(df, ["p"], [F.col("k")], F.col("v"), fold, e, "s").select("p", "v", "s")
        b = W.excluding_sum(df, ["p"], [F.col("k")], F.col("v"), e, "s").select("p", "v", F.coalesce("s", F.lit(0)))
        assert rows(a) == rows(b)
    out = W.lag_by(df, ["p"], [F.col("v")], "v", F.col("k") - 2, "x", F.lit(-1))
    assert rows(out.select("v", "x")) == [(5, -1), (10, 20), (20, 30), (30, 30), (40, 30)]
    assert rows(W.nth_by(df, ["p"], [F.col("v")], "v", F.col("k"), "x").select("v", "x")) == [(5, 5), (10, 10), (20, 10), (30, 20), (40, 30)]


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int")
    seed = spark.createDataFrame([(1,)], "k int")
    step = lambda t: t.join(edges, edges.a == t.k).select("b")
    assert rows(fixpoint(seed, step)) == [(1,), (2,), (3,), (4,)]
    with pytest.raises(RuntimeError):
        fixpoint(seed, step, distinct=False, steps=4)
    chain = lambda t: t.where("k < 30").select(F.col("k") + 1)
    assert fixpoint(seed, chain).count() == 30
    assert rows(queue(seed, lambda t: t.select(F.col("k") + 1), 4, 1).select("k")) == [(2,), (3,), (4,)] + [(5,)]
    turns = queue(seed, lambda t: t.where("k < 9").select(F.explode(F.array(F.col("k") * 2, F.col("k") * 3))), 5, 0, [F.desc("k")])
    assert [r.k for r in turns.orderBy("_turn").collect()] == [1, 3, 9, 6, 18]


def test_queue_never_stops_short(spark):
    seed = spark.createDataFrame([(1,)], "k int")
    more = lambda t: t.select(F.col("k") + 1)
    assert rows(queue(seed, more, 36, 1, steps=3).select("k")) == [(k,) for k in range(2, 38)]
    turns = queue(seed, more, 5, 0, [F.col("k")], steps=3)
    assert [r.k for r in turns.orderBy("_turn").collect()] == [1, 2, 3, 4, 5]
    for order in (None, [F.col("k")]):
        with pytest.raises(RuntimeError):
            queue(seed, more, -1, 0, order, steps=3)
        assert queue(seed, lambda t: more(t).where("k < 3"), -1, 0, order, steps=3).count() == 3


def test_band_and_lateral(spark):
    a = spark.createDataFrame([(i, i % 3, i * 1.5) for i in range(60)], "id int, g int, x double")
    got = banded_join(a, a, ["g"], "x", "x", 7.0, -2.0).select("id", "r_id")
    want = a.alias("l").join(a.alias("r"), F.expr("l.g = r.g and r.x - l.x between -2.0 and 7.0")).select("l.id", F.col("r.id").alias("r_id"))
    assert rows(got) == rows(want)
    d = spark.createDataFrame([(1, "[1,2]"), (2, "[]"), (3, None)], "n int, js string")
    assert rows(lateral_each(d, F.col("js")).select("n", "value")) == [(1, "1"), (1, "2")]
    assert lateral_each(d, F.col("js"), outer=True).count() == 4


def test_catalog_and_cursor(spark, sf):
    catalog.register(spark, sf, ["nation", "no_such_table"])
    info = catalog.pragma(spark, "table_info", "nation").collect()
    assert [(r.name, r.type) for r in info] == [("n_nationkey", "INTEGER"), ("n_name", "TEXT"), ("n_regionkey", "INTEGER")]
    assert catalog.pragma(spark, "table_info", "nothing").count() == 0 and catalog.pragma(spark, "user_version") is None
    assert catalog.pragma(spark, "table_xinfo", "nation").columns[-1] == "hidden"
    assert all(catalog.pragma(spark, p, "nation").count() == 0 for p in catalog.EMPTY_PRAGMAS)
    assert "nation" in [r.name for r in catalog.schema_table(spark).collect()]
    assert [catalog.affinity(t) for t in ("VARINT", "NVARCHAR(3)", "BLOB", "DOUBLE", "DECIMAL(3,1)", "", "FLOATING POINT")] == ["INTEGER", "TEXT", "BLOB", "REAL", "NUMERIC", "BLOB", "INTEGER"]
    c = Cursor(spark.table("nation").orderBy("n_nationkey"), max_rows=30)
    assert c.step() and c.column(0) == 0 and len(list(c)) == 24 and not c.step()
    c.reset()
    assert c.step() and c.column(1) == "NATION_0"
    with pytest.raises(LimitError):
        list(Cursor(spark.range(5), max_rows=3))


def test_queue_order_with_ties_and_repeats(spark):
    """Rows that tie leave once each; successors that come before pending rows leave first."""
    import heapq

    def kids(k, depth):
        return [(k * 3 + i, depth + 1) for i in (1, 2, 2) if k * 3 + i < 40]

    def brute(key):
        heap, turn, out = [], 0, []
        heapq.heappush(heap, (key((0, 0)), 0, (0, 0)))
        while heap:
            _, _, row = heapq.heappop(heap)
            out.append(row)
            for r in kids(*row):
                turn += 1
                heapq.heappush(heap, (key(r), turn, r))
        return out

    seed = spark.createDataFrame([(0, 0)], "k int, depth int")

    def step(t):
        k = F.explode(F.array(*[F.col("k") * 3 + i for i in (1, 2, 2)]))
        return t.select(k.alias("k"), (F.col("depth") + 1).alias("depth")).where("k < 40")

    for order, key in (([F.col("depth")], lambda r: r[1]), ([F.col("k")], lambda r: r[0])):
        got = sorted((r._turn, r.k, r.depth) for r in queue(seed, step, -1, 0, order).collect())
        want = brute(key)
        assert [t for t, _, _ in got] == list(range(1, len(want) + 1))
        assert sorted((k, d) for _, k, d in got) == sorted(want)
        assert [key((k, d)) for _, k, d in got] == [key(r) for r in want]
