import re

import numpy as np
from pyspark.sql import functions as F

from lakequill.llm import mixing as M
from tests.llm.fixtures import DOCS, awkward_texts, docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights=(3, 1, 2)):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if part[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **part}
        fixed.update({s: 2 * sizes[s] for s in over})


def check(rows, sources):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = fill(sizes) if sum(sizes.values()) else {s: 0 for s in sizes}
    for s in sources:
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for r in mine)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        taken = sum(r.taken for r in mine)
        assert abs(taken - want[s]) <= max([r.size for r in mine], default=0)


def test_awkward(spark):
    d = docs(spark)
    rows = M.op4(d).collect()
    assert sorted(r.doc_id for r in rows) == list(range(d.count()))
    texts = awkward_texts()
    assert all(r.size == len(WORD.findall(texts[r.doc_id] or "")) for r in rows)
    check(rows, {r.source for r in rows})


def test_many_rows_near_target_and_stable(spark):
    rng = np.random.default_rng(1)
    data = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "en", None if i % 9 == 0 else f"s{min(i % 9, 4)}", 0, 0.0, "") for i in range(20000)]
    d = spark.createDataFrame(data, DOCS)
    a = M.op4(d.repartition(7)).collect()
    b = M.op4(d.repartition(3)).collect()
    assert {(r.doc_id, r.taken) for r in a} == {(r.doc_id, r.taken) for r in b}
    check(a, {r.source for r in a})


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(2)
    size, x = rng.integers(1, 50, 40), np.full(40, 0.3)
    total = np.zeros(40)
    for _ in range(3000):
        got = M.pivot(size, x, rng.random(40))
        assert ((got > 0) & (got < 1)).sum() <= 1 and abs((got * size).sum() - (x * size).sum()) < 1e-6
        total += got
    assert abs(total / 3000 - 0.3).max() < 0.05


def test_repeated_rows_and_copies(spark):
    d = docs(spark, ["a b c"] * 40 + ["a b c d"] * 40, [7] * 80)
    out = M.mixed_documents(d)
    assert out.columns == d.columns
    assert out.count() == sum(r.copies for r in M.op4(d).collect())
    assert M.op4(empty(spark)).count() == 0 and M.mixed_documents(empty(spark)).count() == 0


def test_clashing_columns_and_both_joins(spark, monkeypatch):
    names = ["_id", "_size", "_source", "_nth", "copies", "size", "row", "n", "k_size", "k_doc_id", "copy", "target"]
    d = docs(spark, ["a b c"] * 6 + ["a b c d", "x", None] * 3, [7] * 6 + list(range(20, 28)) + [None])
    for c in names:
        d = d.withColumn(c, F.lit(c))
    out = M.mixed_documents(d)
    assert out.columns == d.columns and out.count() == sum(r.copies for r in M.op4(d).collect())
    assert all(r[c] == c for r in out.collect() for c in names)
    one = sorted(map(str, out.collect()))
    monkeypatch.setattr(M, "small_or_shuffled", lambda df: df)
    assert sorted(map(str, M.mixed_documents(d).collect())) == one
    assert sum(r.size for r in M.op4(docs(spark, ["a" * 1_000_000, " " * 1_000_000, "b " * 500_000])).collect()) == 500_001


def test_rows_with_texts_stay_out_of_python(spark):
    texts = [*awkward_texts(), "\x0b a", "\x00\x1f\x85\xa0  \U0001f600\tb\x1c", "\r\n", "x" + " \t" * 3000 + "y"]
    out = M.mixed_documents(docs(spark, texts))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "InPandas" not in plan
    assert {r.doc_id: r.size for r in M.sizes(docs(spark, texts)).collect()} == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
