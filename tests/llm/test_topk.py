import math

import numpy as np
from pyspark.sql import functions as F

from lakequill.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def brute(rows, k=5):
    ok = []
    for n, (i, v, *_) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((n, i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, i, v in ok:
        if i % 50 == 0:
            c = [(-sum(a * b for a, b in zip(v, w)), j) for m, j, w in ok if m != n and len(w) == len(v)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(c)[:k])]
    return sorted(out)


def ask(spark, rows, parts=3):
    d = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.op9(d).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (900, 12)) * rng.lognormal(0, 1, (900, 1))
    x[100:160] = x[100]  # copies tie
    rows = [(i, [float(np.float32(c)) for c in v], 0, 0) for i, v in enumerate(x)]
    rows += [(950, None, 0, 0), (1000, [1.0, None] + [0.0] * 10, 0, 0), (1050, [float("nan")] * 12, 0, 0), (None, [9.0] * 12, 0, 0)]
    rows += [(-50, [0.0] * 12, 0, 0), (1100, [1.0, 2.0], 0, 0), (1101, [3.0, -1.0], 0, 0), (1150, [], 0, 0), (1200, [], 0, 0)]
    assert ask(spark, rows) == brute(rows)


def test_many_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 30)
    monkeypatch.setattr(K, "GROWTH", 3)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in v], 0, 0) for i, v in enumerate(rng.normal(0, 1, (700, 6)))]
    rows += rows[:60]  # repeated rows
    assert ask(spark, rows) == brute(rows)


def test_pairs_of_blocks_out_of_reach_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 20)
    monkeypatch.setattr(K, "GROWTH", 3)
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (1200, 8)) * np.geomspace(8, 0.01, 1200)[:, None]
    rows = [(i, [float(np.float32(c)) for c in v], 0, 0) for i, v in enumerate(x)]
    trace = []
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.exact_topk(d, F.col("vec_id") % 50 == 0, 5, trace).collect())
    assert got == brute(rows)
    there, met = (sum(t[i] for t in trace) for i in (0, 1))
    assert there == 60 and met < 30 and trace[0] == (1, 1), trace


def test_large_components_and_empty(spark):
    rows = [(0, [3e16, 1.0], 0, 0), (1, [2e3, 5.0], 0, 0), (2, [-1e10, 2.0], 0, 0)]
    assert [(q, r, v) for q, r, v, _ in ask(spark, rows)] == [(0, 1, 1), (0, 2, 2)]
    assert K.op9(spark.createDataFrame([], SCHEMA)).count() == 0
    assert K.exact_topk(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 7).count() == 0


def test_long_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in v], 0, 0) for i, v in enumerate(rng.normal(0, 1, (120, 3000)))]
    assert ask(spark, rows) == brute(rows)
