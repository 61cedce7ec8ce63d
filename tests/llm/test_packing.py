import random
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lakequill.llm import packing as P
from tests.llm.fixtures import awkward_texts, docs, empty


def test_parts_give_the_ids_of_whole_texts():
    e = P.Encoder(P.default_vocabulary())
    assert e.parted
    rng = random.Random(1)
    low = [chr(c) for c in range(0x250)]
    texts = [t for c in low for t in (c, f"a{c}", f"{c}a", f" {c} b", f"{c}{c}", f"1{c}\n", f"\n{c}", f"x {c}  {c}'s")]
    texts += ["".join(rng.choices(low, k=rng.randint(1, 40))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "", "日本 é", " " * 5000 + "x", "z" * 5000]
    assert e(texts) == [x.tobytes() for x in e._ids(texts)]
    assert e.known and e(texts[::-1]) == [x.tobytes() for x in e._ids(texts[::-1])]


def test_new_parts_ask_only_the_model():
    e = P.Encoder(P.default_vocabulary())
    texts = [f"Word{i}'s thé\n\n  {i}, ({i})  \t" + "long" * 20 for i in range(300)]
    want, asked, ids = [x.tobytes() for x in e._ids(texts)], [], e._ids
    e._ids = lambda t: asked.extend(t) or ids(t)
    assert e(texts) == want and not asked
    assert e.known and max(map(len, e.known)) <= P.LONGEST


def test_workers_keep_no_parts_when_a_partition_ends(spark):
    rows = spark.range(400).selectExpr("id as doc_id", "concat('some words ', id, ' of text') as text").repartition(8)
    assert P.token_pieces(rows).count() == 400

    def held(batches):
        for _ in batches:
            pass
        n = [len(e.known) + len(e.before) for e in P._LOADED.values()]
        yield pa.RecordBatch.from_arrays([pa.array([len(n)], pa.int64()), pa.array([sum(n)], pa.int64())], ["encoders", "parts"])

    # idle workers take turns: so many tasks meet all of them
    got = spark.range(0, 256, 1, 64).mapInArrow(held, "encoders bigint, parts bigint").groupBy().sum().first()
    assert got[0] and not got[1]


def test_very_long_runs(spark):
    texts = [" " * 1_000_000, "a" * 300_000, "\n" * 200_000 + "x", "!" * 300_000, "7" * 300_000]
    tk = Tokenizer.from_file(P.default_vocabulary())
    want = [len(tk.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    got = P.op5(docs(spark, texts)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == dict(enumerate(want))


def check_bins(counts, patterns, capacity):
    got = np.zeros(capacity + 1, int)
    for p in patterns:
        assert p.times > 0 and sum(p.lengths) <= capacity
        for x in p.lengths:
            got[x] += p.times
    assert (got == counts).all()
    return sum(p.times for p in patterns)


def fewest(sizes, capacity):
    """Exact minimum by search, for a dozen pieces."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best[0]


def test_solver_against_exact_search():
    rng = random.Random(4)
    extra = 0
    for _ in range(150):
        cap = rng.choice([10, 20, 30])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 11))]
        counts = np.bincount(sizes, minlength=cap + 1) if sizes else np.zeros(cap + 1, int)
        n = check_bins(counts, P.solve(counts, cap), cap)
        best = fewest(sizes, cap)
        extra += n - best
        # the reduction must not cost a sequence: what is left needs exactly the rest
        left = counts.astype(np.int64).copy()
        fixed = sum(p.times for p in P.reduce_dominated(left, cap))
        assert fixed + fewest([s for s in range(1, cap + 1) for _ in range(left[s])], cap) == best, sizes
    assert extra <= 6


def test_whole_query(spark):
    texts = awkward_texts() + ["abc def " * 3000, "é" * 1500, "x", "<|endoftext|>", "日本語 " * 900]
    d = docs(spark, texts)
    rows = [r.asDict() for r in P.op5(d).collect()]
    tk = Tokenizer.from_file(P.default_vocabulary())
    tk.encode_special_tokens = True
    by_doc = {k: sorted(v, key=lambda r: r["piece"]) for k, v in groupby(sorted(rows, key=lambda r: r["doc_id"]), key=lambda r: r["doc_id"])}
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = tk.encode(t or "", add_special_tokens=False).ids + [2], 0
        for k, r in enumerate(by_doc[i]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes()))
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
    n = 0
    for _, g in groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at, n = 0, n + 1
        for r in g:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_ranks_from_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_PIECES", 7)
    rows = P.op5(docs(spark, ["a b c"] * 60 + ["x"] * 30)).collect()
    taken = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    ends = {}
    for seq, at, n in taken:
        assert ends.get(seq, 0) == at
        ends[seq] = at + n
    assert len(taken) == 90


def test_repeats_and_empty(spark):
    d = docs(spark, ["a b c"] * 30, [5] * 15 + [None] * 15)
    rows = P.op5(d).collect()
    assert len(rows) == 30 and len({(r.sequence_id, r.offset) for r in rows}) == 30
    assert P.op5(empty(spark)).count() == 0
