import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakequill.llm import quality_model as Q
from lakequill.llm import toxicity as X
from lakequill.llm.common import table
from tests.llm.fixtures import awkward_texts, docs, empty

LABELS = "doc_id long, quality int, toxic int"


def decoder():
    rng = random.Random(0)
    words = ["stupid", "idiot", "loser", "moron", "people", "letter", "bitter", "the", "this", "that", "pathetic", "book", "good"] * 50
    rng.shuffle(words)
    text = pa.array([" ".join(words)])
    counts = np.zeros(27**3, np.int64)
    for c in X.chunks(text):
        code = np.insert(X._CODE[c.buf], c.offs, 0)
        counts += np.bincount(code[:-2] * 729 + code[1:-1] * 27 + code[2:], minlength=27**3)
    return X.Decoder(X.log_model(counts))


@pytest.mark.parametrize("noisy,plain", [("st00pid", "stoopid"), ("1d10t", "idiot"), ("$tup1d", "stupid"), ("l0ser!", "loser!"), ("stuuuupid", "stupid"), ("gooooood", "good"), ("m o r o n", "moron"), ("i-d-i-o-t", "idiot"), ("l.0.s.e.r", "loser"), ("pa7het1c", "pathetic"), ("mor*on", "moron"), ("m o r o n t h a t", "moron that"), ("t.h.e.l.0.s.e.r.t.h.i.s", "the loser this")])
def test_decoder_restores(noisy, plain):
    assert decoder().restore(f"you {noisy} there")[0] == f"you {plain} there"


def test_decoder_against_exhaustive_search():
    d, rng = decoder(), random.Random(7)

    def best(places):
        scores = []
        for choice in itertools.product(*places):
            word, s = "".join(x for x, _ in choice), sum(c for _, c in choice)
            code = [0, 0] + [0 if c == " " else ord(c) - 96 for c in word] + [0]
            scores.append(s + sum(d.model[a][b][c] for a, b, c in zip(code, code[1:], code[2:])))
        return max(scores)

    for _ in range(400):
        token = "".join(rng.choice("stupidolemr013457$@!|+*aa") for _ in range(rng.randint(1, 6)))
        for places in (d.lattice(token), d.spaced_lattice(token)):
            word, score = d.decode(places)
            assert abs(score - best(places)) < 1e-9, token
            assert score <= best(places) + 1e-9 and set(word) <= set("abcdefghijklmnopqrstuvwxyz ")


def test_clean_text_is_left_alone():
    d = decoder()
    for t in ("people letter bitter", "2024 was 99% good", "I a m", "", "naïve é 3.14", "call (499) 555-6503"):
        assert d.restore(t) == (t, 0), t
    texts = ["people", "b00k", "x a b c d", "sooo", "ok", "", "a*b", "12 34"]
    c = next(X.chunks(pa.array(texts)))
    assert X.suspicious_rows(c).tolist() == [False, True, True, True, False, False, True, False]


def accuracy(rows, marks, mod, rest):
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
    hit = sum(r.predicted for r in held if marks[r.doc_id]) / max(1, sum(marks[r.doc_id] for r in held))
    false = sum(r.predicted for r in held if not marks[r.doc_id]) / max(1, sum(not marks[r.doc_id] for r in held))
    return hit, false


def test_toxicity_on_held_out_rows(spark):
    d, l = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = X.op1(d, l).collect()
    marks = {r.doc_id: r.toxic for r in l.collect()}
    hit, false = accuracy(rows, marks, 4, 2)
    assert len(rows) == d.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert hit > 0.85 and false < 0.03, (hit, false)


def test_obfuscated_words_score_like_plain_ones(spark):
    d, l = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = X.fit(d, l)
    plain = "The heed stupid of reorouha erth, idiot and that moron in the pathetic tion"
    noisy = "The heed stuuupid of reorouha erth, 1d1ot and that m o r o n in the p4thetic tion"
    clean = "The heed of reorouha erth, and that in the tion"
    got = {r.doc_id: r for r in X.score(docs(spark, [plain, noisy, clean], [1, 2, 3]), model, keep_text=True).collect()}
    assert got[1].score > 0.5 and got[2].score > 0.5 and got[3].score < 0.3, got
    assert got[2].n_restored >= 3 and "moron" in got[2].restored


def test_quality_on_held_out_rows(spark):
    d, l = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = Q.op7(d, l).collect()
    marks = {r.doc_id: r.quality for r in l.collect()}
    hit, false = accuracy(rows, marks, 3, 1)
    assert len(rows) == d.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert hit > 0.97 and false < 0.12, (hit, false)


def test_gradients():
    rng = np.random.default_rng(1)
    x, each, y = rng.normal(0, 1, (9, 5)), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])
    m = Q.train(x, each, y, hidden=3, gate=2, steps=1)
    m.parts = {k: np.array(v, np.float64) for k, v in m.parts.items()}

    def loss():
        p = m.forward(x, each)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = Q._gradients(m.parts, m.forward(x, each), each, y, 0.0)
    for k, v in m.parts.items():
        flat = v.reshape(-1)
        for i in range(len(flat)):
            old, eps = flat[i], 1e-6
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2 / eps - np.asarray(g[k]).reshape(-1)[i]) < 1e-6, k


@pytest.mark.parametrize("op", [X.op1, Q.op7])
def test_awkward_rows(spark, op):
    d = docs(spark)
    for rows in ([], [(0, 1, 1), (1, 0, 0), (1, 1, 1), (None, 1, 1), (2, None, None)], [(i, i % 2, i % 2) for i in range(30)]):
        got = op(d, spark.createDataFrame(rows, LABELS)).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(awkward_texts())))
        assert all(0 <= r.score <= 1 for r in got)
        assert op(empty(spark), spark.createDataFrame(rows, LABELS)).count() == 0
    twice = docs(spark, ["a b", None, "a b", ""], [1, 1, None, None])
    got = op(twice, spark.createDataFrame([(1, 1, 0)], LABELS)).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) <= 2


def test_prefilter_leaves_out_no_token():
    decoder = X.Decoder(X.log_model(np.ones(27**3, np.int64)))
    decoded = []
    decode = decoder.decode
    decoder.decode = lambda places: decoded.append(places) or decode(places)
    rng = random.Random(4)
    texts = ["dumba$$", "what a dumba$$.", "dumba$$ here", "a2$", "abc!5", "b6@4", "plain words!", "455", "@$$", "x", "", "é$ a"]
    texts += ["".join(rng.choice("abAZ0245$@!|+* ._-,é\n") for _ in range(rng.randint(0, 9))) for _ in range(20000)]
    flags = np.concatenate([X.suspicious_rows(c) for c in X.chunks(pa.array(texts))])
    assert len(flags) == len(texts) and list(flags[:6]) == [True] * 6 and not flags[6:8].any()
    for text, flag in zip(texts, flags):
        decoded.clear()
        decoder.restore_token.cache_clear()
        if decoder.restore(text)[1] or decoded:
            assert flag, text


def test_training_holds_a_bounded_number_of_passages(spark, monkeypatch):
    d = docs(spark, [("w " * 120 + f"x{i}") if i % 2 else "# | # " * 60 for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS)
    seen, train = [], Q.train
    monkeypatch.setattr(Q, "train", lambda x, each, y: seen.append(int(each.sum())) or train(x, each, y))
    monkeypatch.setattr(Q, "SAMPLE_PASSAGES", 30)
    assert len(Q.op7(d, labels).collect()) == 40 and 0 < seen[0] <= 30


def test_lowest_bounds_rows(spark):
    from pyspark.sql import functions as F

    from lakequill.llm.common import lowest

    d = spark.range(5000)
    got = {r.id for r in lowest(d, F.xxhash64("id"), 700).collect()}
    want = {r.id for r in d.orderBy(F.xxhash64("id")).limit(700).collect()}
    assert got == want and lowest(d, F.xxhash64("id"), 5000).count() == 5000


@pytest.mark.parametrize("op", [X.op1, Q.op7])
def test_very_long_words_and_blanks(spark, op):
    d = docs(spark, ["a" * 1_000_000, " " * 1_000_000, "$" * 300_000, "x1" * 200_000, "a b " * 200_000])
    got = op(d, spark.createDataFrame([(0, 1, 1), (1, 0, 0)], LABELS)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
