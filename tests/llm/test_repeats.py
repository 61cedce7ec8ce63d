import hashlib
import random
import re

from lakequill.llm import repeats as R
from tests.llm.fixtures import awkward_texts, docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, texts, ids):
    out = R.op2(docs(spark, texts, ids)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str)


def test_awkward_texts(spark):
    texts = awkward_texts()
    ids = [len(texts) - i for i in range(len(texts))]
    assert run(spark, texts, ids) == brute(list(zip(ids, texts)))


def test_shared_passages_small_automata(spark, monkeypatch):
    rng = random.Random(8)
    vocab = ["a", "b", "of", "the", "é"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(10, 60))] for _ in range(12)]
    texts = []
    for _ in range(250):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            words += p[a : a + rng.randint(5, 40)] if rng.random() < 0.6 else [rng.choice(vocab) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 30))]
        texts.append(" ".join(words))
    texts += [texts[3]] * 30
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[5] = ids[6] = ids[7] = None
    ids[8] = ids[9]
    assert run(spark, texts, ids) == brute(list(zip(ids, texts)))


def thue_morse(bits):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << bits))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_cancel_in_linear_hashes(spark):
    tail = " ".join(f"t{i}" for i in range(12))
    texts = [f"{w} {tail}" for bits in (10, 12) for w in thue_morse(bits)]
    assert run(spark, texts, [1, 2, 3, 4]) == brute(list(enumerate(texts, 1)))


def test_words_decide_where_all_hashes_collide(spark, monkeypatch):
    import numpy as np

    # in this process: windows of different words under one hash are told apart
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 4, 0, 1, 2, 3], np.int64)
    monkeypatch.setattr(R, "ngrams", lambda h, k: np.zeros(len(h) - k + 1, np.uint64))
    got = R._groups(ids, np.array([0, 4, 8]), 4)
    assert got[0] == got[2] != got[1]


def test_places_come_from_the_automaton(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (2, "x " + text + " y")]
    assert run(spark, [t for _, t in rows], [1, 2]) == brute(rows)
    whole = R._locate

    def none(b, passages):
        return tuple(x[:0] for x in whole(b, passages))

    monkeypatch.setattr(R, "_locate", none)
    off = {i: gone for i, _, gone, _ in run(spark, [t for _, t in rows], [1, 2])}
    assert off == {1: 0, 2: 0}
    # passages written by hand, not found in any document before, are located too
    import pyarrow as pa

    b = R._Bucket(pa.table({"doc_id": [4, 5], "text": ["a b\tc d", "b c d b c"]}), 2, 1)
    first, last, low = whole(b, {b"b c": 3, b"c d": 4})
    assert sorted(zip(first.tolist(), last.tolist(), low.tolist())) == [(1, 3, 3), (2, 4, 4), (4, 6, 3), (5, 7, 4), (7, 9, 3)]


def test_very_long_words_and_blanks(spark):
    texts = ["a" * 1_000_000, " " * 1_000_000, "\n" * 300_000 + "b" * 500_000, ("x " * 13) + "a" * 1_000_000]
    assert run(spark, texts, [1, 2, 3, 4]) == brute(list(enumerate(texts, 1)))


def test_operator_output_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = {r.doc_id: r for r in R.remove_repeats(docs(spark, [text, "x " + text + " y"], [1, 2])).collect()}
    assert rows[2].kept == "x y" and [tuple(s) for s in rows[2].removed] == [(1, 21)] and rows[1].removed == []
    assert R.op2(empty(spark)).count() == 0
