import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakequill.llm import jaccard as J
from tests.llm.fixtures import awkward_texts, docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows, k=3, num=90, den=100):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            c = len(sets[i] & sets[j])
            if a is not None and b is not None and (a == b and sets[i] and sets[j] or sets[i] and sets[j] and den * c >= num * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[find(i)] = min(least.get(find(i), a), a)
    return sorted(((a, len(sets[i]), None if a is None else least[find(i)]) for i, (a, _) in enumerate(rows)), key=str)


def run(spark, texts, ids):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.op6(docs(spark, texts, ids)).collect()), key=str)


def near_copies(seed, sizes, vocab=3000, groups=12, edits=(0, 5)):
    rng = random.Random(seed)
    line = "the same common line stands in very many of these documents today"
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, vocab)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.choice([1, 2, 3, 30])):
            w = list(base)
            for _ in range(rng.randint(*edits)):
                p = rng.randrange(len(w))
                w[p] = f"E{rng.randint(0, 10**6)}" if rng.random() < 0.7 else w[p].upper()
            if rng.random() < 0.5:
                w.insert(0, line)
            texts.append(" ".join(w))
            base = w if rng.random() < 0.5 else base
    return texts


def test_awkward_texts(spark):
    texts = awkward_texts()
    ids = [len(texts) - i for i in range(len(texts))]
    assert run(spark, texts, ids) == brute(list(zip(ids, texts)))


@pytest.mark.parametrize("frequent", [2, 16])
def test_near_copies(spark, monkeypatch, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "BLOCK", 5)
    texts = near_copies(1, [8, 12, 20, 60, 200]) + near_copies(2, [9, 10, 11, 30], vocab=4, edits=(0, 1))
    texts += [texts[0]] * 40 + [texts[3].replace(" ", "\n")] * 3
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    ids[4] = ids[5] = None
    ids[7] = ids[30]
    got = run(spark, texts, ids)
    assert got == brute(list(zip(ids, texts)))
    assert len({c for _, _, c in got}) < len(texts) // 2


def test_combinations_catch_what_single_keys_leave(spark, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 1)
    texts = near_copies(5, [10, 15, 40, 90], groups=25, edits=(0, 3))
    ids = list(range(len(texts)))
    assert run(spark, texts, ids) == brute(list(zip(ids, texts)))


def test_families_linked_by_single_members(spark, monkeypatch):
    """Families of several blocks in one cluster, where one member of each links to one of the next."""
    monkeypatch.setattr(J, "FREQUENT", 2)
    monkeypatch.setattr(J, "BLOCK", 16)
    base = [f"w{i}" for i in range(200)]

    def edited(at, own=None):
        w = list(base)
        for p in at:
            w[5 * p] = f"new{p}"
        if own is not None:
            w[2 + 5 * (own % 39)] = f"own{own}"
        return " ".join(w)

    texts, own = [], 0
    for family in range(4):
        at = list(range(6 * family))
        for own in range(own, own + 40):
            texts.append(edited(at, own))
        own += 1
        if family < 3:
            # two edits off this family, then two edits on, then two edits to the next family
            n = 6 * family
            texts += [edited(range(n + 2)), edited(range(n + 4))]
    ids = list(range(len(texts)))
    want = brute(list(zip(ids, texts)))
    assert {c for _, _, c in want} == {0}
    assert run(spark, texts, ids) == want


def test_keep_one(spark):
    texts = near_copies(7, [30, 80], groups=10)
    texts += [texts[0], None, "", "", "one", "one"]
    ids = list(range(len(texts)))
    d = docs(spark, texts, ids)
    kept = sorted(r.doc_id for r in J.keep_one(d).collect())
    want = brute(list(zip(ids, texts)), 5, 80, 100)
    assert kept == sorted(i for i, _, c in want if i == c)
    twice = docs(spark, [texts[0]] * 4 + ["zz yy xx"] * 2, [3, 3, 4, None, 9, 9])
    out = J.keep_one(twice)
    assert out.columns == twice.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "9", "None"]


def test_chain_components_and_empty(spark):
    edges = [(i, i + 1) for i in range(300)] + [(i, 1000) for i in range(1001, 1200)]
    e = spark.createDataFrame(edges, "a long, b long").repartition(5, F.rand(1))
    got = {r.node: r.root for r in J.components(e).collect()}
    assert len(got) == 501 and {v for k, v in got.items() if k <= 300} == {0} and {v for k, v in got.items() if k > 300} == {1000}
    assert J.op6(empty(spark)).count() == 0 and J.keep_one(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        J.Likeness(3, 60, 100)


def test_contraction_in_several_goes(monkeypatch):
    monkeypatch.setattr(J, "HELD_NODES", 3)
    goes = [pa.RecordBatch.from_pydict({"a": a, "b": b}) for a, b in (([5, 5, 9], [4, 3, 3]), ([9, 7], [1, 8]), ([], []))]
    assert [list(zip(*b.to_pydict().values())) for b in J._contracted(iter(goes))] == [[(5, 3), (4, 3), (9, 3)], [(9, 1), (8, 7)], []]


@pytest.mark.parametrize("last", [J.LAST_EDGES, 40, 0])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, last):
    monkeypatch.setattr(J, "LAST_EDGES", last)
    rng = random.Random(7)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 700)]
    pairs += pairs[:20] + [(b, a) for a, b in pairs[20:40]] + [(450, 450)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    e = spark.createDataFrame(pairs, "a long, b long").repartition(4, F.rand(2))
    assert sorted(map(tuple, J.components(e).collect())) == sorted(root.items())


def test_words_that_cancel_in_linear_hashes(spark):
    texts = []
    for bits in (10, 12):
        a = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << bits))
        texts += [f"{w} x y" for w in (a, a.translate(str.maketrans("ab", "ba")))]
    assert run(spark, texts, [1, 2, 3, 4]) == brute(list(enumerate(texts, 1))) and run(spark, texts, [1, 2, 3, 4])[1][2] == 2


def test_very_long_words_and_blanks(spark):
    texts = ["a" * 1_000_000, " " * 1_000_000, "a" * 1_000_000, "\n" * 500_000 + "b c " * 100_000]
    assert run(spark, texts, [1, 2, 3, 4]) == brute(list(enumerate(texts, 1)))
