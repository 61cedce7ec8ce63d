import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lakequill.llm import quality_rules as q
from tests.llm.fixtures import awkward_texts, docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_counts_match_brute_force():
    texts = awkward_texts() + ["# a | b\n# a | b\n", "\n", "x\n", "\nx\nx"]
    got = q.text_stats(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in q.COUNTS) == brute(t), repr(t)[:80]


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (2000, 4)), np.full((20, 4), 9.0)])
    s = q.grow_forest(x, q.statistic_groups(4)).scores(x)
    assert s.shape == (2020, 5)
    assert (s[2000:].min(0) > np.quantile(s[:2000], 0.99, axis=0)).all()


def test_path_lengths_by_isolating_rows():
    """Each row's path is followed by cutting the rows that the tree drew, one split after the other."""
    rng = np.random.default_rng(1)
    x, drawn = np.round(rng.normal(0, 1, (300, 3)), 1), []
    f = q.grow_forest(x, q.statistic_groups(3), trees=4, rows=20, drawn=drawn)
    want = np.zeros((len(x), 4))
    for t, sample in enumerate(drawn):
        for i, row in enumerate(x):
            part, node, level = sample, 0, 0
            while f.child[t, node] != node:
                j, cut = f.feature[t, node], f.split[t, node]
                assert j in q.statistic_groups(3)[f.group[t]] and part[:, j].min() < part[:, j].max()
                part = part[(part[:, j] >= cut) == (row[j] >= cut)]
                node, level = f.child[t, node] + (row[j] >= cut), level + 1
            n = len(part)
            harmonic = sum(1 / k for k in range(1, n))
            assert level <= 5 and (n <= 1 or level == 5 or all(len(set(part[:, j])) == 1 for j in q.statistic_groups(3)[f.group[t]]))
            want[i, f.group[t]] += level + (0 if n < 2 else 2 * harmonic - 2 * (n - 1) / n)
    assert np.allclose(f.paths(x), want / 4)
    one = f.paths(x)
    assert np.allclose(f.scores(x), 2 ** (-one / f.norm))


def test_threshold():
    good, bad = np.zeros(100), np.zeros(100)
    good[10], good[60], bad[40], bad[80] = 990, 10, 50, 50
    assert q.threshold(good, bad, 5) == 0.705 and q.threshold(good, bad, 10) == 0.255
    assert q.threshold(good, np.zeros(100), 5) == np.inf


def test_whole_query(spark):
    d = docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in q.op8(d, labels).collect()}
    assert len(rows) == d.count()
    for i, t in enumerate(awkward_texts()):
        n, w, s, l, r = brute(t)
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words) == (n, w, s, l, r)
        assert rows[i].base_failed == (n < 10 or 100 * r > 20 * n)
        assert not (rows[i].base_failed and rows[i].kept)
    assert q.filter_documents(d, labels).columns == d.columns


def test_no_labels_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.op8(empty(spark), labels).count() == 0
    out = q.op8(docs(spark), labels).where("kept = base_failed").count()
    assert out == 0


def test_forest_catches_labelled_junk_and_keeps_good(spark):
    from lakequill.llm.common import table

    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    out = q.op8(table(spark, sf, "documents"), labels).join(labels, "doc_id").where("not base_failed")
    n = {(r.good, r.kept): r["count"] for r in out.groupBy((labels.quality > 0).alias("good"), "kept").count().collect()}
    assert n.get((False, False), 0) >= 0.9 * (n.get((False, False), 0) + n.get((False, True), 0))
    assert n.get((True, False), 0) <= 0.005 * n[(True, True)]


def test_hashes_do_not_cancel():
    """Lines and words that cancel in linear hashes are told apart."""
    for bits in (10, 12):
        a = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << bits))
        t = f"{a}\n{a.translate(str.maketrans('ab', 'ba'))}\n" + " ".join(f"{w} x y z u" for w in (a, a.translate(str.maketrans("ab", "ba"))))
        got = q.text_stats(pa.array([t]))
        assert tuple(int(got[c][0]) for c in q.COUNTS) == brute(t)


def test_very_long_words_and_blanks():
    for t in ("a" * 1_000_000, " " * 1_000_000, "x\n" * 200_000 + "b" * 600_000):
        got = q.text_stats(pa.array([t, "a b"]))
        assert tuple(int(got[c][0]) for c in q.COUNTS) == brute(t) and int(got["n_words"][1]) == 2
