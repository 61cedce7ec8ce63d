import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lakequill.llm import secrets as S
from lakequill.llm import textscan as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from("ab é日\n\t\r\x0b\x1c .A𝔘"), max_size=40)


@given(st.lists(st.none() | TEXT, max_size=12), st.integers(1, 30))
@settings(max_examples=150, deadline=None)
def test_words_and_hashes(texts, limit):
    names: dict[int, str] = {}
    seen = []
    for c in X.chunks(pa.array(texts, pa.string()), limit):
        w = c.words()
        h = w.hashes()
        for r in range(c.rows):
            words = [c.buf[a:b].tobytes().decode() for a, b in zip(w.starts[w.ptr[r] : w.ptr[r + 1]], w.ends[w.ptr[r] : w.ptr[r + 1]])]
            seen.append(words)
            for x, k in zip(words, h[w.ptr[r] : w.ptr[r + 1]].tolist()):
                assert names.setdefault(k, x) == x
    assert seen == [WORD.findall(t or "") for t in texts]
    assert len(set(names.values())) == len(names)


def test_arrangements_of_equal_parts_differ():
    """Thue-Morse words and their complements cancel in hashes that are linear modulo a power of two."""
    for bits in (6, 8, 10, 12):
        turn = [bin(i).count("1") & 1 for i in range(1 << bits)]
        a, b = ("".join(w[t] for t in turn) for w in ("ab", "ba"))
        c = next(X.chunks(pa.array([f"{a} {b}"])))
        for base in (X._R1, X._R2):
            h = c.words().hashes(base)
            assert h[0] != h[1]
        g = X.ngrams(np.array([1 + t for t in turn] + [2 - t for t in turn], np.uint64), 1 << bits)
        assert g[0] != g[1 << bits]


@given(st.lists(st.integers(1, 9), max_size=40), st.integers(1, 14))
@settings(max_examples=100, deadline=None)
def test_ngrams_depend_on_their_entries_alone(values, k):
    g = X.ngrams(np.array(values, np.uint64), k)
    runs = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    assert len(g) == len(runs) and len(set(zip(runs, g.tolist()))) == len(set(runs)) == len(set(g.tolist()))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing_round_trip(values):
    a = np.sort(np.array(values, np.uint64))
    assert (X.unpack_sorted(X.pack_sorted(a)) == a).all()
    assert (X.unpack(X.pack(a.view(np.int64)), np.int64) == a.view(np.int64)).all()


def holds(query, text):
    if query is None:
        return True
    if query[0] == "tri":
        return query[1] in text
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


@given(st.data())
@settings(max_examples=300, deadline=None)
def test_every_match_satisfies_its_trigram_query(data):
    rule = data.draw(st.sampled_from(S.RULES))
    text = data.draw(st.text(max_size=5)) + data.draw(st.from_regex(re.compile(rule.regex), fullmatch=True)) + data.draw(st.text(max_size=5))
    assert holds(S.trigram_query(rule.regex), text.lower())


@given(st.from_regex(r"(ab|c[de]){1,3}(f|g)?h?xy[a-z]z{2}", fullmatch=True))
@settings(max_examples=200, deadline=None)
def test_trigram_query_of_nested_regex(text):
    assert holds(S.trigram_query(r"(ab|c[de]){1,3}(f|g)?h?xy[a-z]z{2}"), text)
