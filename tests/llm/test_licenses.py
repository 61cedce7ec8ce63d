import re

from lakequill.llm import licenses as L
from tests.llm.fixtures import awkward_texts, docs, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    places = []
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = awkward_texts() + [
    "CC-BY cc by cc by", "All rights\nreserved. GNU General Public License", "xcc by", "cc byx", "É cc BY é",
    "x\n// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\nrest",
    "SPDX-License-Identifier: MIT OR (Apache-2.0", "general public license general public license",
    "cc \x7f by", "K cc by",
]


def test_base_matches_brute_force(spark):
    d = docs(spark, TEXTS)
    rows = {r.doc_id: r for r in L.op10(d).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_expressions():
    assert L.postfix("MIT or Apache-2.0 and ISC") == ["mit", "apache-2.0", "isc", "and", "or"]
    assert L.evaluate("(MIT OR GPL-2.0) AND ISC") == (["gpl-2.0", "isc", "mit"], True)
    assert L.evaluate("GPL-2.0 WITH Classpath-exception-2.0") == (["gpl-2.0-with-classpath-exception-2.0"], False)
    for bad in ("", "MIT OR", "(MIT", "OR MIT", "MIT)"):
        assert L.evaluate(bad) is None


def test_operands_are_licences():
    assert L.evaluate("MIT and others") == (["mit"], True) and L.evaluate("Apache-2.0. See the file") == (["apache-2.0"], True)
    assert L.evaluate("see file") is None and L.evaluate("(MIT or something") is None and L.evaluate("MIT WITH prose") == (["mit"], True)
    assert L.evaluate("GPL-2.0-or-later WITH GCC-exception-3.1 OR LGPL-2.1+") == (["gpl-2.0-or-later-with-gcc-exception-3.1", "lgpl-2.1+"], False)
    assert L.evaluate("LicenseRef-own AND CC-BY-SA-4.0") == (["cc-by-sa-4.0", "licenseref-own"], False)
    assert L.evaluate("MIT OR (see file)") is None
    assert {"mit", "gpl-3.0-only", "cc-by-nc-sa-4.0", "0bsd"} <= L.LICENCES and "see" not in L.LICENCES


def test_expressions_against_recursive_evaluation():
    import random

    rng = random.Random(2)
    free = lambda n: n in L.PERMISSIVE

    def build(depth):
        """An expression with its names and whether permissive licences alone satisfy it."""
        if depth == 0 or rng.random() < 0.3:
            n = rng.choice(["mit", "isc", "gpl-2.0", "mpl-2.0", "apache-2.0"])
            if rng.random() < 0.2:
                return f"{n} with llvm-exception", {f"{n}-with-llvm-exception"}, free(n)
            return n, {n}, free(n)
        (a, x, p), (b, y, q) = build(depth - 1), build(depth - 1)
        if rng.random() < 0.5:
            return f"({a}) AND ({b})", x | y, p and q
        return f"({a}) or ({b})", x | y, p or q

    for _ in range(300):
        text, names, permissive = build(4)
        assert L.evaluate(text) == (sorted(names), permissive), text
    # without parentheses `and` binds tighter
    assert L.evaluate("gpl-2.0 or mit and isc")[1] and not L.evaluate("gpl-2.0 and mit or mpl-2.0")[1]


def test_very_long_words_and_blanks(spark):
    texts = ["a" * 1_000_000, " " * 1_000_000, "cc by " * 100_000, "SPDX-License-Identifier: " + "(" * 500_000]
    rows = {r.doc_id: r for r in L.op10(docs(spark, texts)).collect()}
    assert (rows[0].n_words, rows[1].n_words, rows[2].n_base, rows[2].last_word) == (1, 0, 100_000, 199_998) and rows[3].labels == "spdx-invalid"


def test_tags_and_empty(spark):
    rows = {r.doc_id: r for r in L.op10(docs(spark, TEXTS)).collect()}
    i = len(awkward_texts())
    assert "bsd-3-clause" in rows[i + 5].labels and "spdx-invalid" in rows[i + 6].labels
    assert L.op10(empty(spark)).count() == 0
