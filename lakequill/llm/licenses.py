"""License scan: an Aho-Corasick pass for tags and notices, a shunting-yard parser for expressions.

Each text is lower-cased (A-Z only) and cut into words of letters, digits and
non-ASCII characters; the words, joined by one space, run once through an
automaton that holds all notice phrases and the identifier tag. Where the tag
occurs, the raw expression behind it is parsed to postfix form and evaluated:
`and` joins the licences of both sides, `or` offers either, `with` binds an
exception to its licence. Operands are names of the licence list; what follows
an expression, such as prose, ends it.

Defined cases: null text counts as empty (no words, no places, score 0); every
input row gives one output row, repeated rows included; other columns of the
input are ignored, so clashing names cannot matter; an expression that does not
parse or does not begin with a licence gives the label `spdx-invalid`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and labels that the contract fixes.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notices that the method adds.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc",
    "released into the public domain": "public-domain",
}
TAG = "spdx license identifier"
_TAG_AT = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
#: How sure one place makes us that its licence is meant.
_WEIGHTS = {"tag": 0.95, "notice": 0.8, "base": 0.5}
PERMISSIVE = {"mit", "mit-0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "0bsd", "isc", "cc0-1.0", "unlicense", "zlib", "cc-by-4.0", "bsl-1.0", "wtfpl", "x11", "ncsa", "python-2.0", "postgresql"}
#: Fixed names of the SPDX licence list: families with their versions, then licences without.
_FAMILIES = {
    "afl": "1.1 1.2 2.0 2.1 3.0", "agpl": "1.0 3.0", "apache": "1.0 1.1 2.0", "apsl": "1.0 1.1 1.2 2.0", "artistic": "1.0 2.0",
    "bsl": "1.0", "cc-by": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-nd": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-nc-sa": "1.0 2.0 2.5 3.0 4.0", "cc-by-nd": "1.0 2.0 2.5 3.0 4.0", "cc-by-sa": "1.0 2.0 2.5 3.0 4.0", "cc0": "1.0",
    "cddl": "1.0 1.1", "cecill": "1.0 1.1 2.0 2.1", "cpl": "1.0", "ecl": "1.0 2.0", "epl": "1.0 2.0", "eupl": "1.0 1.1 1.2",
    "gfdl": "1.1 1.2 1.3", "gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0", "lppl": "1.0 1.1 1.2 1.3a 1.3c", "mpl": "1.0 1.1 2.0",
    "odbl": "1.0", "ofl": "1.0 1.1", "osl": "1.0 1.1 2.0 2.1 3.0", "php": "3.0 3.01", "python": "2.0", "qpl": "1.0", "sspl": "1.0",
    "upl": "1.0", "zpl": "1.1 2.0 2.1",
}
_SINGLE = (
    "0bsd beerware bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bzip2-1.0.6 curl "
    "fsfap ftl hpnd icu ijg isc json libpng libtiff linux-openib mit mit-0 mit-feh mit-modern-variant ms-pl ms-rl mulanpsl-2.0 "
    "ncsa netcdf ntp openssl postgresql psf-2.0 ruby sleepycat tcl unicode-dfs-2016 unicode-3.0 unlicense vim w3c wtfpl x11 xnet zlib"
)
_GNU = {"agpl", "gfdl", "gpl", "lgpl"}


def licence_list() -> frozenset[str]:
    """Lower-cased names; the GNU families also with -only and -or-later."""
    names = set(_SINGLE.split())
    for family, versions in _FAMILIES.items():
        for v in versions.split():
            names |= {f"{family}-{v}{end}" for end in (("", "-only", "-or-later") if family in _GNU else ("",))}
    return frozenset(names)


LICENCES = licence_list()
_EXCEPTION = re.compile(r".*-exception(-\d[\d.]*)?|llvm-exception|linux-syscall-note")


def is_licence(name: str) -> bool:
    return name.removesuffix("+") in LICENCES or name.startswith(("licenseref-", "documentref-"))


_WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Operands and operators in postfix order; None if the text does not begin with a well-formed expression.

    An operator whose right side is no operand belongs to the prose behind the expression.
    """
    out: list[str] = []
    stack: list[str] = []
    want_operand = True
    for raw in _TOKEN.findall(expression):
        token = raw.lower().rstrip(".")
        if token == "(":
            if not want_operand:
                break
            stack.append(token)
        elif token == ")":
            if want_operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in _BINDS:
            if want_operand:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            want_operand = True
        elif not want_operand:
            break
        elif _EXCEPTION.fullmatch(token) if stack[-1:] == ["with"] else is_licence(token):
            out.append(token)
            want_operand = False
        elif stack and stack[-1] in _BINDS:
            stack.pop()
            want_operand = False
            break
        else:
            return None
    if want_operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[list[str], bool] | None:
    """The licences an expression names, and whether permissive licences alone can satisfy it."""
    rpn = postfix(expression)
    if rpn is None:
        return None
    stack: list[tuple[frozenset, bool]] = []
    for token in rpn:
        if token not in _BINDS:
            stack.append((frozenset([token]), token.removesuffix("+") in PERMISSIVE))
            continue
        (b, free_b), (a, free_a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((frozenset(f"{x}-with-{y}" for x in a for y in b), free_a))
        else:
            stack.append((a | b, free_a and free_b if token == "and" else free_a or free_b))
    names, free = stack.pop()
    return sorted(names), free


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        auto.add_word(f" {phrase} ", (phrase, label))
    auto.make_automaton()
    return auto


def _scan_one(text: str | None, auto: ahocorasick.Automaton, base: dict[str, str]) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split()
    joined = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    places, labels, expressions = [], set(), []
    miss, at, count, tagged, permissive = 1.0, 0, 0, False, None
    for end, (phrase, label) in auto.iter(joined):
        start = end - len(phrase) - 1
        if start >= at:  # ends ascend, starts may not
            count += joined.count(" ", at, start)
            at = start
            word = count
        else:
            word = joined.count(" ", 0, start)
        if phrase == TAG:
            tagged = True
            continue
        places.append({"phrase": phrase, "label": label, "word": word, "base": phrase in base})
        labels.add(label)
        miss *= 1 - _WEIGHTS["base" if phrase in base else "notice"]
    if tagged:
        for expression in _TAG_AT.findall(text or ""):
            expressions.append(expression.strip())
            value = evaluate(expression)
            if value is None:
                labels.add("spdx-invalid")
                continue
            labels.update(value[0])
            permissive = value[1] if permissive is None else permissive and value[1]
            miss *= 1 - _WEIGHTS["tag"]
    return len(words), places, sorted(labels), expressions, permissive, 1 - miss


PLACE = "array<struct<phrase:string,label:string,word:bigint,base:boolean>>"


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, n_words, places, labels, expressions, permissive, score for each row of `docs` (doc_id, text)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {key}, n_words bigint, places {PLACE}, labels array<string>, "
        "expressions array<string>, permissive boolean, score double"
    )
    place = pa.list_(
        pa.struct([("phrase", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_())])
    )
    kinds = [pa.int64(), place, pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.float64()]
    names = ["doc_id", "n_words", "places", "labels", "expressions", "permissive", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton({**notices, **base, TAG: ""})
        for batch in batches:
            rows = [_scan_one(t.as_py(), auto, base) for t in batch.column(1)]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns, from scan_licenses."""
    found = scan_licenses(docs)
    base = F.filter("places", lambda p: p["base"])
    found = found.withColumn("hits", base)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_base"),
        F.array_min(F.transform("hits", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("hits", lambda p: p["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        "permissive",
    )


def base_places(docs: DataFrame) -> DataFrame:
    """The columns of `op10` that SQL can express."""
    return op10(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _base_sql() -> str:
    places, labels = [], []
    for phrase, label in BASE_PHRASES.items():
        words = phrase.split()
        mine = f"list_filter(range(len(w)), lambda i: w[i+1:i+{len(words)}] = {words!r})"
        places.append(mine)
        labels.append(f"CASE WHEN len({mine}) > 0 THEN ['{label}'] ELSE [] END")
    every = " || ".join(places)
    return f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, {every} AS spots, list_sort({" || ".join(labels)}) AS labels FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, CAST(list_min(spots) AS BIGINT) AS first_word,
  CAST(list_max(spots) AS BIGINT) AS last_word, array_to_string(labels, ',') AS base_labels
FROM p
"""


BASE_SQL = _base_sql()
