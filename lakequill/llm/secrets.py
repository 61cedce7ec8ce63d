"""Secret scan over a trigram inverted index, in DataFrame expressions only.

Each rule's regex is turned, on the driver and once, into a Boolean query over
trigrams that every match must contain. The index holds, for each block of
documents and each trigram that some query names, the posting list of the
documents that contain it; a document is a hash of its id and text. A rule's
query is evaluated on posting lists: `and` intersects them, `or` unites them.
Only documents in a rule's list are verified with that rule's regex, and a rule
without a mandatory trigram scans all documents. Texts are not shuffled unless
the candidates are too many to be sent to every executor.

Spans come from the regex itself: the pieces between matches (`split`) and the
matches (`regexp_extract_all`) alternate, so running lengths give offsets in
code points.

Defined cases: null text counts as empty (no spans); null and repeated doc_ids
are allowed, rows that share id and text share their postings; other columns,
whatever their names, are kept by `redact` and ignored by `scan_secrets`; empty
tables give no rows.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import materialize, parts_for, small_or_shuffled


@dataclass(frozen=True)
class Rule:
    """`least` is the smallest length of `group`; `base` rules are fixed by the contract."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Fixed patterns of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
)
EXTRA_RULES = (
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + EXTRA_RULES

# --- regex -> Boolean trigram query

#: A query: None (no mandatory trigram), or ("tri", t), ("and", [...]), ("or", [...]).
Query = tuple | None
_EXACT = 32


def _all(queries: list[Query]) -> Query:
    known = [q for q in queries if q is not None]
    return None if not known else known[0] if len(known) == 1 else ("and", known)


def _any(queries: list[Query]) -> Query:
    return None if any(q is None for q in queries) else queries[0] if len(queries) == 1 else ("or", queries)


def _of_string(s: str) -> Query:
    tris = dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))
    return _all([("tri", t) for t in tris])


def _of_strings(strings: set[str]) -> Query:
    """Any of the strings; one that contains another adds nothing."""
    least = [s for s in sorted(strings) if not any(o != s and o in s for o in strings)]
    return _any([_of_string(s) for s in least])


def _set_members(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is rc.LITERAL:
            out.add(chr(arg).lower())
        elif op is rc.RANGE and arg[1] - arg[0] < _EXACT:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
        if len(out) > 8:
            return None
    return out


def _walk(node) -> tuple[set[str] | None, Query]:
    """For a sequence: the lower-cased strings it can be exactly (None: too many), and its query."""
    exact: set[str] | None = {""}
    queries: list[Query] = []
    run: set[str] = {""}  # what may stand in the current stretch of known characters

    def flush() -> None:
        queries.append(_of_strings(run))

    for op, arg in node:
        sub: set[str] | None
        query: Query = None
        if op is rc.LITERAL:
            sub = {chr(arg).lower()}
        elif op is rc.IN:
            sub = _set_members(arg)
        elif op is rc.SUBPATTERN:
            sub, query = _walk(arg[3])
        elif op is rc.BRANCH:
            parts = [_walk(b) for b in arg[1]]
            sub = set().union(*[p[0] for p in parts]) if all(p[0] is not None for p in parts) else None
            query = _any([p[1] if p[0] is None else _of_strings(p[0]) for p in parts])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, body = arg
            inner, query = _walk(body)
            sub = {""} | inner if (low, high) == (0, 1) and inner is not None else None
            if low == 0:
                query = None
            elif inner is not None and sub is None:
                query = _of_strings(inner)
        elif op is rc.AT:
            sub = {""}
        else:
            sub = None
        if sub is not None and len(run) * len(sub) <= _EXACT:
            run = {a + b for a, b in product(run, sub)}
            exact = None if exact is None else {a + b for a, b in product(exact, sub)}
        else:
            flush()
            queries.append(query if sub is None else _of_strings(sub))
            run, exact = (sub if sub is not None else {""}), None
    flush()
    return exact, _all(queries)


def trigram_query(regex: str) -> Query:
    """Trigrams (of the lower-cased text) that any text matching `regex` must contain."""
    return _walk(rp.parse(regex))[1]


def trigrams(query: Query) -> list[str]:
    if query is None:
        return []
    return [query[1]] if query[0] == "tri" else list(dict.fromkeys(t for q in query[1] for t in trigrams(q)))


# --- index


#: Input bytes of the documents that share posting lists.
BLOCK_BYTES = 8 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of `docs`), text (null: empty) and key, the document in posting lists."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(row, text.alias("text"), F.xxhash64(docs["doc_id"], text).alias("key"))


def posting_lists(rows: DataFrame, terms: list[str], blocks: int) -> DataFrame:
    """(block, term, keys): the inverted index of `rows` for the given trigrams, by their number."""
    # a column of its own: inside the tests below it would be lowered again for each trigram
    low = rows.select("key", F.lower("text").alias("low"))
    hits = F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(terms)])
    posts = low.select("key", F.explode(F.array_compact(hits)).alias("term"))
    block = F.pmod("key", F.lit(blocks)).cast("int")
    return posts.groupBy(block.alias("block"), "term").agg(F.collect_set("key").alias("keys"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...], blocks: int) -> DataFrame:
    """(key, may): documents in the posting list of some rule, with a bit for each such rule."""
    queries = [trigram_query(r.regex) for r in rules]
    terms = list(dict.fromkeys(t for q in queries for t in trigrams(q)))
    number = {t: i for i, t in enumerate(terms)}
    index = posting_lists(rows, terms, blocks)
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "keys"))).alias("lists"))

    def holds(q: Query) -> Column:
        if q[0] == "tri":
            return F.coalesce(F.try_element_at("lists", F.lit(number[q[1]])), F.array().cast("array<bigint>"))
        return reduce(F.array_intersect if q[0] == "and" else F.array_union, [holds(x) for x in q[1]])

    def marked(i: int, q: Query) -> Column:
        return F.transform(holds(q), lambda k: F.struct(k.alias("key"), F.lit(1 << i).cast("bigint").alias("may")))

    found = [marked(i, q) for i, q in enumerate(queries) if q is not None]
    if not found:
        return rows.select("key", F.lit(0).cast("bigint").alias("may")).where("false")
    each = lists.select(F.explode(F.concat(*found)).alias("hit")).select("hit.*")
    return each.groupBy("key").agg(F.bit_or("may").alias("may"))


# --- verification

_SPAN = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches whose group is long enough."""
    # a maximal run of hex digits is long enough exactly where `least` of them stand together
    pattern = rule.regex[:-1] + "{%d,}" % rule.least if rule.kind == "hex" else rule.regex
    rx = F.lit(pattern)
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    match = F.transform(F.regexp_extract_all(text, rx, F.lit(0)), lambda m: F.length(m).cast("bigint"))
    group = match if rule.group == 0 else F.transform(F.regexp_extract_all(text, rx, F.lit(rule.group)), lambda m: F.length(m).cast("bigint"))
    steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(match)).alias("gap"), match.alias("len"), group.alias("grp"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast(_SPAN).alias("out"))

    def add(acc: Column, s: Column) -> Column:
        at = acc["at"] + s["gap"]
        span = F.struct(at.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (at + s["len"]).alias("end"))
        held = F.coalesce(acc["out"], F.array().cast(_SPAN))
        return F.struct(
            (at + s["len"]).alias("at"),
            F.when(s["grp"] >= rule.least, F.concat(held, F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    return F.coalesce(F.aggregate(steps, start, add)["out"], F.array().cast(_SPAN))


def _found(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """row, text and spans: all verified spans (start, ord, kind, end), by start, then rule order."""
    rows = keyed(docs)
    may = materialize(candidates(rows, rules, parts_for(docs, BLOCK_BYTES, least=1)))
    rows = rows.join(small_or_shuffled(may), "key", "left")
    text, found = F.col("text"), []
    for i, r in enumerate(rules):
        if trigram_query(r.regex) is not None:
            check = F.coalesce(F.col("may").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(False))
        elif r.kind == "hex":
            check = text.rlike(r"[0-9a-f]{%d}" % r.least)
        else:
            check = F.lit(True)
        found.append(F.when(check, _spans(text, r, i)).otherwise(F.array().cast(_SPAN)))
    return rows.select("row", "text", F.array_sort(F.concat(*found)).alias("spans"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans of each row."""
    return _found(docs.select("doc_id", "text"), rules).select("row.doc_id", "spans")


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))
    return found.select("doc_id", *counts, F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every found span replaced by `[secret]` (overlapping spans by one), n_chars brought up to date."""
    text = F.col("text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], piece, F.lit("[secret]"))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate("spans", start, cut, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2147483647))))
    clean = F.size("spans") == 0
    rows = _found(docs, rules).select("row", clean.alias("clean"), F.when(~clean, done).alias("done"))

    def column(c: str) -> Column:
        old, kind = F.col("row").getField(c), docs.schema[c].dataType
        new = {"text": F.col("done"), "n_chars": F.length("done")}.get(c)
        return (old if new is None else F.when(F.col("clean"), old).otherwise(new.cast(kind))).alias(c)

    return rows.select(*[column(c) for c in docs.columns])


def _sql() -> str:
    """The contract's columns in DuckDB SQL, from the same rules."""
    parts = []
    for i, r in enumerate(RULES):
        rx = r.regex.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, {r.least} AS least,
    regexp_split_to_array(t, '{rx}') AS p, regexp_extract_all(t, '{rx}') AS m, regexp_extract_all(t, '{rx}', {r.group}) AS g FROM d WHERE regexp_matches(t, '{rx}')"""
        )
    kinds = ", ".join(f"CAST(coalesce(count(*) FILTER (WHERE kind = '{r.kind}'), 0) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)
    line = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) {}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
e AS (
  SELECT doc_id, ord, kind, least, g[i] AS grp, m[i] AS hit, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM f, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)),
s AS (SELECT doc_id, ord, kind, a, a + length(hit) AS b FROM e WHERE length(grp) >= least),
r AS (
  SELECT doc_id, {kinds}, {line.format(f"FILTER (WHERE ord < {len(BASE_RULES)})")} AS base, {line.format("")} AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


SQL = _sql()
