"""Removal of repeated passages, located by sharded Aho-Corasick automata.

A passage is a window of `window` consecutive words. Documents are dealt once
into buckets of bounded size, and this one exchange serves three passes:

1. Each window is represented by the smallest hash among its `seed`-word
   phrases (its minimizer), which depends on the window alone. Buckets send
   their distinct minimizers with the smallest and largest doc_id that hold
   them; shards by hash range find those of two documents or more and send
   them back to the buckets that hold them. This only narrows the search.
2. Buckets cut their documents into segments, runs of windows with one such
   minimizer, and send each distinct segment's words once to the minimizer's
   shard, where all windows of one wording meet. The shard compares the words
   and confirms the windows that start in two documents or more. Consecutive
   windows that first start in the same document form a passage; each bucket
   that holds it in a larger document gets its words and that smallest doc_id.
3. A bucket compiles the passages it was sent into automata over words, of at
   most `AUTOMATON_PHRASES` passages each, and streams all its documents through
   them. Every match in a document above the passage's smallest doc_id is removed.

Hashes choose shards and candidates; a window is repeated, and a passage is
located, by its words alone. What a shard sees of one passage is an entry per
bucket, not per document, so a passage that a third of all documents share
stays small.

Defined cases: null text counts as empty; a null doc_id is neither smaller nor
larger than others, so its document keeps all words and removes none; rows that
share a doc_id do not remove each other's words; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import parts_for, release_memory
from lakequill.llm.textscan import U64, Chunk, Words, chunks, mix, ngrams, pack, pack_sorted, ranges, unpack, unpack_sorted

WINDOW = 13
SEED = 7
AUTOMATON_PHRASES = 20_000
#: Digits that words are written in, and the code points where they begin.
BASE = 64
_FIRST, _LATER = 0x100, 0x200
#: Compressed input bytes for each bucket, and as many shards as buckets.
BUCKET_BYTES = 2 << 20

_FOUND = "shard int, bucket int, keys binary, low binary, span binary"
_BACK = "bucket int, keys binary, low binary"
_NO_ID = np.iinfo(np.int64).min


class _Bucket:
    """A bucket's documents in an order that depends on their content alone."""

    def __init__(self, table: pa.Table, window: int, seed: int):
        release_memory()
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.window, self.seed = window, seed
        self.chunk: Chunk | None = next(chunks(self.table["text"], 1 << 62), None)
        if self.chunk is None:
            return
        self.words: Words = self.chunk.words()
        self.row = self.words.rows()
        ids = self.table["doc_id"].combine_chunks()
        self.doc = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)[self.row]
        known = ids.is_valid().to_numpy(zero_copy_only=False)[self.row]
        n = len(self.row) - window + 1
        self.starts = np.flatnonzero((self.row[:n] == self.row[window - 1 :]) & known[:n]) if n > 0 else np.empty(0, np.int64)
        self.hash = self.words.hashes()

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window: the smallest phrase hash and the word where that phrase starts."""
        grams = ngrams(self.hash, self.seed)
        best, at = grams[self.starts], self.starts.copy()
        for j in range(1, self.window - self.seed + 1):
            more = grams[self.starts + j]
            less = more < best
            best = np.where(less, more, best)
            at = np.where(less, self.starts + j, at)
        return best, at

    def distinct(self, keys: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of the windows `pick`, the smallest doc_id and the span to the largest."""
        order = np.argsort(keys, kind="stable")
        first = _cuts(keys[order])[:-1]
        doc = self.doc[self.starts[pick[order]]]
        if not len(first):
            return keys, doc, doc
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        return keys[order][first], low, high - low

    def texts(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The words first to last (exclusive) of each pair, joined by one space."""
        raw = self.chunk.buf.tobytes()
        begins, ends = self.words.starts[first].tolist(), self.words.ends[last - 1].tolist()
        return [b" ".join(raw[a:z].split()) for a, z in zip(begins, ends)]


def _cuts(a: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    if not len(a):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _table(schema: str, cols: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _deal(bucket: int, shards: int, keys: np.ndarray, low: np.ndarray, span: np.ndarray) -> pa.Table:
    """One row per shard that gets any of the ascending keys."""
    cuts = _cuts(shard := _shard(keys, shards))
    each = list(zip(cuts[:-1], cuts[1:]))
    return _table(_FOUND, [[int(shard[a]) for a, _ in each], [bucket] * len(each), [pack_sorted(keys[a:z]) for a, z in each], [pack(low[a:z]) for a, z in each], [pack(span[a:z]) for a, z in each]])


def _recurring(table: pa.Table) -> pa.Table:
    """What a shard sends back to each bucket: those of its minimizers that two documents or more hold."""
    buckets = table["bucket"].to_pylist()
    keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    src = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key = np.concatenate(keys)
    low = np.concatenate([unpack(b, np.int64) for b in table["low"].to_pylist()])
    high = low + np.concatenate([unpack(b, np.int64) for b in table["span"].to_pylist()])
    order = np.argsort(key, kind="stable")
    cuts = _cuts(key[order])
    both = np.minimum.reduceat(low[order], cuts[:-1]) < np.maximum.reduceat(high[order], cuts[:-1])
    order = order[np.repeat(both, np.diff(cuts))]
    order = order[np.lexsort((key[order], src[order]))]
    cuts = _cuts(src[order])
    each = list(zip(cuts[:-1], cuts[1:]))
    return _table(_BACK, [[buckets[src[order[a]]] for a, _ in each], [pack_sorted(key[order[a:z]]) for a, z in each], [None] * len(each)])


def _segments(b: _Bucket, recurring: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word (exclusive) and minimizer of each run of windows with one recurring minimizer."""
    best, at = b.minimizers()
    spot = np.minimum(np.searchsorted(recurring, best), len(recurring) - 1)
    pick = np.flatnonzero(recurring[spot] == best)
    s, a = b.starts[pick], at[pick]
    if not len(s):
        return s, s, best[pick]
    cut = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (a[1:] != a[:-1])]))
    return s[cut], s[np.append(cut[1:], len(s)) - 1] + b.window, best[pick[cut]]


def _groups(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of word ids that starts at `at`; equal numbers where all words are equal."""
    key = ngrams(mix(ids.astype(U64)), window)[at]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = at[order[1:][same]], at[order[:-1][same]]
    if any((ids[a + j] != ids[b + j]).any() for j in range(window)):
        # different words under one hash: compare whole windows
        return np.unique(np.column_stack([ids[at + j] for j in range(window)]), axis=0, return_inverse=True)[1].reshape(-1)
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(np.concatenate([[True], ~same])) - 1
    return out


def _confirm(table: pa.Table, window: int) -> pa.Table:
    """The passages of a shard's segments that repeat one of a smaller doc_id, for each bucket that holds them."""
    number: dict[bytes, int] = {}
    words: list[bytes] = []
    sizes, bucket = [], []
    for b, texts in zip(table["bucket"].to_pylist(), table["keys"].to_pylist()):
        for text in texts.split(b"\n"):
            mine = text.split(b" ")
            words += mine
            sizes.append(len(mine))
            bucket.append(b)
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    low = np.concatenate([unpack(b, np.int64) for b in table["low"].to_pylist()])
    high = low + np.concatenate([unpack(b, np.int64) for b in table["span"].to_pylist()])
    size = np.array(sizes, np.int64)
    n = size - window + 1
    at, seg = ranges(np.cumsum(size) - size, n), np.repeat(np.arange(len(size)), n)
    group = _groups(ids, at, window)
    order = np.argsort(group, kind="stable")
    least = np.minimum.reduceat(low[seg[order]], _cuts(group[order])[:-1])[group]
    keep = np.flatnonzero(high[seg] > least)
    at, seg, least = at[keep], seg[keep], least[keep]
    out: dict[int, dict[bytes, int]] = {}
    if len(at):
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seg[1:] != seg[:-1]) | (least[1:] != least[:-1])]))
        ends = at[np.append(cut[1:], len(at)) - 1] + window
        for a, z, s, d in zip(at[cut].tolist(), ends.tolist(), seg[cut].tolist(), least[cut].tolist()):
            out.setdefault(bucket[s], {})[b" ".join(words[a:z])] = d
    return _table(_BACK, [list(out), [b"\n".join(x) for x in out.values()], [pack(np.array(list(x.values()), np.int64)) for x in out.values()]])


def _locate(b: _Bucket, passages: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word (exclusive) and smallest doc_id of every occurrence of a passage in the bucket's documents."""
    # a word is written in digits, the first of a kind of its own: places cannot fall inside a word, and a
    # node has at most BASE successors; one sign stands for all other words, one for the end of a document
    words = list(dict.fromkeys(w for text in passages for w in text.split(b" ")))
    width = next(i for i in range(1, 99) if BASE**i >= len(words))
    first, later = ([chr(at + i) for i in range(BASE)] for at in (_FIRST, _LATER))
    digits = itertools.product(first, *[later] * (width - 1))
    code = dict(zip(words, map("".join, digits)))
    keys = ["".join([code[w] for w in text.split(b" ")]) for text in passages]
    data, offs = b.chunk.buf.tobytes(), b.chunk.offs.tolist()
    stream = "\x01".join(["".join([code.get(w, "\x00") for w in data[a:z].split()]) for a, z in zip(offs, offs[1:])])
    found: list[tuple[int, int]] = []
    for k in range(0, len(keys), AUTOMATON_PHRASES):
        auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, key in enumerate(keys[k : k + AUTOMATON_PHRASES], k):
            auto.add_word(key, i)
        auto.make_automaton()
        found += auto.iter(stream)
    hits = np.array(found, np.int64).reshape(-1, 2)
    size, low = np.array([len(k) // width for k in keys], np.int64), np.array(list(passages.values()), np.int64)
    sign = np.frombuffer(stream.encode("utf-32-le"), "<u4")
    # words up to each match's end
    last = np.cumsum((sign != 1) & (sign < _LATER))[hits[:, 0]]
    return last - size[hits[:, 1]], last, low[hits[:, 1]]


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, removed (spans of word numbers, end exclusive) and kept (the other words, joined by one space)."""
    n = parts_for(docs, BUCKET_BYTES)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def seeds(table: pa.Table) -> pa.Table:
        b = _Bucket(table, window, seed)
        best, _ = b.minimizers()
        fresh = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (b.row[b.starts][1:] != b.row[b.starts][:-1])])) if len(best) else np.empty(0, np.int64)
        return _deal(table["bucket"][0].as_py(), n, *b.distinct(best[fresh], fresh))

    def candidates(table: pa.Table, known: pa.Table) -> pa.Table:
        b = _Bucket(table, window, seed) if table.num_rows else None
        if b is None or not known.num_rows or not len(b.starts):
            return _table(_FOUND, [[]] * 5)
        first, last, key = _segments(b, np.sort(np.concatenate([unpack_sorted(k) for k in known["keys"].to_pylist()])))
        held: dict[bytes, list[int]] = {}
        for text, doc, to in zip(b.texts(first, last), b.doc[first].tolist(), _shard(key, n).tolist()):
            # documents ascend within a bucket
            held.setdefault(text, [to, doc, doc])[2] = doc
        sent: dict[int, list[bytes]] = {}
        for text, (to, _, _) in held.items():
            sent.setdefault(to, []).append(text)
        low = [pack(np.array([held[x][1] for x in texts], np.int64)) for texts in sent.values()]
        span = [pack(np.array([held[x][2] - held[x][1] for x in texts], np.int64)) for texts in sent.values()]
        return _table(_FOUND, [list(sent), [table["bucket"][0].as_py()] * len(sent), [b"\n".join(x) for x in sent.values()], low, span])

    def drop(table: pa.Table, known: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "removed", "kept"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), span, pa.string()]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        b = _Bucket(table, window, seed)
        covered = np.zeros(len(b.row) + 1, np.int64)
        passages: dict[bytes, int] = {}
        for texts, low in zip(known["keys"].to_pylist(), known["low"].to_pylist()):
            passages.update(zip(texts.split(b"\n"), unpack(low, np.int64).tolist()))
        if passages:
            first, last, low = _locate(b, passages)
            gone = b.doc[first] > low
            np.add.at(covered, first[gone], 1)
            np.subtract.at(covered, last[gone], 1)
        covered = np.cumsum(covered[:-1]) > 0
        edge = np.zeros(len(covered), bool)
        edge[b.words.ptr[:-1][b.words.counts() > 0]] = True
        before = np.concatenate([[False], covered[:-1]]) & ~edge
        after = np.concatenate([covered[1:] & ~edge[1:], [False]])[: len(covered)]
        opens, closes = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
        ptr = np.searchsorted(opens, b.words.ptr)
        data, offs = b.chunk.buf, b.chunk.offs
        spans, kept = [], []
        for r in range(b.chunk.rows):
            words = data[offs[r] : offs[r + 1]].tobytes().split()
            base, mine = b.words.ptr[r], []
            at, left = 0, []
            for a, z in zip((opens[ptr[r] : ptr[r + 1]] - base).tolist(), (closes[ptr[r] : ptr[r + 1]] - base).tolist()):
                mine.append({"start": a, "end": z})
                left += words[at:a]
                at = z
            spans.append(mine)
            kept.append(b" ".join(left + words[at:]))
        cols = [b.table["doc_id"].combine_chunks(), pa.array(b.words.counts()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table(cols, names=names)

    dealt = rows.groupBy("bucket")
    found = dealt.applyInArrow(seeds, _FOUND)
    known = found.groupBy("shard").applyInArrow(_recurring, _BACK)
    found = dealt.cogroup(known.groupBy("bucket")).applyInArrow(candidates, _FOUND)
    known = found.groupBy("shard").applyInArrow(lambda t: _confirm(t, window), _BACK)
    schema = "doc_id bigint, n_words bigint, removed array<struct<start:bigint,end:bigint>>, kept string"
    return dealt.cogroup(known.groupBy("bucket")).applyInArrow(drop, schema)


def op2(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return remove_repeats(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
m AS (SELECT g, min(doc_id) AS first_id FROM s GROUP BY g),
r AS (
  SELECT DISTINCT s.doc_id, s.i + k AS i
  FROM s JOIN m USING (g), LATERAL (SELECT unnest(range(0, 13)) AS k)
  WHERE s.doc_id > m.first_id),
l AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l ON d.doc_id = l.doc_id
"""
