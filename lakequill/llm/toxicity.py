"""Toxicity scores of text restored by a noisy-channel decoder.

A character trigram model is counted over all documents. Suspicious tokens -
digits or symbols standing for letters, letters repeated three times or more,
letters kept apart by blanks or marks - become lattices: each place offers the
letters it may stand for, a run may be one or two letters, marks may be
dropped, letters kept apart may be parted into words, each at a channel cost.
Viterbi finds the likeliest words under channel and language model, and restored
text takes the token's place.

The restored text is scored by a logistic model over hashed words and word
beginnings. It is fitted on at most `SAMPLE_ROWS` labelled rows outside the
held-out fold; labels, lang, source and doc_id are never inputs.

Defined cases: null text counts as empty and is scored like any other; every
row gets one output row, repeated rows alike; a doc_id with several labels
counts as toxic if one says so; without labelled rows of both kinds all scores
are the share of toxic labels (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import held_out, lean, lowest, materialize
from lakequill.llm.textscan import LOWER, U64, Chunk, chunks, mix, separators, span_hash

SAMPLE_ROWS = 20_000
#: Hash buckets of features, and how many of them the model uses.
BUCKETS = 1 << 20
FEATURES = 2048
PREFIXES = (4, 5, 6)
CUTOFF = 0.3

#: What a sign may stand for.
READINGS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
_COST = {"sign": -1.0, "single": -0.3, "double": -0.9, "drop": -2.5, "lost": -6.0, "blank": -1.0}
#: Restored words must reach this mean log-probability per letter.
_FLOOR = -4.5

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(_LETTERS):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i + 1
_CODE_OF = {c: i + 1 for i, c in enumerate(_LETTERS)} | {" ": 0}
_NOT_LETTER = separators(bytes(b for b in range(128) if not chr(b).isalpha()))
_IS_LETTER = _CODE > 0
_IS_SIGN = separators("".join(READINGS))
_IS_DIGIT = separators("0123456789")
_SPACED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9@$!|+](?:[ ._*-][A-Za-z0-9@$!|+]){2,}(?![A-Za-z0-9])|[A-Za-z0-9@$!|+*]+")
#: Characters of a token, and those of them that no restored body ends in.
_IN_TOKEN = separators("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@$!|+*")
_SOFT = separators("!|+*@")
_RUN = re.compile(r"([A-Za-z])\1\1")


# --- language model


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of (letter or boundary) triples over all documents: 27 cubed numbers.

    Each task sends one table per few megabytes of text; they are summed on the executors by
    slices, so that the driver gets each number once.
    """
    size, slices = 27**3, 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size, np.int64), 0

        def rows() -> pa.RecordBatch:
            parts = [p.tobytes() for p in np.array_split(total, slices)]
            return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

        for b in batches:
            for c in chunks(b.column(0)):
                code = _CODE[c.buf]
                # a boundary before and after each row
                code = np.insert(code, c.offs, 0)
                total += np.bincount(code[:-2] * 729 + code[1:-1] * 27 + code[2:], minlength=size) if len(code) > 2 else 0
                seen += len(c.buf)
                if seen >= 8 << 20:
                    yield rows()
                    total[:], seen = 0, 0
        if seen:
            yield rows()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"])
        return pa.table({"slice": table["slice"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "slice int, counts binary")
    got = {r["slice"]: bytes(r["counts"]) for r in parts.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()}
    if not got:
        return np.zeros(size, np.int64)
    return np.frombuffer(b"".join(got[i] for i in range(slices)), np.int64)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), smoothed by the shorter contexts."""
    tri = counts.reshape(27, 27, 27).astype(np.float64)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + 27)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    return np.log((tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20))


class Decoder:
    """Viterbi over the lattice of a token."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.restore_token = lru_cache(200_000)(self._restore_token)

    @staticmethod
    def lattice(token: str) -> list[tuple[tuple[str, float], ...]]:
        """For each place, what may be written there and its channel cost."""
        out: list[tuple[tuple[str, float], ...]] = []
        i = 0
        while i < len(token):
            c = token[i].lower()
            j = i
            while j < len(token) and token[j].lower() == c:
                j += 1
            n = j - i
            if c in _LETTERS:
                if n >= 3:
                    out.append(((c, _COST["single"]), (c + c, _COST["double"])))
                else:
                    out += [((c, 0.0),)] * n
            elif c in READINGS:
                choice = tuple((r, _COST["sign"]) for r in READINGS[c])
                out += [choice + (("", _COST["lost"]),)] * min(n, 2) + [(("", _COST["drop"]),)] * max(n - 2, 0)
            else:
                out += [(("", _COST["drop"] if not c.isdigit() else _COST["lost"]),)] * n
            i = j
        return out

    @classmethod
    def spaced_lattice(cls, letters: str) -> list[tuple[tuple[str, float], ...]]:
        """The lattice of letters that stood apart: between any two of them a word may end."""
        out: list[tuple[tuple[str, float], ...]] = []
        for place in cls.lattice(letters):
            out += [(("", 0.0), (" ", _COST["blank"]))] * bool(out) + [place]
        return out

    def decode(self, places: list[tuple[tuple[str, float], ...]]) -> tuple[str, float]:
        """The likeliest writing of a lattice and its log-probability, channel included."""
        beam: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for place in places:
            fresh: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, word) in beam.items():
                for letters, cost in place:
                    s, x, y = score + cost, a, b
                    for c in letters:
                        k = _CODE_OF[c]
                        s, x, y = s + self.model[x][y][k], y, k
                    if (x, y) not in fresh or fresh[x, y][0] < s:
                        fresh[x, y] = (s, word + letters)
            beam = fresh
        return max(((w, s + self.model[a][b][0]) for (a, b), (s, w) in beam.items()), key=lambda r: (r[1], r[0]))

    def _restore_token(self, token: str) -> str:
        body = token.rstrip("!|+*@")
        tail = token[len(body) :]
        apart = len(body) >= 5 and all(c in " ._*-" for c in body[1::2]) and not any(c in " ._*-" for c in body[::2])
        if apart:
            body = body[::2]
        letters = sum(c.isalpha() for c in body)
        signs = sum(c in READINGS for c in body)
        if not letters or not (apart or signs or _RUN.search(body) or "*" in body):
            return token
        word, score = self.decode(self.spaced_lattice(body) if apart else self.lattice(body))
        if not word or score < _FLOOR * (len(word) + 1):
            return token
        return word + tail

    def restore(self, text: str) -> tuple[str, int]:
        """The text with suspicious tokens restored, and how many changed."""
        changed = 0

        def one(m: re.Match) -> str:
            nonlocal changed
            new = self.restore_token(m[0])
            changed += new != m[0]
            return new

        return _SPACED.sub(one, text), changed


def suspicious_rows(c: Chunk) -> np.ndarray:
    """True for rows that may hold a token to restore: at least those where restore() decodes one."""
    b = np.insert(c.buf, c.offs[1:], 10)  # a break after each row
    offs = c.offs + np.arange(len(c.offs))
    flag = np.zeros(len(b), bool)
    if len(b) >= 3:
        letter, soft, low = _IS_LETTER[b], _SOFT[b], LOWER[b]
        # a sign or asterisk before the end of the body, in a token with a letter
        mark = _IS_SIGN[b] & ~soft
        mark[:-1] |= soft[:-1] & _IN_TOKEN[b[1:]] & ~soft[1:]
        at = np.flatnonzero(mark)
        if len(at):
            ends = np.flatnonzero(~_IN_TOKEN[b])  # the last byte is a break
            k = np.searchsorted(ends, at)
            first = np.where(k > 0, ends[np.maximum(k - 1, 0)] + 1, 0)
            seen = np.concatenate([[0], np.cumsum(letter)])
            flag[at] = seen[ends[k]] > seen[first]
        flag[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    if len(b) >= 5:
        word = _IS_LETTER[b] | _IS_DIGIT[b]
        alone = (word | _IS_SIGN[b]).copy()
        alone[1:] &= ~word[:-1]
        alone[:-1] &= ~word[1:]
        flag[:-4] |= alone[:-4] & alone[2:-2] & alone[4:]
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[offs[1:]] > total[offs[:-1]]


def restored(texts: pa.Array, decoder: Decoder) -> tuple[pa.Array, np.ndarray]:
    """The texts after restoration, and the number of tokens changed in each."""
    out, count = [], []
    for c in chunks(texts):
        rows = suspicious_rows(c)
        for r in range(c.rows):
            raw = c.buf[c.offs[r] : c.offs[r + 1]].tobytes()
            if rows[r]:
                text, n = decoder.restore(raw.decode("utf-8", "replace"))
                raw = text.encode("utf-8")
            else:
                n = 0
            out.append(raw)
            count.append(n)
    return pa.array(out, pa.large_binary()).cast(pa.large_string()), np.array(count, np.int64)


# --- features and model


def feature_buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the words and word beginnings of a batch, chunk by chunk."""
    for c in chunks(texts):
        w = c.words(_NOT_LETTER)
        low, row = LOWER[c.buf], w.rows() + c.first
        rows = [row]
        keys = [span_hash(low, w.starts, w.ends)]
        for p in PREFIXES:
            long = w.ends - w.starts > p
            keys.append(mix(span_hash(low, w.starts[long], w.starts[long] + p) + U64(p)))
            rows.append(row[long])
        yield np.concatenate(rows), (np.concatenate(keys) & U64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """column: for each bucket the place among the used features or -1."""

    trigrams: np.ndarray
    column: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array, n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        for row, bucket in feature_buckets(texts):
            col = self.column[bucket]
            used = col >= 0
            pair = np.unique(row[used] * (len(self.weights) + 1) + col[used])
            z += np.bincount(pair // (len(self.weights) + 1), self.weights[pair % (len(self.weights) + 1)], minlength=n)
        return 1 / (1 + np.exp(-z))


def _fit_logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, steps: int = 700, decay: float = 5e-6) -> tuple[np.ndarray, float]:
    """Full-batch Adam on sparse 0/1 features."""
    w, bias = np.zeros(width), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, w[col], minlength=len(y)))))
        d = (p - y) / len(y)
        g = np.append(np.bincount(col, d[row], minlength=width) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, sample: int = SAMPLE_ROWS) -> Model:
    """A model from at most `sample` labelled ids whose crc32 remainder is not `rest`."""
    trigrams = log_model(trigram_counts(docs))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = materialize(lowest(marks, F.xxhash64("doc_id"), sample))
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id").select("doc_id", "toxic", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(trigrams)
        hits = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            y = (b.column(1).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            for row, bucket in feature_buckets(restored(b.column(2), decoder)[0]):
                pair = np.unique(row * BUCKETS + bucket)
                np.add.at(hits, (y[pair // BUCKETS], pair % BUCKETS), 1)
        at = np.flatnonzero(hits.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hits[0, at].astype(np.int64)), pa.array(hits[1, at].astype(np.int64))], ["bucket", "clean", "toxic"])

    share = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0)).alias("t")).first()
    n, t = share["n"], share["t"]
    column = np.full(BUCKETS, -1, np.int64)
    if not n or t in (0, n):
        p = min(max(t / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Model(trigrams, column, np.zeros(0), math.log(p / (1 - p)))
    counts = known.mapInArrow(lean(tally), "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    c, x = F.col("clean") + 0.5, F.col("toxic") + 0.5
    gain = F.abs(F.log(x / (t + 1)) - F.log(c / (n - t + 1))) * F.sqrt(F.col("toxic") + F.col("clean") * (t / n))
    best = counts.where("clean + toxic >= 6").orderBy(F.desc(gain), "bucket").limit(FEATURES).select("bucket").toPandas()["bucket"].to_numpy()
    column[best] = np.arange(len(best))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(trigrams)
        for b in batches:
            cols: list[list[int]] = [[] for _ in range(b.num_rows)]
            for row, bucket in feature_buckets(restored(b.column(2), decoder)[0]):
                col = column[bucket]
                pair = np.unique(row[col >= 0] * FEATURES + col[col >= 0])
                for r, f in zip((pair // FEATURES).tolist(), (pair % FEATURES).tolist()):
                    cols[r].append(f)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols, pa.list_(pa.int32()))], ["doc_id", "toxic", "cols"])

    key = docs.schema["doc_id"].dataType.simpleString()
    mark = labels.schema["toxic"].dataType.simpleString()
    # of rows that repeat a doc_id one is enough
    table = known.mapInArrow(lean(rows), f"doc_id {key}, toxic {mark}, cols array<int>").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("cols").alias("cols")).toPandas()
    if not len(table):
        return Model(trigrams, column, np.zeros(len(best)), math.log((t + 1) / (n - t + 1)))
    y = (table["toxic"].to_numpy() > 0).astype(np.float64)
    lengths = [len(x) for x in table["cols"]]
    row = np.repeat(np.arange(len(table)), lengths)
    col = np.concatenate([np.asarray(x, np.int64) for x in table["cols"]]) if sum(lengths) else np.empty(0, np.int64)
    w, bias = _fit_logistic(row, col, y, len(best))
    return Model(trigrams, column, w, bias)


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """doc_id, score and n_restored (tokens restored) of each row; with keep_text also the restored text."""
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "score", "n_restored"] + ["restored"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.trigrams)
        for b in batches:
            texts, n = restored(b.column(1), decoder)
            cols = [b.column(0), pa.array(model.scores(texts, b.num_rows)), pa.array(n)] + [texts.cast(pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {key}, score double, n_restored bigint" + ", restored string" * keep_text
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"),
        "n_restored",
    )
