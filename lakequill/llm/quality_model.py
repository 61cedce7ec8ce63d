"""Quality scores by attention over passages (multiple-instance learning).

A document is a bag of passages of `PASSAGE_WORDS` words, whole text, the last
one shorter. Each passage is encoded from its character and word statistics; a
gated attention learns, from document labels alone, how much each passage
counts, and a logistic layer scores the weighted mean of the encodings.

The model is fitted on at most `SAMPLE_ROWS` labelled rows outside the held-out
fold, and on no more of them than have `SAMPLE_PASSAGES` passages in all; labels, lang, source and doc_id are never inputs.

Defined cases: null text counts as empty; a text without words is one passage
whose statistics are zero; every row gets one output row, repeated rows alike;
a doc_id with several labels takes the largest; without labelled rows of both
kinds all scores are the share of good labels (0.5 without labels); other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import held_out, lean, lowest, materialize
from lakequill.llm.textscan import Chunk, chunks, separators

SAMPLE_ROWS = 8_000
#: Bound on the passages that training holds in memory.
SAMPLE_PASSAGES = 400_000
PASSAGE_WORDS = 50
CUTOFF = 0.5
_CLASSES = [
    separators("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    separators("abcdefghijklmnopqrstuvwxyz"),
    separators("0123456789"),
    separators("#*$%&"),
    separators("|<>"),
    separators("!?"),
    separators(".,;:"),
    separators("\"'()[]{}-_/\\=+~^`@"),
    np.arange(256) >= 128,
    separators("\n"),
]
WIDTH = len(_CLASSES) + 7


def passages(c: Chunk, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of each passage, and how many passages each row has (one at least)."""
    w = c.words()
    n = w.counts()
    each = np.maximum(-(-n // size), 1)
    row = np.repeat(np.arange(c.rows), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    a = np.minimum(w.ptr[row] + nth * size, w.ptr[row + 1])
    z = np.minimum(a + size, w.ptr[row + 1])
    some = z > a
    words = z - a
    x = np.zeros((len(row), WIDTH))
    if not len(w.starts):
        return x, each
    # bytes from the first word to the next passage, so that marks and blanks between words belong to one
    begin = w.starts[np.minimum(a, len(w.starts) - 1)]
    last = w.ends[np.maximum(z - 1, 0)]
    end = np.where(z < w.ptr[row + 1], w.starts[np.minimum(z, len(w.starts) - 1)], np.maximum(last, c.offs[row + 1]))
    begin, end = np.where(some, begin, 0), np.where(some, end, 0)
    length = np.maximum(end - begin, 1)

    def share(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[hi] - total[lo]

    for k, lut in enumerate(_CLASSES):
        x[:, k] = np.sqrt(share(lut[c.buf], begin, end) / length)
    h, size_of = w.hashes(), w.ends - w.starts
    owner = w.rows()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    again = np.zeros(len(h), bool)
    again[2:] = (h[2:] == h[:-2]) & (owner[2:] == owner[:-2])
    upper = _CLASSES[0][c.buf]
    total = np.concatenate([[0], np.cumsum(upper)])
    loud = (total[w.ends] - total[w.starts]) * 2 > size_of
    some_words = np.maximum(words, 1)
    k = len(_CLASSES)
    x[:, k] = share(same, a, z) / some_words
    x[:, k + 1] = share(again, a, z) / some_words
    x[:, k + 2] = share(loud, a, z) / some_words
    x[:, k + 3] = np.log1p(share(size_of, a, z) / some_words)
    x[:, k + 4] = share(size_of <= 3, a, z) / some_words
    x[:, k + 5] = np.log1p(words)
    # distinct words of the passage
    number = np.repeat(np.arange(len(row)), words)
    order = np.lexsort((h, number))
    fresh = np.ones(len(h), bool)
    fresh[order[1:]] = (h[order][1:] != h[order][:-1]) | (number[order][1:] != number[order][:-1])
    x[:, k + 6] = np.bincount(number, fresh, minlength=len(row)) / some_words
    x[~some] = 0
    return x, each


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        first = np.cumsum(each) - each
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), each))
        att = e / np.repeat(np.add.reduceat(e, first), each)
        z = np.add.reduceat(att[:, None] * h, first)
        y = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        return {"x": x, "h": h, "t": t, "s": s, "att": att, "z": z, "y": y}

    def scores(self, x: np.ndarray, each: np.ndarray) -> np.ndarray:
        return self.forward(x, each)["y"] if len(each) else np.empty(0)


def _gradients(p: dict, f: dict, each: np.ndarray, y: np.ndarray, decay: float) -> dict:
    ds = (f["y"] - y) / len(y)
    first = np.cumsum(each) - each
    dz = np.repeat(ds[:, None] * p["c"], each, axis=0)
    da = (dz * f["h"]).sum(1)
    dh = f["att"][:, None] * dz
    de = f["att"] * (da - np.repeat(np.add.reduceat(f["att"] * da, first), each))
    dg = de[:, None] * p["a"]
    dt, du = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    dh = (dh + dt @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
    g = {"w": f["x"].T @ dh, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ du, "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum()}
    return {k: v + decay * p[k] * (k not in "bd") for k, v in g.items()}


def train(x: np.ndarray, each: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 300, epochs: int = 15, batch: int = 256, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam over batches of bags, `epochs` times through and `steps` steps at least; y holds 0 or 1 for each bag."""
    rng = np.random.default_rng(seed)
    start = {"w": (x.shape[1], hidden), "v": (hidden, gate), "u": (hidden, gate)}
    p = {k: rng.normal(0, 1 / math.sqrt(s[0]), s) for k, s in start.items()}
    p |= {"b": np.zeros(hidden), "a": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(())}
    model = Model(x.mean(0), x.std(0) + 1e-3, p)
    # bags in random order, so that consecutive ones make a batch
    order = rng.permutation(len(each))
    first = np.cumsum(each) - each
    x = x[np.concatenate([np.arange(first[i], first[i] + each[i]) for i in order])]
    each, y = each[order], y[order]
    ends = np.concatenate([[0], np.cumsum(each)])
    cuts = list(range(0, len(each), batch))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    total = max(steps, epochs * len(cuts))
    for t in range(1, total + 1):
        i = cuts[(t - 1) % len(cuts)]
        j = min(i + batch, len(each))
        g = _gradients(p, model.forward(x[ends[i] : ends[j]], each[i:j]), each[i:j], y[i:j], decay)
        rate = 0.03 * (1 - 0.9 * t / total)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-9)
    return model


def _constant(p: float) -> Model:
    p = min(max(p, 1e-9), 1 - 1e-9)
    parts = {"w": np.zeros((WIDTH, 1)), "b": np.zeros(1), "v": np.zeros((1, 1)), "u": np.zeros((1, 1)), "a": np.zeros(1), "c": np.zeros(1), "d": np.array(math.log(p / (1 - p)))}
    return Model(np.zeros(WIDTH), np.ones(WIDTH), parts)


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, sample: int = SAMPLE_ROWS) -> Model:
    """A model from at most `sample` labelled ids whose crc32 remainder is not `rest`."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    marks = marks.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("good"))
    marks = materialize(lowest(marks, F.xxhash64("doc_id"), sample))
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id").select("doc_id", "good", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c in chunks(b.column(2)):
                x, each = passages(c)
                at = np.cumsum(each) - each
                out += [x[s : s + n].astype(np.float32).tobytes() for s, n in zip(at, each)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "good", "bag"])

    key = docs.schema["doc_id"].dataType.simpleString()
    # of rows that repeat a doc_id one is enough
    found = known.mapInArrow(lean(bags), f"doc_id {key}, good int, bag binary").groupBy("doc_id").agg(F.max("good").alias("good"), F.min("bag").alias("bag"))
    found = materialize(found.withColumn("each", F.expr(f"octet_length(bag) div {4 * WIDTH}")))
    # the window runs over the bounded sample's counts, without its passages
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fit_in = found.select("doc_id", F.sum("each").over(before).alias("total")).where(F.col("total") <= SAMPLE_PASSAGES).select("doc_id")
    table = found.join(F.broadcast(fit_in), "doc_id").orderBy("doc_id").toPandas()
    y = table["good"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.5)
    parts = [np.frombuffer(bytes(b), np.float32).reshape(-1, WIDTH) for b in table["bag"]]
    return train(np.concatenate(parts).astype(np.float64), np.array([len(p) for p in parts]), y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_passages and the number of the passage that counts most."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, n, top = [np.empty(0)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for c in chunks(b.column(1)):
                x, each = passages(c)
                f = model.forward(x, each)
                first = np.cumsum(each) - each
                most = f["att"] == np.repeat(np.maximum.reduceat(f["att"], first), each)
                nth = np.where(most, np.arange(len(most)), len(most))
                y.append(f["y"])
                n.append(each)
                top.append(np.minimum.reduceat(nth, first) - first)
            cols = [b.column(0), *(pa.array(np.concatenate(v)) for v in (y, n, top))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "n_passages", "top_passage"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {key}, score double, n_passages bigint, top_passage bigint")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "n_passages", "top_passage")
