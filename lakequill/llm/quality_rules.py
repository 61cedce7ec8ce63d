"""Rule statistics of whole texts and an isolation forest over them.

Trees are grown on the statistics themselves, on a bounded sample of labelled
rows (`SAMPLE_ROWS`) taken without regard to their labels. They come in groups:
one for each statistic, whose trees split that statistic at random points, and
one whose trees split all of them. A document's score in a group follows from
its mean path length there; each group has a threshold of its own, calibrated
on all labelled rows, and a document that reaches one is anomalous.

Defined cases: null text counts as empty; an empty or very short text fails the
base rule; every row gets one output row, repeated rows alike; without labelled
rows of both kinds the forest rejects nothing; labels for one doc_id that
repeat count by their largest value; clashing column names of the input are
ignored by the statistics and kept by `filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakequill.llm.common import lean, lowest, materialize
from lakequill.llm.textscan import BLANKS, Chunk, chunks, mix, ngrams, second_base, separators, span_hash

SYMBOLS = separators("#*$%&|<>")
#: Bound on the labelled rows that the forest's trees draw from.
SAMPLE_ROWS = 8192
#: Trees in each group, and the rows that each isolates: few, so that frequent junk does not hide itself.
TREES = 50
TREE_ROWS = 64
#: Share of labelled good documents that the calibrated threshold may reject.
GOOD_LOSS = 0.002
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["f_word_len", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_distinct"]
_UPPER = separators("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _repeats(key: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _firsts(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True at one representative of each (row, a, b)."""
    order = np.lexsort((b, a, row))
    fresh = np.ones(len(row), bool)
    o = order
    fresh[o[1:]] = (row[o][1:] != row[o][:-1]) | (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
    return fresh


def _sum_at(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def chunk_stats(c: Chunk) -> dict[str, np.ndarray]:
    words = c.words()
    row = words.rows()
    n = words.counts()
    lead = (c.buf & 0xC0) != 0x80
    word_chars = _sum_at(lead & ~BLANKS[c.buf], c.offs)
    h = words.hashes()

    # lines: a break at \n and at each row's end
    cut = np.flatnonzero(c.buf == 10)
    starts = np.concatenate([c.offs[:-1], cut + 1])
    line_row = np.concatenate([np.arange(c.rows), np.searchsorted(c.offs, cut, "right") - 1])
    order = np.argsort(starts, kind="stable")
    # equal starts: an empty row, or a row that begins where the previous one's last \n ends
    order = order[np.lexsort((line_row[order], starts[order]))]
    starts, line_row = starts[order], line_row[order]
    row_end = c.offs[1:][line_row]
    ends = np.minimum(np.append(starts[1:], len(c.buf)), row_end)
    broken = (ends > starts) & (ends <= row_end)
    broken[broken] = (c.buf[ends[broken] - 1] == 10)
    ends = ends - broken
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, line_row = starts[filled], ends[filled], line_row[filled]
    fresh = _firsts(line_row, span_hash(c.buf, starts, ends), span_hash(c.buf, starts, ends, second_base()))
    n_lines = np.bincount(line_row, minlength=c.rows)
    n_dup = np.bincount(line_row[~fresh], minlength=c.rows)

    covered = np.zeros(len(h) + 1, np.int64)
    grams = ngrams(h, 5)
    if len(grams):
        whole = np.flatnonzero(row[: len(grams)] == row[4:])
        again = whole[_repeats(mix(grams[whole] + row[whole].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))]
        np.add.at(covered, again, 1)
        np.subtract.at(covered, again + 5, 1) if len(again) else None
    covered = np.cumsum(covered[:-1]) > 0
    n_repeat = np.bincount(row[covered], minlength=c.rows)
    distinct = np.bincount(row[_firsts(row, h, h)], minlength=c.rows) if len(h) else np.zeros(c.rows, np.int64)

    some = np.maximum(n, 1)
    chars = np.maximum(word_chars, 1)
    symbols = _sum_at(SYMBOLS[c.buf], c.offs)
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        # drawn towards five letters, and few repeats, where there is little text
        "f_word_len": np.log1p((word_chars + 250) / (n + 50)),
        "f_symbols": np.log1p(10 * symbols / some),
        "f_dup_lines": n_dup / (n_lines + 5),
        "f_repeats": n_repeat / some,
        "f_upper": _sum_at(_UPPER[c.buf], c.offs) / chars,
        # shorter texts repeat fewer words: compare with what the length allows
        "f_distinct": distinct / some**0.85,
    }


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    parts = [chunk_stats(c) for c in chunks(texts)]
    names = COUNTS + FEATURES
    if not parts:
        return {k: np.empty(0, np.int64 if k in COUNTS else np.float64) for k in names}
    return {k: np.concatenate([p[k] for p in parts]) for k in names}


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id with the rule statistics of each row's whole text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for c in COUNTS:
        schema = schema.add(c, T.LongType())
    for c in FEATURES:
        schema = schema.add(c, T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = text_stats(batch.column(1))
            cols = [pa.array(stats[c].astype(np.int64)) for c in COUNTS] + [pa.array(stats[c].astype(np.float64)) for c in FEATURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


# --- isolation forest


@dataclass
class Forest:
    """Trees as flat arrays of equal length; `group` numbers the group of each tree.

    threshold: scores at or above it are anomalous, for each group.
    """

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    length: np.ndarray
    group: np.ndarray
    norm: float
    depth: int
    threshold: np.ndarray

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row in each group."""
        total, rows = np.zeros((len(x), len(self.threshold))), np.arange(len(x))
        for t, g in enumerate(self.group):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = x[rows, self.feature[t, node]] >= self.split[t, node]
                node = self.child[t, node] + right * (self.child[t, node] != node)
            total[:, g] += self.length[t, node]
        return total / np.maximum(np.bincount(self.group, minlength=len(self.threshold)), 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length), in (0, 1), of each row in each group."""
        if not len(x) or not len(self.group):
            return np.zeros((len(x), len(self.threshold)))
        return 2.0 ** (-self.paths(x) / self.norm)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """How far the score lies above its threshold in the group where it is highest; from 0 on a row is anomalous."""
        return np.maximum(self.scores(x) - self.threshold, -1).max(1) if len(self.threshold) else np.full(len(x), -1.0)


def _average_path(n: int) -> float:
    """Mean depth of a row in a random tree that isolates n rows."""
    return 0.0 if n < 2 else 2 * sum(1 / k for k in range(1, n)) - 2 * (n - 1) / n


def statistic_groups(width: int) -> list[list[int]]:
    """Each statistic for itself, then all together."""
    return [[j] for j in range(width)] + [list(range(width))] * (width > 1)


def grow_forest(x: np.ndarray, groups: list[list[int]], trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7, drawn: list | None = None) -> Forest:
    """`trees` trees for each group of statistics; `drawn` takes the rows that each tree isolates."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    room = 2 ** (depth + 1)
    group = np.repeat(np.arange(len(groups)), trees if rows >= 2 else 0)
    shape = (len(group), room)
    feature, split = np.zeros(shape, np.int64), np.full(shape, np.inf)
    child, length = np.tile(np.arange(room), (shape[0], 1)), np.zeros(shape)
    for t, g in enumerate(group):
        sample = x[rng.choice(len(x), rows, replace=False)]
        if drawn is not None:
            drawn.append(sample)
        used, todo = 1, [(0, sample, 0)]
        while todo:
            node, part, level = todo.pop()
            low, high = part.min(0), part.max(0)
            open_ = [j for j in groups[g] if high[j] > low[j]]
            if level == depth or len(part) < 2 or not open_:
                length[t, node] = level + _average_path(len(part))
                continue
            f = rng.choice(open_)
            feature[t, node], split[t, node] = f, rng.uniform(low[f], high[f])
            child[t, node], used = used, used + 2
            right = part[:, f] >= split[t, node]
            todo += [(used - 2, part[~right], level + 1), (used - 1, part[right], level + 1)]
    return Forest(feature, split, child, length, group, max(_average_path(rows), 1e-9), depth, np.full(len(groups), np.inf))


def _features(batch: pa.RecordBatch, at: list[int]) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at])


def score_stats(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats and `anomaly`; from 0 on a row is anomalous."""
    schema = T.StructType(list(stats.schema.fields)).add("anomaly", T.DoubleType())
    at = [stats.columns.index(c) for c in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.anomaly(_features(b, at)))], schema.names)

    return stats.mapInArrow(lean(run), schema)


def base_failed(n_words="n_words", n_repeat="n_repeat_words"):
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat) > 20 * F.col(n_words))


#: Steps of the score in which thresholds are sought.
BINS = 2000


def _tally(known: DataFrame, forest: Forest) -> np.ndarray:
    """How many good (0) and bad (1) rows fall into each bin of each group's score: counts[kind, group, bin]."""
    groups = len(forest.threshold)
    at = [known.columns.index(c) for c in FEATURES]
    mark = known.columns.index("quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, groups, BINS), np.int64)
        for b in batches:
            bad = (b.column(mark).to_numpy(zero_copy_only=False) <= 0).astype(np.int64)
            bins = np.minimum((forest.scores(_features(b, at)) * BINS).astype(np.int64), BINS - 1)
            for g in range(groups):
                np.add.at(counts, (bad, g, bins[:, g]), 1)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts.ravel()[cell])], ["cell", "n"])

    out = np.zeros(2 * groups * BINS, np.int64)
    for cell, n in known.mapInArrow(lean(run), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).toPandas().itertuples(index=False):
        out[cell] = n
    return out.reshape(2, groups, BINS)


def threshold(good: np.ndarray, bad: np.ndarray, allowed: float) -> float:
    """Of the bins from which on at most `allowed` good rows lie, the one with the largest surplus of bad over good shares.

    Where several do equally well, the middle one; infinity if none has a surplus.
    """
    lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    gain = np.where(lost <= allowed, caught / max(bad.sum(), 1) - lost / max(good.sum(), 1), -1)
    if gain.max() <= 0:
        return np.inf
    return float(np.median(np.flatnonzero(gain >= gain.max() - 1e-9))) / len(good)


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, good_loss: float = GOOD_LOSS) -> Forest:
    """Grow the forest on about `sample` labelled rows at most; calibrate on all labelled rows.

    Only rows that pass the base rule are seen. `good_loss` bounds the share of good documents that
    all thresholds together may reject.
    """
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = stats.join(marks, "doc_id").where(~base_failed()).select("doc_id", "quality", *FEATURES)
    rows = lowest(known, F.xxhash64("doc_id", *FEATURES), sample).orderBy("doc_id", *FEATURES).toPandas()
    forest = grow_forest(rows[FEATURES].to_numpy(np.float64), statistic_groups(len(FEATURES)))
    good, bad = _tally(known, forest)
    groups = len(forest.threshold)
    if len(forest.group):
        allowed = good_loss * good[0].sum() / groups
        forest.threshold = np.array([threshold(good[g], bad[g], allowed) for g in range(groups)])
    return forest


def verdicts(stats: DataFrame, forest: Forest) -> DataFrame:
    """base_failed, anomaly and kept for each row of statistics."""
    return (
        score_stats(stats, forest)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < 0))
    )


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict per document. The statistics are written once and read by all three uses."""
    stats = materialize(rule_stats(docs))
    out = verdicts(stats, fit(stats, labels))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that pass the base rule and the forest."""
    stats = materialize(rule_stats(docs))
    forest = fit(stats, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = text_stats(batch.column(at))
            x = np.column_stack([s[c] for c in FEATURES]).astype(np.float64)
            failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
            yield batch.filter(pa.array(~failed & (forest.anomaly(x) < 0)))

    return docs.mapInArrow(lean(run), docs.schema)


def base_counts(docs: DataFrame) -> DataFrame:
    """The columns of `op8` that SQL can express."""
    return rule_stats(docs).select("doc_id", *COUNTS, base_failed().alias("base_failed"))


BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
m AS (SELECT doc_id, list(i) AS spots FROM g GROUP BY doc_id, g HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM m, LATERAL (SELECT unnest(spots) AS i), LATERAL (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""
