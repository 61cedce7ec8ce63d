"""Exact top-k inner products over norm-sorted blocks.

Vectors are dealt into blocks by descending length, and blocks into levels that
grow by `GROWTH`. Queries run against one level at a time. After a level each
query knows its k-th best score, and so the least length that can still reach
it (Cauchy-Schwarz); queries are blocked by that length, and a block of queries
is sent only to blocks of candidates whose longest vector is long enough. Pairs
of blocks that fail this are never shuffled, and queries that no later vector
can reach drop out. The first level is the one block of the longest vectors.

Within a pair of blocks a query meets vectors by descending length and stops
where |q| times the next length cannot reach its k-th best score. The others
are rotated by the singular vectors of all candidates, so that a few leading
coordinates carry most of a product: the partial product plus the
Cauchy-Schwarz bound of the residuals prunes, and only survivors get the exact
integer product.

Defined cases: null vectors and vectors with null or non-finite components take
no part, nor do rows without an id, nor finite vectors whose scaled components
overflow a double; vectors compare only with vectors of their own dimension;
rows that repeat an id are rows of their own, each a candidate for the others;
products beyond 2**53 are computed with whole numbers and saturate at the range
of a long; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import lean, materialize

#: Vectors in a block, of candidates and of queries; fewer where they are long.
BLOCK = 4096
BLOCK_BYTES = 32 << 20
#: Each level holds so many times the blocks of those before.
GROWTH = 8
STEP = 256
#: Rotations are computed up to this dimension: their size is its square.
ROTATED = 2048
_EXACT = 2.0**53
_IDS = "vec_id bigint"
_BLOCK_SCHEMA = "dim int, block bigint, edge double, rids binary, ids binary, vecs binary, reach binary"
_BLOCK_NAMES = [f.split()[0] for f in _BLOCK_SCHEMA.split(", ")]


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, dim, norm and vec: floor(scale * x) of each component as 64-bit floats, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, norms, blobs = [], [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                dims.append(len(x))
                norms.append(float(np.sqrt((x * x).sum())))
                blobs.append(x.tobytes())
            cols = [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "dim", "norm", "vec"])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(lean(run), f"{_IDS}, dim int, norm double, vec binary")


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Pack consecutive rows of each partition; partitions are already ordered by `key`.

    dim, block (ascending in the order of partitions and rows), edge (the first row's key), rids, ids, vecs, reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        count = 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal count
            keys, rids, ids, vecs, reach = zip(*held.pop(dim))
            cols = [
                pa.array([dim], pa.int32()),
                pa.array([(part << 32) + count], pa.int64()),
                pa.array([keys[0]], pa.float64()),
                pa.array([np.array(rids, np.int64).tobytes()], pa.binary()),
                pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                pa.array([b"".join(vecs)], pa.binary()),
                pa.array([np.array(reach, np.float64).tobytes()], pa.binary()),
            ]
            count += 1
            return pa.RecordBatch.from_arrays(cols, _BLOCK_NAMES)

        for b in batches:
            for dim, *row in zip(*(b.column(c).to_pylist() for c in range(6))):
                mine = held.setdefault(dim, [])
                mine.append(row)
                if len(mine) >= max(1, min(size, BLOCK_BYTES // max(8 * dim, 1))):
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return rows.select("dim", key, "rid", "vec_id", "vec", "reach").mapInArrow(lean(run), _BLOCK_SCHEMA)


def _open(dim: int, rids: bytes, ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.frombuffer(rids, np.int64)
    return r, np.frombuffer(ids, np.int64), np.frombuffer(vecs, np.float64).reshape(len(r), dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows a[i] and b[i], as int64."""
    if not len(a) or not a.shape[1]:
        return np.zeros(len(a), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    whole = [sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a, b)]
    return np.array([min(max(v, low), high) for v in whole], np.int64)


class _Best:
    """The k best (score, id, rid) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.rid = np.full((n, k), -1)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        for i in np.unique(q):
            m = q == i
            s = np.concatenate([self.score[i], score[m]])
            d = np.concatenate([self.id[i], ids[m]])
            r = np.concatenate([self.rid[i], rids[m]])
            # ~s descends as s ascends, without overflow
            top = np.lexsort((r, d, ~s, r < 0))[: self.k]
            self.score[i], self.id[i], self.rid[i] = s[top], d[top], r[top]

    def floor(self) -> np.ndarray:
        """The k-th score, minus infinity where there are fewer."""
        return np.where(self.rid[:, -1] < 0, -np.inf, self.score[:, -1].astype(np.float64))


def search_block(queries, block, reach: np.ndarray, rotation: np.ndarray | None, lead: int, k: int) -> _Best:
    """The k best of `block` for each query, as far as they attain its `reach` (a k-th best score known before)."""
    q_rid, _, q = queries
    rid, ids, x = block
    best = _Best(len(q), k)
    if not len(q) or not len(x):
        return best
    norm = np.sqrt((x * x).sum(1))
    order = np.argsort(-norm, kind="stable")
    rid, ids, x, norm = rid[order], ids[order], x[order], norm[order]
    q_norm = np.sqrt((q * q).sum(1))
    qr, xr = (q, x) if rotation is None else (q @ rotation, x @ rotation)
    q_rest, x_rest = (np.sqrt((v[:, lead:] ** 2).sum(1)) for v in (qr, xr))
    for at in range(0, len(x), STEP):
        part = slice(at, at + STEP)
        floor = np.maximum(reach, best.floor())
        slack = 1e-9 * (q_norm * norm[at] + 1) + 1e-6
        live = np.flatnonzero(q_norm * norm[at] + slack >= floor)
        if not len(live):
            break
        bound = qr[live, :lead] @ xr[part, :lead].T + q_rest[live, None] * x_rest[None, part]
        i, j = np.nonzero(bound + slack[live, None] >= floor[live, None])
        i, j = live[i], j + at
        other = q_rid[i] != rid[j]
        i, j = i[other], j[other]
        for a in range(0, len(i), 1 << 16):
            ii, jj = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            score = _products(q[ii], x[jj])
            keep = score >= np.maximum(reach, best.floor())[ii] - slack[ii]
            best.add(ii[keep], score[keep], ids[jj[keep]], rid[jj[keep]])
    return best


def block_pairs(asked: DataFrame, level: DataFrame) -> DataFrame:
    """(dim, block, asking): blocks of candidates whose longest vector can reach a query of a block of queries."""
    left = level.select("dim", "block", "edge")
    right = asked.select("dim", F.col("block").alias("asking"), F.col("edge").alias("need"))
    return left.join(right, "dim").where("edge >= need").select("dim", "block", "asking")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, trace: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products for every row where `is_query` holds.

    `is_query` may name vec_id. Queries run against all rows, a block of queries at a time. `trace`
    takes, for each level, how many blocks it has and how many of them met any query.
    """
    ints = materialize(quantized(vectors).withColumn("rid", F.monotonically_increasing_id()))
    parts = max(1, -(-ints.count() // BLOCK))
    order = [F.desc("norm"), F.col("vec_id"), F.col("rid")]
    rows = ints.withColumn("reach", F.lit(0.0)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = materialize(_blocks(rows, "norm", BLOCK))
    nth = F.row_number().over(Window.partitionBy("dim").orderBy("block")) - 1
    level = F.when(nth == 0, 0).otherwise(1 + F.floor(F.log(nth.cast("double")) / math.log(GROWTH) + 1e-9)).cast("int")
    known = materialize(blocks.select("dim", "block", "edge").withColumn("level", level))
    levels = known.agg(F.max("level")).first()[0]
    spins = _rotations(blocks)
    queries = materialize(ints.where(is_query))
    schema = "q_rid bigint, query_id bigint, vec_id bigint, score bigint, rid bigint"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in names]
        for row in left.to_pylist():
            dim = row["dim"]
            rotation, lead = spins.get(dim, (None, dim))
            for asking in right.to_pylist():
                mine = _open(dim, asking["rids"], asking["ids"], asking["vecs"])
                reach = np.frombuffer(asking["reach"], np.float64)
                best = search_block(mine, _open(dim, row["rids"], row["ids"], row["vecs"]), reach, rotation, lead, k)
                i, j = np.nonzero(best.rid >= 0)
                for c, a in zip(cols, (mine[0][i], mine[1][i], best.id[i, j], best.score[i, j], best.rid[i, j])):
                    c.append(a)
        return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for n, c in zip(names, cols)})

    ranked = F.row_number().over(Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid"))
    best: DataFrame | None = None
    for at in range((levels if levels is not None else -1) + 1):
        here = known.where(F.col("level") == at)
        longest = here.groupBy("dim").agg(F.max("edge").alias("longest"))
        live = queries.withColumn("reach", F.lit(None).cast("double"))
        if best is not None:
            full = best.groupBy("q_rid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("reach")).where(F.col("n") >= k)
            live = queries.join(full.select(F.col("q_rid").alias("rid"), "reach"), "rid", "left")
        # a k-th best score of 0 or less may be met by vectors of any length
        need = F.when((F.col("reach") > 0) & (F.col("norm") > 0), F.col("reach") / F.col("norm") * (1 - 1e-9)).otherwise(0.0)
        live = live.withColumns({"need": need, "reach": F.coalesce("reach", F.lit(-math.inf))})
        live = materialize(live.join(longest, "dim").where("longest >= need").drop("longest"))
        n = live.count()
        if not n:
            if trace is not None:
                trace.append((here.count(), 0))
            continue
        by = [F.col("need"), F.col("rid")]
        asked = materialize(_blocks(live.repartitionByRange(-(-n // BLOCK), *by).sortWithinPartitions(*by), "need", BLOCK))
        pairs = materialize(block_pairs(asked, here))
        if trace is not None:
            trace.append((here.count(), pairs.select("dim", "block").distinct().count()))
        left = blocks.join(pairs, ["dim", "block"]).groupBy("dim", "block", "asking")
        right = asked.withColumnRenamed("block", "asking").join(pairs, ["dim", "asking"]).groupBy("dim", "block", "asking")
        found = left.cogroup(right).applyInArrow(run, schema)
        found = found if best is None else found.unionByName(best)
        best = materialize(found.withColumn("nth", ranked).where(F.col("nth") <= k).drop("nth"))
    if best is None:
        best = ints.select(*[F.lit(0).cast("bigint").alias(n) for n in names]).where("false")
    return best.withColumn("rank", ranked).select("query_id", "rank", "vec_id", "score")


def _rotations(blocks: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """For each dimension up to ROTATED, the right singular vectors of all candidates and how many of them lead.

    The Gram matrix has dim * dim entries whatever the number of rows; it is summed on the executors.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, vecs in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(vecs.as_buffer(), np.float64).reshape(-1, dim)
                total[dim] = total.get(dim, 0) + x.T @ x
        for dim, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(g.size, dim, np.int32)), pa.array(np.arange(g.size)), pa.array(g.ravel())], ["dim", "at", "v"])

    sums = blocks.where(f"dim > 0 and dim <= {ROTATED}").select("dim", "vecs").mapInArrow(lean(grams), "dim int, at bigint, v double")
    rows = sums.groupBy("dim", "at").agg(F.sum("v").alias("v")).toPandas()
    out: dict[int, tuple[np.ndarray, int]] = {0: (np.zeros((0, 0)), 0)}
    for dim, part in rows.groupby("dim"):
        g = np.zeros(dim * dim)
        g[part["at"].to_numpy()] = part["v"].to_numpy()
        values, basis = np.linalg.eigh(g.reshape(dim, dim))
        order = np.argsort(-values)
        share = np.cumsum(np.maximum(values[order], 0)) / max(values.clip(0).sum(), 1e-300)
        lead = min(dim, max(1, int(np.searchsorted(share, 0.9)) + 1))
        out[int(dim)] = (basis[:, order], lead)
    return out


def op9(vectors: DataFrame) -> DataFrame:
    return exact_topk(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
