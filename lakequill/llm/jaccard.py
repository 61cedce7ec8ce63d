"""Exact Jaccard join on word n-grams, with token-combination prefixes.

Equal shingle sets are one class. For classes, a global order of shingles puts
rare ones first: shingles whose hash lies in a fixed low part of the range are
counted over all documents, and those held by at most `FREQUENT` sets are rare.
Two similar sets share a shingle within the prefix that the threshold leaves
free, so a set with enough rare shingles is indexed under single ones, and of
those only the ones that some other set holds; such a key has few members and
its pairs are verified one by one.

A set with too few rare shingles is also indexed under combinations: all its
other shingles, dealt by hash into more parts than two similar sets have
differing shingles. Then some parts are equal in both sets, and each part, a
combination of several shingles, is a key. Large groups of copies meet here.
Their keys are not expanded into pairs: buckets send one member for each key,
members of a key are chained into clusters, and a cluster is cut into blocks.
A block is verified by one matrix product and yields a spanning forest of its
links; one set stands for each component found, and these meet in blocks again
while their number halves. Where a cluster of several blocks is not one component
by then, the sets outside its largest component meet all others, a pair of blocks
at a time: a set that stands for others need not have their links.
A group of true copies thus costs about its size, and one task's memory does not
grow with the square of a group. Rows and shuffled text do, as N*N/256, where most
of N sets lie outside the largest component. No cap is set anywhere.

Shingles are 64-bit hashes of lower-cased (A-Z) words. The threshold must be at
least 3/4, so that a set has more shingles than it has parts.

Defined cases: documents without words or text have no shingles and no links;
with fewer words than `k`, the whole sequence is the one shingle; a null doc_id
takes no part and has no component; rows that share a doc_id are one node of
the graph; other columns are ignored by `join` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import lean, materialize, parts_for, release_memory
from lakequill.llm.textscan import U64, chunks, mix, ngrams, pack, pack_sorted, unpack, unpack_sorted

FREQUENT = 16
BUCKET_BYTES = 2 << 20
#: Sets in a block of a cluster, and token columns in a matrix product.
BLOCK = 256
COLUMNS = 8192
_OUT = "kind int, at int, bucket int, keys binary, sids binary, sizes binary, text string"


@dataclass(frozen=True)
class Likeness:
    """Sets link when den * |common| >= num * |union|."""

    k: int = 3
    num: int = 90
    den: int = 100

    def __post_init__(self):
        if not 0.75 <= self.num / self.den <= 1:
            raise ValueError("the threshold must lie between 3/4 and 1")

    def free(self, n):
        """How many of n shingles a similar set may lack."""
        return n - -(-self.num * n // self.den)

    def apart(self, n):
        """How many shingles two similar sets may not share, in all, if one has n."""
        return n * (self.den - self.num) // self.num

    def low(self) -> int:
        """Hashes below this bound are counted: 2.5 prefixes' worth."""
        return min((1 << 64) - 1, (1 << 64) * 5 * (self.den - self.num) // (2 * self.den))

    def bands(self, n: int) -> list[tuple[int, int]]:
        """(band, parts to spare) of a set of n: similar sets have a band in common.

        Bands grow by the ratio that the threshold allows. A band serves pairs whose smaller set is in
        it, so a set is in its own band and in the one below. The second number is how many shingles
        such a pair may not share.
        """
        edges, out = [1, 2], []
        while edges[-1] <= n:
            edges.append(edges[-1] * self.den // self.num + 1)
        for i in (len(edges) - 2, len(edges) - 3):
            if i >= 0:
                out.append((i, self.apart(edges[i + 1] - 1)))
        return out

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def sizes_fit(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, ascending in each row, and each row's range (ptr)."""
    parts, sizes = [], []
    for c in chunks(texts, 1 << 20):
        words = c.words()
        h, row, n = words.hashes(lower=True), words.rows(), words.counts()
        grams = ngrams(h, k)
        whole = np.flatnonzero(row[: len(grams)] == row[k - 1 :]) if len(grams) else np.empty(0, np.int64)
        keys, rows = [grams[whole]], [row[whole]]
        for w in range(1, k):
            short = np.flatnonzero(n == w)
            if len(short):
                keys.append(mix(ngrams(h, w)[words.ptr[short]] + U64(w)))
                rows.append(short)
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])[: len(key)]
        parts.append(key[fresh])
        sizes.append(np.bincount(row[fresh], minlength=c.rows))
    key = np.concatenate(parts) if parts else np.empty(0, U64)
    size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    return key, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def set_ids(key: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set, as int64; rows with equal sets have equal names."""
    total = np.concatenate([[U64(0)], np.cumsum(mix(key), dtype=U64)])
    return mix((total[ptr[1:]] - total[ptr[:-1]]) ^ mix(np.diff(ptr).astype(U64))).view(np.int64)


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _cuts(a: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    if not len(a):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


class _Sets:
    """The distinct sets of one bucket's documents."""

    def __init__(self, table: pa.Table, k: int):
        texts = table["text"].combine_chunks()
        key, ptr = shingle_sets(texts, k)
        sid = set_ids(key, ptr)
        filled = np.flatnonzero(np.diff(ptr))
        _, one = np.unique(sid[filled], return_index=True)
        self.rows = filled[one]
        self.sid = sid[self.rows]
        self.texts = texts
        self.sets = [key[ptr[r] : ptr[r + 1]] for r in self.rows]
        self.size = np.diff(ptr)[self.rows]


def _table(kind, cols: dict[str, list]) -> pa.Table:
    kinds = {"kind": pa.int32(), "at": pa.int32(), "bucket": pa.int32(), "keys": pa.binary(), "sids": pa.binary(), "sizes": pa.binary(), "text": pa.string()}
    n = len(next(iter(cols.values())))
    return pa.table([pa.array(cols.get(c, [kind] * n if c == "kind" else [None] * n), t) for c, t in kinds.items()], names=list(kinds))


def combinations(tokens: np.ndarray, like: Likeness, n: int) -> np.ndarray:
    """Keys of the parts of a set of n shingles, of which `tokens` are not rare.

    A round deals the tokens into d + e parts, where similar sets differ in at most d shingles: e
    parts at least are equal. With fewer than e empty parts one of the equal ones has tokens. Until
    that holds, further rounds deal anew; the round where it first holds for either set of a pair
    was played by both.
    """
    out = []
    for band, d in like.bands(n):
        spare = 1 + d // 8
        parts = d + spare
        for turn in range(64):
            salt = U64((band * 64 + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
            h = mix(tokens ^ salt)
            part = (h % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = _cuts(part[order])[:-1]
            sums = np.add.reduceat(mix(h[order] + U64(7)), cuts)
            out.append(mix(sums ^ mix(part[order][cuts].astype(U64) ^ salt)))
            if parts - len(cuts) < spare:
                break
        else:
            out.append(np.array([band], U64))
    return np.concatenate(out)


def _keys_of(s: _Sets, like: Likeness, known: np.ndarray, level: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Single keys and combination keys, each with the number of the set that it belongs to."""
    low = U64(like.low())
    out: tuple[list, list] = ([np.empty(0, U64)], [np.empty(0, U64)])
    owner: tuple[list, list] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)])

    def put(kind: int, keys: np.ndarray, i: int) -> None:
        out[kind].append(keys)
        owner[kind].append(np.full(len(keys), i))

    for i, tokens in enumerate(s.sets):
        n = len(tokens)
        cut = int(np.searchsorted(tokens, low))
        near = tokens[:cut]
        if len(known):
            spot = np.minimum(np.searchsorted(known, near), len(known) - 1)
            df = np.where(known[spot] == near, level[spot], 0)
        else:
            df = np.zeros(cut, np.uint8)
        rare = df < 255
        prefix = like.free(n) + 1
        order = np.argsort(df[rare], kind="stable")[:prefix]
        held = df[rare][order] > 0
        put(0, near[rare][order][held], i)
        # a set of which all similar sets are equal needs no key: equal sets are one class
        if rare.sum() < prefix and like.bands(n)[0][1]:
            put(1, combinations(np.concatenate([near[~rare], tokens[cut:]]), like, n), i)
    return tuple((np.concatenate(k), np.concatenate(o)) for k, o in zip(out, owner))


def candidates_table(docs: DataFrame, like: Likeness) -> DataFrame:
    """Written table of what buckets know: members of single keys (kind 0), one member of each combination key (1),
    chains of members of such a key within the bucket (2), and the texts of indexed sets (3)."""
    n = parts_for(docs, BUCKET_BYTES)
    rows = docs.where("doc_id is not null").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("bucket"))

    def count(table: pa.Table) -> pa.Table:
        release_memory()
        s = _Sets(table, like.k)
        near = [t[: np.searchsorted(t, U64(like.low()))] for t in s.sets]
        key, times = np.unique(np.concatenate(near), return_counts=True) if near else (np.empty(0, U64), np.empty(0, np.int64))
        cuts = _cuts(shard := _shard(key, n))
        cols = {
            "at": [int(shard[a]) for a in cuts[:-1]],
            "bucket": [table["bucket"][0].as_py()] * (len(cuts) - 1),
            "keys": [pack_sorted(key[a:b]) for a, b in zip(cuts[:-1], cuts[1:])],
            "sizes": [pack(times[a:b].astype(np.uint32)) for a, b in zip(cuts[:-1], cuts[1:])],
        }
        return _table(0, cols)

    def totals(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(b) for b in table["keys"].to_pylist()]
        src = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key = np.concatenate(keys)
        times = np.concatenate([unpack(b, np.uint32) for b in table["sizes"].to_pylist()]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        cuts = _cuts(key[order])
        total = np.repeat(np.add.reduceat(times[order], cuts[:-1]), np.diff(cuts)) if len(key) else times
        keep = total > 1
        order, total = order[keep], total[keep]
        level = np.where(total > FREQUENT, 255, np.ceil(np.log2(np.maximum(total, 2))) + 1).astype(np.uint8)
        back = np.lexsort((key[order], src[order]))
        order, level = order[back], level[back]
        cuts = _cuts(src[order])
        bucket = table["bucket"].to_pylist()
        cols = {
            "bucket": [bucket[src[order[a]]] for a in cuts[:-1]],
            "keys": [pack_sorted(key[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])],
            "sizes": [pack(level[a:b]) for a, b in zip(cuts[:-1], cuts[1:])],
        }
        return _table(0, cols)

    def index(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(0, {"at": []})
        release_memory()
        s = _Sets(table, like.k)
        known, level = np.empty(0, U64), np.empty(0, np.uint8)
        if back.num_rows:
            known = np.concatenate([unpack_sorted(b) for b in back["keys"].to_pylist()])
            level = np.concatenate([unpack(b, np.uint8) for b in back["sizes"].to_pylist()])
            order = np.argsort(known)
            known, level = known[order], level[order]
        out, used, bucket = [], [], table["bucket"][0].as_py()
        for kind, (key, owner) in enumerate(_keys_of(s, like, known, level)):
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            if kind:
                # exact duplicates of a key and owner are chained to themselves, which does no harm
                same = np.flatnonzero(key[1:] == key[:-1])
                if len(same):
                    out.append(_table(2, {"sids": [pack(s.sid[owner[same]])], "keys": [pack(s.sid[owner[same + 1]])]}))
                used.append(owner)
                first = _cuts(key)[:-1]
                key, owner = key[first], owner[first]
            used.append(owner)
            cuts = _cuts(shard := _shard(key, n))
            cols = {
                "at": [int(shard[a]) for a in cuts[:-1]],
                "bucket": [bucket] * (len(cuts) - 1),
                "keys": [pack_sorted(key[a:b]) for a, b in zip(cuts[:-1], cuts[1:])],
                "sids": [pack(s.sid[owner[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])],
                "sizes": [pack(s.size[owner[a:b]].astype(np.int32)) for a, b in zip(cuts[:-1], cuts[1:])],
            }
            out.append(_table(kind, cols))
        used = np.unique(np.concatenate(used))
        out.append(_table(3, {"sids": [pack(s.sid[i : i + 1]) for i in used], "text": [s.texts[int(s.rows[i])].as_py() for i in used]}))
        return pa.concat_tables(out)

    dealt = rows.groupBy("bucket")
    counts = dealt.applyInArrow(count, _OUT)
    levels = counts.groupBy("at").applyInArrow(totals, _OUT)
    return materialize(dealt.cogroup(levels.groupBy("bucket")).applyInArrow(index, _OUT))


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a shard with their distinct members, sorted."""
    key = np.concatenate([unpack_sorted(b) for b in table["keys"].to_pylist()])
    sid = np.concatenate([unpack(b, np.int64) for b in table["sids"].to_pylist()])
    size = np.concatenate([unpack(b, np.int32) for b in table["sizes"].to_pylist()])
    order = np.lexsort((sid, key))
    key, sid, size = key[order], sid[order], size[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])[: len(key)]
    return key[fresh], sid[fresh], size[fresh]


def _pairs_of(found: DataFrame, like: Likeness) -> DataFrame:
    """Distinct (a, b) that share a single key; such a key has at most FREQUENT members."""

    def pairs(table: pa.Table) -> pa.Table:
        key, sid, size = _members(table)
        cuts = _cuts(key)
        length = np.diff(cuts)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in np.unique(length[length > 1]):
            at = cuts[:-1][length == m]
            i, j = np.triu_indices(m, 1)
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
        a, b = np.concatenate(left), np.concatenate(right)
        fit = like.sizes_fit(size[a], size[b])
        both = np.unique(np.column_stack([sid[a[fit]], sid[b[fit]]]), axis=0)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    return found.where("kind = 0").groupBy("at").applyInArrow(pairs, "a bigint, b bigint").distinct()


def _chains(found: DataFrame) -> DataFrame:
    """(a, b) that connect all members of each combination key."""

    def shard(table: pa.Table) -> pa.Table:
        key, sid, _ = _members(table)
        same = np.flatnonzero(key[1:] == key[:-1])
        both = np.unique(np.column_stack([sid[same], sid[same + 1]]), axis=0)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    def local(batches):
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both = np.unique(np.column_stack([unpack(x, np.int64), unpack(y, np.int64)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    across = found.where("kind = 1").groupBy("at").applyInArrow(shard, "a bigint, b bigint")
    within = found.where("kind = 2").select("sids", "keys").mapInArrow(lean(local), "a bigint, b bigint")
    return across.unionByName(within).where("a <> b").distinct()


def block_links(sets: list[np.ndarray], like: Likeness) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (sorted arrays), from products of their incidence matrix."""
    size = np.array([len(t) for t in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    row, col = row[shared[col]], number[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(col, (at, at + COLUMNS))
        m = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - at)), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        common += m @ m.T
    c = common.astype(np.int64)
    i, j = np.nonzero(np.triu(like.den * c >= like.num * (size[:, None] + size[None, :] - c), 1))
    root = list(range(len(sets)))
    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = x, y
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[a] = b
            out.append((x, y))
    return out


def _block_links(found: DataFrame, placed: DataFrame, like: Likeness) -> DataFrame:
    """Links among the sets of each (root, i, j) of `placed` (node, root, i, j)."""

    def verify(table: pa.Table) -> pa.Table:
        sid, one = np.unique(table["sid"].to_numpy(), return_index=True)
        key, ptr = shingle_sets(table["text"].combine_chunks().take(pa.array(one)), like.k)
        links = block_links([key[a:b] for a, b in zip(ptr[:-1], ptr[1:])], like)
        return pa.table([pa.array([int(sid[x[i]]) for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    texts = _texts(found).join(placed, F.col("sid") == F.col("node")).select("sid", "text", "root", "i", "j")
    return texts.groupBy("root", "i", "j").applyInArrow(verify, "a bigint, b bigint")


def _cluster_links(found: DataFrame, like: Likeness) -> DataFrame:
    """Links that connect all linked sets within clusters of combination keys."""

    def blocked(nodes: DataFrame, name: str, salt: int) -> DataFrame:
        """nodes with the number of their block within the cluster, and how many there are (name, n_name)."""
        n = nodes.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"n_{name}"))
        return nodes.join(n, "root").withColumn(name, F.pmod(F.xxhash64("node", F.lit(salt)), F.col(f"n_{name}")).cast("int"))

    clusters = materialize(components(_chains(found)))
    standing, links, open_, level = clusters, None, None, 0
    while True:
        placed = blocked(standing, "i", level).select("node", "root", "i", F.lit(0).alias("j"), "n_i")
        fresh = materialize(_block_links(found, placed, like))
        links = fresh if links is None else links.unionByName(fresh)
        # at the first level clusters of one block are finished; later levels see only heads
        wide = materialize(placed.where("n_i > 1").select("node", "root"))
        open_ = wide if open_ is None else open_
        before = wide.count()
        if not before:
            break
        joined = components(fresh).withColumnRenamed("root", "head")
        heads = wide.join(joined, "node", "left").select("root", F.coalesce("head", "node").alias("node")).distinct()
        standing = materialize(heads.select("node", "root"))
        level += 1
        if standing.count() * 2 > before:
            break
    if not level:
        return links
    # heads stand for others only where links are transitive: in each cluster of several blocks, the sets
    # outside the largest component found meet all sets of the cluster
    known = links.join(open_.select(F.col("node").alias("a")), "a", "left_semi")
    parts = components(known).withColumnRenamed("root", "head")
    named = materialize(open_.join(parts, "node", "left").select("node", "root", F.coalesce("head", "node").alias("head")))
    main = named.groupBy("root", "head").count().groupBy("root").agg(F.max_by("head", F.struct("count", "head")).alias("main"))
    named = materialize(named.join(main, "root"))
    odd = blocked(named.where("head <> main").select("node", "root"), "b", 0)
    rest = blocked(named.where("head = main").select("node", "root"), "b", 0)
    n_odd = odd.groupBy("root").agg(F.max("n_b").alias("n_odd"))
    n_rest = rest.groupBy("root").agg(F.max("n_b").alias("n_rest"))
    n = materialize(n_odd.join(n_rest, "root"))
    if n.isEmpty():
        return links
    # blocks of odd sets are numbered before the others, and each meets all of higher number
    odd = odd.join(n, "root").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_odd") + F.col("n_rest") - 1))).where("other <> b")
    rest = rest.join(n, "root").withColumn("b", F.col("b") + F.col("n_odd")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_odd") - 1)))
    placed = odd.select("node", "root", "b", "other").unionByName(rest.select("node", "root", "b", "other"))
    placed = placed.select("node", "root", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"))
    return links.unionByName(_block_links(found, placed, like))


def _texts(found: DataFrame) -> DataFrame:
    """(sid, text) of the indexed sets; a set of several buckets occurs several times."""

    def run(batches):
        for b in batches:
            sids = [int(unpack(x, np.int64)[0]) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), b.column(1)], ["sid", "text"])

    return found.where("kind = 3").select("sids", "text").mapInArrow(lean(run), "sid bigint, text string")


def _verified(found: DataFrame, pairs: DataFrame, like: Likeness, parts: int) -> DataFrame:
    """The pairs that link. A text travels once to each bucket of partners, not once per pair."""
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")

    home = _texts(found).withColumn("home", place("sid")).groupBy("home")

    def send(texts: pa.Table, want: pa.Table) -> pa.Table:
        at = {s: i for i, s in enumerate(texts["sid"].to_pylist())}
        seen: dict[tuple[int, int], list[int]] = {}
        for a, b, to in zip(*(want[c].to_pylist() for c in ("a", "b", "to"))):
            seen.setdefault((a, to), []).append(b)
        text = texts["text"]
        return pa.table(
            [
                pa.array([to for _, to in seen], pa.int32()),
                pa.array([a for a, _ in seen], pa.int64()),
                pa.array(list(seen.values()), pa.list_(pa.int64())),
                pa.array([text[at[a]].as_py() for a, _ in seen], pa.string()),
            ],
            names=["to", "a", "b", "text"],
        )

    def check(texts: pa.Table, asked: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if asked.num_rows:
            at = {s: i for i, s in enumerate(texts["sid"].to_pylist())}
            text, held = texts["text"], {}

            def tokens(t: str) -> np.ndarray:
                return shingle_sets(pa.array([t], pa.string()), like.k)[0]

            order = sorted(zip(asked["a"].to_pylist(), range(asked.num_rows)))
            lists = asked["b"].to_pylist()
            for a, i in order:
                mine = tokens(asked["text"][i].as_py())
                for b in lists[i]:
                    if b not in held:
                        if len(held) > 20_000:
                            held.clear()
                        held[b] = tokens(text[at[b]].as_py())
                    if like.linked(common_count(mine, held[b]), len(mine), len(held[b])):
                        links.append((a, b))
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    want = pairs.select("a", "b", place("a").alias("home"), place("b").alias("to")).groupBy("home")
    sent = home.cogroup(want).applyInArrow(send, "to int, a bigint, b array<bigint>, text string")
    return home.cogroup(sent.groupBy("to")).applyInArrow(check, "a bigint, b bigint")


#: Nodes that a task holds while it contracts edges.
HELD_NODES = 1 << 20
#: Edges that one task contracts to the end; they have at most half of the nodes that it may hold.
LAST_EDGES = HELD_NODES // 4


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from each node of a partition to the smallest one it is connected with there.

    Beyond HELD_NODES what was found so far is given out and the rest starts anew.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def edges() -> pa.RecordBatch:
        both = [(x, r) for x in root if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in both], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(root.setdefault(x, x)), find(root.setdefault(y, y))
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > HELD_NODES:
            yield edges()
            root.clear()
    yield edges()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the smallest node connected to it.

    Large-star and small-star steps alternate, and between them each partition contracts its edges,
    until the edges no longer change or at most LAST_EDGES are left, which one task contracts. Hot
    nodes are joined with their minimum, which splits under skew, rather than gathered.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def contracted(e: DataFrame) -> DataFrame:
        return materialize(e.select("a", "b").mapInArrow(lean(_contracted), "a bigint, b bigint"))

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = contracted(edges.where("a <> b"))
    old, now = None, mark(e)
    while now[0] > LAST_EDGES and now != old:
        e = contracted(star(materialize(star(e, True)), False))
        old, now = now, mark(e)
    if now[0] and now != old:
        e = contracted(e.coalesce(1))
    # each node now has one edge, to its root; roots have none
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(roots)


def described(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, sid, n_shingles for each row; sid is null without shingles."""

    def run(batches):
        for b in batches:
            key, ptr = shingle_sets(b.column(1), like.k)
            n = np.diff(ptr)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(set_ids(key, ptr), mask=n == 0), pa.array(n)], ["doc_id", "sid", "n_shingles"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id bigint, sid bigint, n_shingles bigint")


def join(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles, sid (the document's class) and component_id for each row of `docs`."""
    rows = materialize(described(docs, like))
    found = candidates_table(docs, like)
    parts = parts_for(docs, BUCKET_BYTES)

    known = rows.where("doc_id is not null and sid is not null")
    # rows of one doc_id are one node
    same = known.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("doc_id", "a")
    same = same.join(known.select("doc_id", F.col("sid").alias("b")), "doc_id").select("a", "b")
    links = _verified(found, _pairs_of(found, like), like, parts).unionByName(_cluster_links(found, like)).unionByName(same)
    roots = materialize(components(links))
    classes = known.groupBy("sid").agg(F.min("doc_id").alias("first"))
    named = classes.join(roots, classes["sid"] == roots["node"], "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("sid", "component_id")
    out = rows.join(named, "sid", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    # without shingles a row keeps to itself, unless another row of its doc_id has some
    return out.select("doc_id", "n_shingles", "sid", alone.alias("component_id"))


def op6(docs: DataFrame) -> DataFrame:
    return join(docs, Likeness(3, 90, 100)).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, like: Likeness = Likeness(5, 80, 100)) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id; rows without an id or shingles stay.

    Of rows that repeat this doc_id, one with the smallest text stays.
    """
    marks = join(docs, like).where("sid is not null and component_id is not null")
    drop = marks.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    names = docs.columns
    kept = docs.join(drop, docs["doc_id"].cast("bigint") == drop["_id"], "left_anti")
    again = marks.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    if again.isEmpty():
        return kept.select(*names)
    single = kept.join(again, kept["doc_id"].cast("bigint") == again["_id"], "left_anti")
    twice = kept.join(again, kept["doc_id"].cast("bigint") == again["_id"], "left_semi")
    one = twice.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct(F.col("text").isNull(), "text")).alias("row")).select("row.*")
    return single.select(*names).unionByName(one.select(*names))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
  WHERE 100 * c.c >= 90 * (x.n + y.n - c.c)),
r AS (
  SELECT doc_id AS node, doc_id AS seen FROM d
  UNION
  SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""
