"""Packing token pieces into sequences of fixed capacity.

Pieces of one length are interchangeable, so an instance is its histogram: at
most `capacity` counts, whatever the number of documents. The driver solves the
histogram: first the Martello-Toth reduction fixes pairs that provably dominate
every other companion of their longer piece, then best fit (longest first)
packs what is left, always many equal bins at a time. The result is a bounded
list of patterns with multiplicities. Pieces get a rank among those of their
length from counts per block of about `BLOCK_PIECES` pieces, and the rank finds
its slot in the patterns.

Defined cases: null text counts as empty and is one piece, the end token;
repeated rows are packed each for itself; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakequill.llm.common import lean, materialize, release_memory

CAPACITY = 1024
END_ID = 2
#: About so many pieces share a block when ranks are dealt: thousands of each length.
BLOCK_PIECES = 1 << 20
#: How many parts of a partition's texts a worker remembers the ids of (twice: those of late and those before), and their longest.
MEMORY = 400_000
LONGEST = 48
#: Documents whose ids a worker holds at once.
ROWS = 128
#: Below this character, letters, numbers and blanks are the same in all versions of Unicode (a test holds them to it).
_KNOWN = 0x250

_LOADED: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _part_pattern() -> str:
    """The pattern by which byte-level vocabularies cut texts into parts, with its classes written out."""
    kinds = {k: re.escape("".join(c for c in map(chr, range(_KNOWN)) if unicodedata.category(c)[0] == k)) for k in "LN"}
    letter, number, blank = kinds["L"], kinds["N"], r" \t-\r\x85\xa0"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


class Encoder:
    """ids of texts by `tokenizers`, as little-endian unsigned 32-bit bytes; strings of special tokens are ordinary text.

    A byte-level vocabulary never merges across the parts that its pattern cuts a text into (blanks,
    words, digits, marks). Parts repeat, so texts of plain characters are cut here and the ids of
    each distinct part are asked for once; all other texts go to the tokenizer as they are.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        before = self.tokenizer.pre_tokenizer
        plain = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.parted = self.tokenizer.normalizer is None and plain and all(t.special for t in added)
        self.cut = re.compile(_part_pattern()).findall
        self.beyond = re.compile(rf"[^\x00-{chr(_KNOWN - 1)}]").search
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # the characters by which the vocabulary writes bytes, and the bytes of ids
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: signs.pre_tokenize_str(chr(c))[0][0] for c in range(_KNOWN)}
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of parts, which are asked of the tokenizer's model: the way to it would only cut them again."""
        model, signs, four, known = self.tokenizer.model.tokenize, self.signs, self.four, self.known
        for p in parts:
            known[p] = b"".join([four[t.id] for t in model(p.translate(signs))])

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cut, whole = [], []
        for i, text in enumerate(texts):
            if self.parted and (text.isascii() or not self.beyond(text)):
                cut.append((i, self.cut(text)))
            else:
                whole.append(i)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = ids.tobytes()
        if len(self.known) > MEMORY:
            self.before, self.known = self.known, {}
        known, before, long = self.known, self.before, []
        for i, parts in cut:
            ids = list(map(known.get, parts))
            if None in ids:
                fresh = {p for p, x in zip(parts, ids) if x is None}
                known.update({p: before[p] for p in fresh if p in before})
                self._learn([p for p in fresh if p not in before])
                long += [p for p in fresh if len(p) > LONGEST]
                ids = map(known.__getitem__, parts)
            out[i] = b"".join(ids)
        for part in set(long):
            del known[part]
        return out

    def forget(self) -> None:
        """Let go of all parts. Idle workers take turns, so what one keeps is soon held by all that wait beside an executor."""
        self.known, self.before = {}, {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = Encoder(vocabulary)
    return _LOADED[vocabulary]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, ended by `end_id`, cut where longer than `capacity`."""
    vocabulary = vocabulary or default_vocabulary()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    schema = schema.add("piece", T.IntegerType())
    for c in ("start", "length", "ids_crc32"):
        schema = schema.add(c, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one thread for each task: the scheduler counts on it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        release_memory()
        encode = encoder(vocabulary)
        try:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    ids = encode([t or "" for t in part.column(1).to_pylist()])
                    yield _pieces(part.column(0), ids, capacity, end_id, schema.names)
        finally:
            encode.forget()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def _pieces(doc: pa.Array, ids: list[bytes], capacity: int, end_id: int, names: list[str]) -> pa.RecordBatch:
    """The pieces of documents: the first is the shorter one where a document is cut."""
    size = np.array([len(x) // 4 + 1 for x in ids], np.int64)
    end = np.array([end_id], "<u4").tobytes()
    flat = memoryview(end.join([*ids, b""]))
    each = -(-size // capacity)
    row = np.repeat(np.arange(len(size)), each)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    short = size - (each - 1) * capacity
    length = np.where(piece > 0, capacity, short[row])
    start = np.where(piece > 0, short[row] + (piece - 1) * capacity, 0)
    at = start + (np.cumsum(size) - size)[row]
    crc = [zlib.crc32(flat[a:z]) for a, z in zip((4 * at).tolist(), (4 * (at + length)).tolist())]
    cols = [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
    return pa.RecordBatch.from_arrays([doc.take(pa.array(row)), *cols], names)


@dataclass
class Pattern:
    lengths: tuple[int, ...]
    times: int


def _sums(counts: np.ndarray, room: int) -> tuple[int, int]:
    """Bit sets of the sums up to `room` of at least one and of at least two pieces."""
    full = (1 << (room + 1)) - 1
    one, two = 0, 0
    for size in range(1, room + 1):
        left, step = int(min(counts[size], room // size)), 1
        if left:
            two |= (one << size) | (1 << 2 * size if left > 1 else 0)
            one |= 1 << size
        used = 1
        while used < left:
            step = min(step, left - used)
            more = (two | one) << (size * step)
            two = (two | more) & full
            one = (one | more) & full
            used += step
            step *= 2
        one, two = one & full, two & full
    return one, two


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Martello-Toth reduction: fixes sets that dominate, and takes them off `counts`.

    For a piece of length w, let j be the longest companion that fits. {w, j} dominates every other
    set with w if it fills the sequence, or if no two or more pieces that fit beside w exceed j
    together: whatever stands beside w elsewhere can change places with j. w alone dominates if
    nothing fits beside it.
    """
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for w in range(capacity, 0, -1):
            while counts[w]:
                counts[w] -= 1  # one w is placed; the rest are companions
                room = capacity - w
                fits = np.flatnonzero(counts[: room + 1])
                j = int(fits[-1]) if len(fits) else 0
                counts[w] += 1
                if not j:
                    # nothing fits beside w; where w + w would fit, a second w is a companion
                    fixed.append(Pattern((w,), int(counts[w])))
                    counts[w] = 0
                    changed = True
                    break
                if j < room:
                    counts[w] -= 1
                    _, two = _sums(counts, room)
                    counts[w] += 1
                    if two >> (j + 1):
                        break
                times = int(counts[w] // 2 if j == w else min(counts[w], counts[j]))
                fixed.append(Pattern((w, j), times))
                counts[w] -= times
                counts[j] -= times
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first, for all pieces of a length at once."""
    room: dict[int, list[Pattern]] = {}
    full: list[Pattern] = []

    def put(p: Pattern) -> None:
        left = capacity - sum(p.lengths)
        room.setdefault(left, []).append(p) if left else full.append(p)

    for size in range(capacity, 0, -1):
        n = int(counts[size])
        while n:
            left = min((r for r in room if r >= size), default=0)
            if left:
                p = room[left].pop()
                if not room[left]:
                    del room[left]
                times = min(n, p.times)
                if times < p.times:
                    put(Pattern(p.lengths, p.times - times))
                put(Pattern((*p.lengths, size), times))
                n -= times
            else:
                each = min(capacity // size, n)
                put(Pattern((size,) * each, n // each))
                n -= n // each * each
    return full + [p for ps in room.values() for p in ps]


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold exactly counts[l] pieces of each length l."""
    left = counts.astype(np.int64).copy()
    fixed = reduce_dominated(left, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern], capacity: int) -> tuple[np.ndarray, ...]:
    """For each length, ranges of ranks and where they go: key (length << 40 | first rank), sequence, offset; ascending keys."""
    used = np.zeros(capacity + 1, np.int64)
    keys, seqs, offs, seq = [], [], [], 0
    for p in patterns:
        at = 0
        for size in p.lengths:
            keys.append((size << 40) | int(used[size]))
            seqs.append(seq)
            offs.append(at)
            used[size] += p.times
            at += size
        seq += p.times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, seqs, offs))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. The pieces are written once, numbered, and read for each use."""
    names = pieces.columns
    row, block, nth, first, rank = (f"{x}_{'_'.join(names)}" for x in ("row", "block", "nth", "first", "rank"))
    pieces = materialize(pieces.withColumn(row, F.monotonically_increasing_id()))
    # a full piece is a sequence by itself and needs no rank
    full = pieces.where(F.col("length") >= capacity)
    full = full.withColumns({"sequence_id": -1 - F.col(row), "offset": F.lit(0).cast("bigint")})
    rest = pieces.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in rest.groupBy("length").count().toPandas().itertuples(index=False):
        counts[size] = n
    keys, seqs, offs = slots(solve(counts, capacity), capacity)
    blocks = max(1, -(-int(counts.sum()) // BLOCK_PIECES))
    # blocks by row number, so that repeated rows are spread like others
    rest = rest.withColumn(block, F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int"))
    cells = rest.groupBy("length", block).agg(F.count("*").alias(nth))
    before = Window.partitionBy("length").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", block, F.coalesce(F.sum(nth).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy("length", block).orderBy(row)
    ranked = rest.withColumn(nth, F.row_number().over(within) - 1).join(cells, ["length", block])
    ranked = ranked.select(*names, (F.col(first) + F.col(nth)).alias(rank))
    schema = T.StructType([pieces.schema[c] for c in names]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (at, b.num_columns - 1))
            k = np.searchsorted(keys, (size << 40) | rank, "right") - 1
            seq = seqs[k] + rank - (keys[k] & ((1 << 40) - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(offs[k])], schema.names)

    return full.select(*schema.names).unionByName(ranked.mapInArrow(lean(run), schema))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of `docs`."""
    return pack_pieces(token_pieces(docs, vocabulary, capacity, end_id), capacity)


def op5(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
