"""Vectorised scans of UTF-8 text columns.

Texts are handled as one byte buffer with row offsets. A word is a maximal
run of bytes that are not in a separator set; separators are ASCII, so byte
runs and code point runs are the same. Hashes name spans; where equality of
spans decides a result, operators compare the words themselves or hold enough
hash bits that an accident cannot be met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once: large enough to amortise numpy calls, small enough to bound a worker's memory.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_R1 = 0x9E3779B97F4A7C55
_R2 = 0xC2B2AE3D27D4EB4F
_Q = U64(0xD6E8FEB86659FD93)


def separators(codes: str | bytes) -> np.ndarray:
    """A table that is true at the given byte values."""
    lut = np.zeros(256, bool)
    lut[np.frombuffer(codes.encode("latin1") if isinstance(codes, str) else codes, np.uint8)] = True
    return lut


#: space and \x09-\x0D
BLANKS = separators(" \t\n\x0b\x0c\r")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER = np.frombuffer(_LOWER, np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Spans of more bytes than this are hashed one by one; their number is bounded by the buffer's length.
_LONG = 96
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _R1) -> np.ndarray:
    """64-bit hashes of values[start:end] for many spans at once.

    Eight bytes at a time are chained through a finaliser; nothing is linear in the bytes, so
    no arrangement of equal parts cancels. `base` selects an independent hash.
    """
    length = ends - starts
    out = mix(length.astype(U64) * _Q + U64(base))
    padded = np.zeros(len(values) + 8, np.uint8)
    padded[: len(values)] = values
    wide = np.ndarray(len(values) + 1, np.dtype("<u8"), padded, strides=(1,))
    live = np.flatnonzero((length > 0) & (length <= _LONG))
    at, left = starts[live], length[live]
    while len(live):
        out[live] = mix((out[live] ^ (wide[at] & _TAIL[np.minimum(left, 8)])) * _Q + U64(base))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].tobytes(), base)
    return out


@dataclass
class Chunk:
    """Consecutive rows: `first` is the row number in the batch, `offs` are byte offsets into `buf`."""

    first: int
    rows: int
    buf: np.ndarray
    offs: np.ndarray

    def words(self, blanks: np.ndarray = BLANKS) -> "Words":
        n = len(self.buf)
        sep = blanks[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.offs] = True
        word = ~sep
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = sep[:-1]
        starts = np.flatnonzero(word & (before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = sep[1:]
        ends = np.flatnonzero(word & (after | edge[1:])) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.offs))


@dataclass
class Words:
    """Word spans of a chunk; row r owns words ptr[r]:ptr[r + 1]."""

    chunk: Chunk
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.rows), self.counts())

    def hashes(self, base: int = _R1, lower: bool = False) -> np.ndarray:
        buf = LOWER[self.chunk.buf] if lower else self.chunk.buf
        return span_hash(buf, self.starts, self.ends, base)


def second_base() -> int:
    return _R2


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries, for every start that leaves k entries.

    Runs of 1, 2, 4, ... entries are combined by the binary digits of k.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    run, size, out, done = h, 1, None, 0
    while True:
        if k & size:
            piece = run[done : done + n]
            out = mix(piece + U64(k)) if out is None else mix(out * _Q + piece)
            done += size
        if done == k:
            return out
        run = mix(run[:-size] * _Q + run[size:])
        size *= 2


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column into chunks of about `limit` bytes; null counts as empty. A longer text is a chunk of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield Chunk(at, to - at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


# Number columns packed for a shuffle: byte planes, so that equal high bytes lie together and compress.


def pack(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unpack(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """For ascending unsigned values: differences, packed."""
    d = a.copy()
    d[1:] -= a[:-1]
    return pack(d)


def unpack_sorted(b: bytes, dtype=U64) -> np.ndarray:
    return np.cumsum(unpack(b, dtype), dtype=dtype)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each (start, length), concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
