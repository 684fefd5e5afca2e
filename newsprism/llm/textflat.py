"""Vectorised views of a batch of texts, shared by the operators.

A batch of texts is one flat byte array plus row offsets (the Arrow layout);
words, hashes and windows are computed for the whole batch with numpy.  A
null text reads as the empty text everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: bytes of text handled at once by the numpy kernels (a longer text is a piece of its own)
PIECE_BYTES = 4 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONG = 64


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    if col.type != large:
        col = col.cast(large)
    if col.null_count:
        col = col.fill_null(b"" if large == pa.large_binary() else "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset:]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES):
    """Slices of ``batch`` with at most ``limit`` bytes of text, or one row."""
    _, off = flat(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def load8(buf: np.ndarray, little: bool = True) -> np.ndarray:
    """Unaligned view: element i holds bytes i..i+7 of a padded buffer."""
    return np.ndarray(shape=(len(buf) - 7,), dtype="<u8" if little else ">u8", buffer=buf.data, strides=(1,))


def words(data: np.ndarray, off: np.ndarray, between: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words and, per text, the offset of its first word
    (length rows + 1); ``between`` marks the 256 bytes that part words, by
    default those outside ``[^\\x20\\x09-\\x0D]``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~between[data]
    first = off[:-1][off[:-1] < off[1:]]
    left = np.zeros(n, bool)
    left[1:] = inside[:-1]
    left[first] = False
    right = np.zeros(n, bool)
    right[:-1] = inside[1:]
    right[first[1:] - 1] = False
    starts = np.flatnonzero(inside & ~left)
    ends = np.flatnonzero(inside & ~right) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _C2
    x ^= x >> np.uint64(27)
    x = x * _C3
    x ^= x >> np.uint64(31)
    return x


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a padded buffer."""
    view = load8(buf)
    length = ends - starts
    h = length.astype(np.uint64) * _C1
    active = np.arange(len(starts))
    for at in range(0, _LONG, 8):
        rest = length[active] - at
        g = (h[active] ^ (view[starts[active] + at] & _MASK[np.minimum(rest, 8)])) * _C2
        h[active] = g ^ (g >> np.uint64(32))
        active = active[rest > 8]
        if not len(active):
            break
    for i in np.flatnonzero(length > _LONG):
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(buf[starts[i]:ends[i]].tobytes()))
    return mix64(h)


def window_hashes(h: np.ndarray, doc_words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside texts: (hash, index of first word)."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:len(h) - n + 1].copy()
    for j in range(1, n):
        g *= _C1
        g += h[j:len(h) - n + 1 + j]
    count = np.diff(doc_words)
    doc = np.repeat(np.arange(len(count)), count)
    ok = np.flatnonzero(doc[:len(g)] == doc[n - 1:])
    return mix64(g[ok]), ok
