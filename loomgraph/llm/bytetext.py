"""Vectorised byte-level text work shared by the operators of this subpackage.

Texts of an Arrow batch are handled as one UTF-8 buffer with row offsets, in pieces of some 100 KB, so that the
intermediate arrays of a worker stay small whatever the batch size is.  A null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
PIECE_BYTES = 1 << 18
#: An odd base is invertible modulo 2**64, so substring hashes come from prefix sums.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: ASCII white space: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The string column with nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n+1 row offsets into them."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `limit` bytes and at most `rows` rows each."""
    data, offsets = buffer_of(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(2 * n, 1 << 18), base, np.uint64)
        out[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads a polynomial hash over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences are substring hashes (see `spans_hash`)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte string data[start:end]; equal strings have equal hashes."""
    h = (sums[end] - sums[start]) * powers(len(sums), INVERSE)[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte Latin-1 capitals in lower case."""
    out = LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not in `breaks`; runs end with their row."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a row, and the index of each one's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * BASE + hashes[i : i + m]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(h[at]), at


def sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each window x[i:i+w], by block prefixes and suffixes (linear whatever w is)."""
    n = len(x)
    if n < w:
        return x[:0]
    fill = np.iinfo(x.dtype).max if op is np.minimum else np.iinfo(x.dtype).min
    padded = np.full(-(-n // w) * w, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    head = op.accumulate(blocks, axis=1).ravel()
    tail = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def anchors(data: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-byte strings that are least in some window of w consecutive ones.

    The choice inside a window hangs on the window's bytes alone, so two equal strings of w+k-1 bytes have an
    anchor at the same place.  Ties are all kept.
    """
    n = len(data) - k + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix(data)
    h = (sums[k:] - sums[:-k]) * powers(n, INVERSE)
    h = mix(h)
    least = sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    best = sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    at = np.flatnonzero(best == h)
    return at, h[at]
