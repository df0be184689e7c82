"""Vectorised work on batches of UTF-8 texts, for use inside Arrow map tasks.

A batch is one flat byte array with the offsets of its texts, as Arrow keeps strings, so that words, shingles and
windows of a whole batch come from a few NumPy passes. All hashes are 64-bit and depend on the content alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64; kept, as every batch needs them."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def slices(batches, limit: int = SLICE_BYTES, column: str = "text"):
    """Record batches cut so that each holds about `limit` bytes of a string or binary column, or one row that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = texts(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def prefix_hash(flat: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the weighted sum of the bytes (or 64-bit codes) i..j-1; `span_hash` turns it into their hash."""
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((_CODES[flat] if flat.dtype == np.uint8 else mix(flat)) * powers(len(flat))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, wherever it stands."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def lower_table() -> np.ndarray:
    """Lower-casing of A-Z, bytewise."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def words(flat: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes for which `inside` (256 booleans) holds; none crosses a text."""
    if not len(flat):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_in = inside[flat]
    cut = np.zeros(len(flat) + 1, bool)
    cut[offsets[:-1]] = True
    starts = is_in.copy()
    starts[1:] &= ~is_in[:-1] | cut[1:-1]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:] | cut[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def outside(bytes_out: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(bytes_out)] = False
    return t


#: Words `[^\x20\x09-\x0D]+`: all bytes but white space.
NOT_SPACE = outside(bytes([0x20, *range(0x09, 0x0E)]))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, small letters and everything beyond ASCII.
ALPHANUMERIC = outside(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def by_text(number: np.ndarray, n_texts: int) -> np.ndarray:
    """Offsets of the items of each text, from the ascending text numbers of the items."""
    return np.searchsorted(number, np.arange(n_texts + 1))


def shingles(word: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text and their text numbers; a text of fewer words is one shingle."""
    count = np.diff(bounds)
    number = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(word)) - bounds[number]
    have = np.minimum(count, n)
    first = at <= (count - have)[number]
    start = np.flatnonzero(first)
    out = np.zeros(len(start), np.uint64)
    size = have[number[start]]
    for k in range(n):
        use = size > k
        h = word[np.minimum(start + k, max(len(word) - 1, 0))] if len(word) else out
        out = np.where(use, mix(out * _BASE + h + np.uint64(k + 1)), out)
    return out, number[start]
