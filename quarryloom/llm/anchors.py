"""Content-defined anchors: the places by which equal stretches of bytes find each other without a shuffle of all text."""

from __future__ import annotations

import numpy as np

from quarryloom.llm import textbytes as tb

GRAM = 24


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost smallest value of each window of w values, by minima from the left and from the right of
    blocks of w. The low bits of x must tell positions apart for ties (see `runs`)."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    left = np.minimum.accumulate(padded.reshape(-1, w), axis=1).ravel()
    right = np.minimum.accumulate(padded.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs(flat: np.ndarray, offsets: np.ndarray, length: int, size: int = GRAM):
    """Stretches of windows of `length` bytes (or 64-bit codes) that share an anchor, the leftmost smallest hash of `size` of them inside the window.

    Returns text number, first and last window start (offsets in the text), anchor offset, anchor hash and the hash of
    all bytes that the windows cover. Equal windows have equal anchors at equal distances, in whatever text they stand.
    """
    z = np.zeros(0, np.int64)
    if len(flat) < length:
        return z, z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefix = tb.prefix_hash(flat)
    at = np.arange(len(flat) - size + 1)
    gram = tb.span_hash(prefix, at, at + size)
    w = length - size + 1
    # The position fills the low bits, so that a minimum tells where it stands and the leftmost of equal grams wins.
    low = np.uint64(max(1, int(len(flat)).bit_length()))
    mask = (np.uint64(1) << low) - np.uint64(1)
    least = sliding_argmin((gram & ~mask) | at.astype(np.uint64), w)
    anchor = (least & mask).astype(np.int64)
    start = np.arange(len(anchor))
    number = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[number + 1]
    start, anchor, number = start[inside], anchor[inside], number[inside]
    if not len(start):
        return z, z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    s, e, a, n = start[first], start[last], anchor[first], number[first]
    return n, s - offsets[n], e - offsets[n], a - offsets[n], gram[a], tb.span_hash(prefix, s, e + length)
