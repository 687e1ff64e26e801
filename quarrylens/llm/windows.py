"""Anchors: every fixed-length window of a sequence is represented by the least k-gram that it contains.

Equal windows contain equal k-grams and so choose equal anchors, wherever they stand. A window whose anchor occurs
nowhere else occurs nowhere else; what remains to be compared are the short stretches around shared anchors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
#: An odd multiplier, its inverse modulo 2**64, and the finalizer's two factors (fixed values of 64-bit mixing).
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53))
#: Symbols hashed at once, which bounds memory for texts of any length.
BLOCK = 1 << 20
POSITION = U(BLOCK * 2 - 1)

_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * MIX[0]
    x = (x ^ (x >> U(33))) * MIX[1]
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0 ... BASE**n and their inverses."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n, BLOCK) + 1
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size + 1, base, U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Sums of symbol times power; the hash of [a, b) is (sums[b] - sums[a]) * INVERSE**a."""
    up, _ = powers(len(symbols))
    sums = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * up[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


@dataclass
class Anchors:
    """One row for each run of windows with the same anchor. Starts count from the document's first symbol."""

    doc: np.ndarray
    anchor: np.ndarray  # hash of the k-gram
    content: np.ndarray  # hash of all symbols that the run's windows cover, and of the anchor's place in them
    start: np.ndarray  # first window
    count: np.ndarray  # windows


def _block(symbols: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of a block of documents; bounds: where each begins, and the end."""
    n = len(symbols)
    sums = prefix_hashes(symbols)
    _, down = powers(n)
    grams = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    least = (grams & ~POSITION) | np.arange(n - k + 1, dtype=U)
    wide, size = window - k + 1, 1
    while 2 * size <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    at = (least & POSITION).astype(np.int64)
    # windows that run over a document's end are none
    lengths = np.diff(bounds)
    valid = np.ones(n, bool)
    cut = np.zeros(n + 1, np.int32)
    first = np.maximum(bounds[1:] - (window - 1), bounds[:-1])
    np.add.at(cut, first[lengths > 0], 1)
    np.add.at(cut, bounds[1:][lengths > 0], -1)
    valid = np.cumsum(cut[:-1]) == 0
    p = np.flatnonzero(valid[: len(at)])
    if not len(p):
        return (np.zeros(0, np.int64),) * 5
    a = at[p]
    new = np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]
    begin = np.flatnonzero(new)
    start, count = p[begin], np.diff(np.r_[begin, len(p)])
    anchor = a[begin]
    content = span_hashes(sums, start, start + count - 1 + window) ^ mix((anchor - start).astype(U))
    doc = np.searchsorted(bounds, start, side="right") - 1
    return doc, grams[anchor].view(np.int64), content.view(np.int64), start - bounds[doc], count


def blocks(lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(first document, end document, first symbol, end symbol): whole documents up to BLOCK symbols, or a stretch of one."""
    out, first, held = [], 0, 0
    for d, n in enumerate(lengths.tolist()):
        if n > BLOCK:
            if d > first:
                out.append((first, d, 0, 0))
            step = BLOCK - window
            out += [(d, d + 1, s, min(n, s + BLOCK - 1)) for s in range(0, max(1, n - window + 1), step)]
            first, held = d + 1, 0
        elif held + n > BLOCK:
            out.append((first, d, 0, 0))
            first, held = d, n
        else:
            held += n
    if first < len(lengths):
        out.append((first, len(lengths), 0, 0))
    return out


def anchors(symbols: np.ndarray, offsets: np.ndarray, window: int, k: int) -> Anchors:
    """Anchors of documents laid end to end: document d has symbols[offsets[d]:offsets[d + 1]]. None for fewer than ``window`` symbols."""
    found: list[tuple[np.ndarray, ...]] = []
    for first, end, s, e in blocks(np.diff(offsets), window):
        low, high = (offsets[first] + s, offsets[first] + e) if e else (offsets[first], offsets[end])
        if high - low < window:
            continue
        bounds = np.array([0, high - low]) if e else offsets[first : end + 1] - low
        # windows of a long document's stretch: those of the next stretch begin where these end
        part = symbols[low:high]
        doc, anchor, content, start, count = _block(part, bounds, window, k)
        if e and e - s == BLOCK - 1:
            keep = start < BLOCK - window
            doc, anchor, content, start, count = doc[keep], anchor[keep], content[keep], start[keep], count[keep]
        found.append((doc + first, anchor, content, start + s, count))
    if not found:
        return Anchors(*(np.zeros(0, np.int64) for _ in range(5)))
    return Anchors(*(np.concatenate(c) for c in zip(*found, strict=True)))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends in the bytes, and how many words lie before each document's end (from 0)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begins[edge] = inside[edge]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= space[1:]
    edge = offsets[1:][np.diff(offsets) > 0]
    ends[edge] = inside[edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, wherever it stands."""
    out = np.empty(len(begin), U)
    table = mix(np.arange(1, 257, dtype=U))
    at = 0
    while at < len(begin):  # as many words as fit a block
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + BLOCK, side="right")))
        low, high = int(begin[at]), int(end[upto - 1])
        sums = prefix_hashes(table[data[low:high]])
        out[at:upto] = span_hashes(sums, begin[at:upto] - low, end[at:upto] - low)
        at = upto
    return out
