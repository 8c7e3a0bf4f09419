"""Numpy kernels over the fixed-length byte windows of a buffer."""

from __future__ import annotations

import numpy as np

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
#: Low bits of a hash that give way to a place when both are compared as one number; buffers are shorter than 2^PLACE_BITS.
PLACE_BITS = 21


def loaded_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    return words


def _steps(width: int) -> list[int]:
    """Offsets of the words that cover `width` bytes, eight at least."""
    return [*range(0, width - 8, 8), width - 8]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """63-bit hash of the `gram` bytes from each place on."""
    n = len(data) - gram + 1
    words, h = loaded_words(data), np.zeros(n, np.uint64)
    for at in _steps(gram):
        h += words[at : at + n]
        h *= C1
        h ^= h >> np.uint64(29)
    h *= C3
    h ^= h >> np.uint64(32)
    return h >> np.uint64(1)


def window_keys(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the `length` bytes from each of some places on."""
    words = loaded_words(data)
    a, b = np.zeros(len(places), np.uint64), np.full(len(places), C3)
    for at in _steps(length):
        w = words[places + at]
        a += w
        a *= C1
        a ^= a >> np.uint64(29)
        b ^= w
        b *= C2
        b ^= b >> np.uint64(32)
    return a * C3, b * C1


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each `width` consecutive values, the leftmost if several.

    Values are compared by their bits above PLACE_BITS, whatever the buffer's length, and then by place. So where the
    minimum lies in a window depends on that window's values alone.
    """
    assert len(values) < 1 << PLACE_BITS
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    keyed = np.full(blocks * width, np.iinfo(np.int64).max, np.int64)
    bits = np.uint64(PLACE_BITS)
    keyed[: len(values)] = ((values >> bits << bits) | np.arange(len(values), dtype=np.uint64)).astype(np.int64)
    grid = keyed.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    return best & np.int64((1 << PLACE_BITS) - 1)


def _pieces(starts: np.ndarray, ends: np.ndarray, length: int, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of parts with at most `at_once` windows; parts of one text share length - 1 bytes."""
    windows = ends - starts - length + 1
    there = np.flatnonzero(windows > 0)
    n = -(-windows[there] // at_once)
    text = np.repeat(there, n)
    first = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * at_once
    return text, first, np.minimum(first + at_once + length - 1, ends[text])


def super_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int, at_once: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of one text that share their minimal gram.

    data holds the texts one after another, starts and ends bound them. Returns per run: index of its text, first
    window's place in data, number of windows, hash of the minimal gram and its place. About `at_once` bytes are worked on together;
    a longer text is cut, which can cut a run in two.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    text, start, end = _pieces(starts, ends, length, at_once)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(end, start[first] + at_once + length, side="right")))
        a, b = int(start[first]), int(end[last - 1])
        own, place, n, digit, at = _runs_of(data[a:b], start[first:last] - a, end[first:last] - a, length, gram)
        out.append((text[first:last][own], place + a, n, digit, at + a))
        first = last
    return tuple(np.concatenate(column) for column in zip(*out))


def _runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    hashes = gram_hashes(data, gram)
    minima = window_minima(hashes, length - gram + 1)
    counts = ends - starts - length + 1
    text = np.repeat(np.arange(len(starts)), counts)
    place = np.arange(len(text)) + (starts - np.cumsum(counts) + counts)[text]
    anchor = minima[place]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    return text[new], place[new], np.diff(np.append(new, len(text))), hashes[anchor[new]], anchor[new]


def bytes_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary Arrow column without nulls as one buffer, with where each text starts and ends."""
    values = column.to_pylist()
    sizes = np.array([len(v) for v in values], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(values), np.uint8), ends - sizes, ends


def grouped(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal (high, low) in order of high: each row's group, each group's first row and its size."""
    order = np.argsort(high, kind="stable")
    new = np.ones(len(high), bool)
    for again in (False, True):
        if again:  # two keys agree in one half only
            order = np.lexsort((low, high))
        h, w = high[order], low[order]
        new[1:] = h[1:] != h[:-1]
        if again or not ((w[1:] != w[:-1]) & ~new[1:]).any():
            break
    new[1:] |= w[1:] != w[:-1]
    number = np.empty(len(high), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return number, order[first], np.diff(np.append(first, len(high)))
