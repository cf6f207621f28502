"""Word shingles of whole Arrow columns of texts, as sorted sets of 64-bit hashes.

A column's bytes are hashed in one go: a word's hash is a polynomial over its bytes, taken from running sums, a shingle's
one over its words. Words are runs of anything but ASCII white space; only the letters A-Z are lowered, so bytes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text whose words are looked at together, and whose running sums are held at a time; a longer text makes a piece
#: and a block of its own.
PIECE, BLOCK = 2 << 20, 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
P = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def finish(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit sums."""
    h = (h ^ h >> np.uint64(30)) * M1
    h = (h ^ h >> np.uint64(27)) * M2
    return h ^ h >> np.uint64(31)


BYTE = finish(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse."""
    if len(_powers[name]) < n:
        step = np.full(max(n, BLOCK), BASE if name == "up" else INVERSE, np.uint64)
        step[0] = 1
        _powers[name] = np.cumprod(step)
    return _powers[name][:n]


def pieces(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """first row, end row, bytes and offsets of runs of rows with about PIECE bytes of a string column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        data = bytes(column.buffers()[2][int(offsets[lo]) : int(offsets[hi])]) if offsets[hi] > offsets[lo] else b""
        yield lo, hi, data, offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and the number of words of every text."""
    b, lo = np.frombuffer(data, np.uint8), 0
    hashes, n = [np.empty(0, np.uint64)], [np.zeros(0, np.int64)]
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
        for all_, own in zip((hashes, n), _block_hashes(b[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), strict=True):
            all_.append(own)
        lo = hi
    return np.concatenate(hashes), np.concatenate(n)


def _block_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(b):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    space = SPACE[b]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(b))]
    first[edge] = ~space[edge]
    last[edge - 1] = ~space[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    total = np.cumsum(BYTE[b] * _power("up", len(b)))
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    hashes = finish((total[end] - before) * _power("down", len(b))[start] + (end - start).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(start, offsets))


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Of a string column without nulls: all texts' sorted distinct shingles one after another, and their numbers. A
    text with fewer than width words has its whole sequence as one."""
    flats, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for lo, hi, data, offsets in pieces(column):
        w, n = word_hashes(data.lower(), offsets)
        begin = np.cumsum(n) - n
        count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        out = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.uint64)
        for k in range(1, width + 1):
            of = np.flatnonzero(n >= width if k == width else n == k)
            at = np.repeat(begin[of] - (np.cumsum(count[of]) - count[of]), count[of]) + np.arange(int(count[of].sum()))
            h = np.full(len(at), k, np.uint64)
            for j in range(k):
                h = h * P + w[at + j]
            flat[np.repeat(out[of] - (np.cumsum(count[of]) - count[of]), count[of]) + np.arange(len(at))] = finish(h)
        for a, c in zip(out.tolist(), count.tolist(), strict=True):
            if c > 1:
                flat[a : a + c].sort()
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[out[count > 0]] = True
        seen = np.concatenate([[0], np.cumsum(new)])
        flats.append(flat[new])
        sizes.append(seen[out + count] - seen[out])
    return np.concatenate(flats), np.concatenate(sizes)


def digests(flat: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set, None for an empty one."""
    data, end = memoryview(flat).cast("B"), np.cumsum(sizes) * 8
    return [xxhash.xxh3_128_digest(data[e - 8 * n : e]) if n else None for e, n in zip(end.tolist(), sizes.tolist(), strict=True)]
