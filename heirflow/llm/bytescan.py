"""Vectorised work on the bytes of Arrow text columns: steps, 64-bit mixing, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step looks at (one text at least).
STEP_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first row) of neighbouring texts, about ``limit`` bytes at a time; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n of the base or its inverse, modulo 2**64."""
    found = _powers.get(kind)
    if found is None or len(found) <= n:
        size = max(n + 1, STEP_BYTES + 1)
        steps_of = np.full(size, _BASE if kind == "base" else _INVERSE, np.uint64)
        steps_of[0] = 1
        found = _powers[kind] = np.multiply.accumulate(steps_of)
    return found[: n + 1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any range of ``data`` by :func:`range_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("base", len(data))[:-1], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each range; equal bytes have equal hashes wherever they stand."""
    raw = (sums[ends] - sums[starts]) * _power("inverse", len(sums) - 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, index of its text); words are runs without blanks, within one text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = ~_SPACE[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = letter[inner]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[inner - 1] = letter[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    return range_hash(prefix_sums(_LOWER[data]), starts, ends), owner


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of ``size`` words of each text; fewer words are one shingle."""
    words, owner = word_hashes(data, offsets)
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    joined = mix(words + np.uint64(size))
    for k in range(1, size):
        joined = mix(joined[: max(0, len(words) - k)] * np.uint64(0x2545F4914F6CDD1D) + words[k:])
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= size:
            one = np.sort(joined[a : b - size + 1])
            out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        elif b > a:
            value = mix(words[a : a + 1] + np.uint64(b - a))
            for k in range(a + 1, b):
                value = mix(value * np.uint64(0x2545F4914F6CDD1D) + words[k])
            out.append(value)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
