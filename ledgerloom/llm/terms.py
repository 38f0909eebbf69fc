"""Runs of bytes in texts (words, terms) as exact keys for numpy.

A run of up to 16 bytes is held whole in two 64-bit numbers, filled up with the byte 0xFF that no UTF-8 text has;
so equal keys are equal runs, and no hash stands for one. Longer runs are few and kept as bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .chunks import mix, pieces

#: Bytes of a run that two numbers hold.
SHORT = 16
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: For 0 to 8 bytes taken: ones in the bytes that are filled up.
_FILL = np.array([(0xFFFFFFFFFFFFFFFF << (8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(9)], np.uint64)


class Runs(NamedTuple):
    """Byte ranges of runs in order, and the index of each one's document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, kind: np.ndarray | None = None) -> Runs:
    """Maximal runs of the bytes that the table ``inside`` marks; they never cross documents. Where ``kind`` goes from 1
    to 2 or back, a run ends too."""
    got = []
    for lo, hi in pieces(offsets):
        base, off = int(offsets[lo]), offsets[lo : hi + 1] - offsets[lo]
        word = inside[data[base : base + off[-1]]]
        if not len(word):
            continue
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        if kind is not None:
            cut = np.bitwise_xor(kind[data[base : base + off[-1]]][1:], kind[data[base : base + off[-1]]][:-1]) == 3
            begin[1:] |= cut
            stop[:-1] |= cut
        edge = off[:-1][off[:-1] < len(word)]
        begin[edge] = word[edge]
        edge = off[1:][off[1:] > 0] - 1
        stop[edge] = word[edge]
        start = np.flatnonzero(begin)
        got.append((start + base, np.flatnonzero(stop) + 1 + base, np.searchsorted(off, start, side="right") - 1 + lo))
    return Runs(*(np.concatenate(x) for x in zip(*got, strict=True))) if got else Runs(*(np.zeros(0, np.int64) for _ in range(3)))


def keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of each run of at most ``SHORT`` bytes."""
    padded = np.append(data, np.zeros(SHORT, np.uint8))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    size = end - start
    low = eight[start] | _FILL[np.minimum(size, 8)]
    high = np.full(len(start), _FULL)
    longer = size > 8
    high[longer] = eight[start[longer] + 8] | _FILL[size[longer] - 8]
    return low, high


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An order of keys by which they can be looked up; keys that share it are told apart by comparison."""
    return mix(low ^ mix(high.copy()))


class Lookup:
    """Numbers of known runs, found again by their bytes."""

    def __init__(self, known: dict[bytes, int]):
        short = [(w, k) for w, k in known.items() if len(w) <= SHORT]
        self.long = {w: k for w, k in known.items() if len(w) > SHORT}
        data = np.frombuffer(b"".join(w for w, _ in short), np.uint8)
        end = np.cumsum([len(w) for w, _ in short], dtype=np.int64) if short else np.zeros(0, np.int64)
        start = np.append(0, end[:-1]) if short else end
        low, high = keys(data, start, end)
        at, number = spread(low, high), np.array([k for _, k in short], np.int64)
        order = np.argsort(at, kind="stable")
        self.at, self.low, self.high, self.number = at[order], low[order], high[order], number[order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each run; -1 for unknown ones."""
        out = np.full(len(start), -1, np.int64)
        short = np.flatnonzero(end - start <= SHORT)
        if len(self.at) and len(short):
            low, high = keys(data, start[short], end[short])
            want = spread(low, high)
            place = np.searchsorted(self.at, want)
            while True:  # once, but for keys that share their place in the order
                there = place < len(self.at)
                there[there] = self.at[place[there]] == want[there]
                if not there.any():
                    break
                i = np.flatnonzero(there)
                same = (self.low[place[i]] == low[i]) & (self.high[place[i]] == high[i])
                out[short[i[same]]] = self.number[place[i[same]]]
                i = i[~same]
                if not len(i):
                    break
                short, low, high, want, place = short[i], low[i], high[i], want[i], place[i] + 1
        if self.long:
            raw = memoryview(data)
            for i in np.flatnonzero(end - start > SHORT).tolist():
                out[i] = self.long.get(bytes(raw[start[i] : end[i]]), -1)
        return out


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i] .. start[i] + size[i] - 1 of all i, one after another."""
    total = int(size.sum())
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(total)
