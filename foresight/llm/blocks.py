"""Hashes and samples of byte strings, in whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Window starts that are handled together; longer texts go through in pieces that overlap.
PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)
_PLACE = np.uint64((1 << 24) - 1)
_state: dict[str, np.ndarray] = {}


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of the base up to ``size``."""
    if len(_state.get("powers", ())) < size:
        _state["bytes"] = np.random.default_rng(2024).integers(0, 1 << 64, 256, dtype=np.uint64)
        powers = np.full(size, _BASE)
        powers[0] = 1
        _state["powers"] = np.multiply.accumulate(powers)
    return _state["bytes"], _state["powers"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


class Piece:
    """Polynomial hashes (mod 2^64 over random byte values) of any substrings of a byte array."""

    def __init__(self, data: np.ndarray, room: int) -> None:
        values, powers = _tables(room + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])
        self.lift = powers[room::-1]

    def hashes(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.lift[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


class Sample:
    """The synchronising sample of a piece: anchors, and the run of windows that each one serves.

    A window of ``length`` bytes is served by the place of its least ``gram``-byte string, the first
    of equal ones. That depends on nothing but the window, so equal windows are served at equal
    offsets. ``first``..``last`` are the window starts of an anchor, ``name`` stands for its gram and
    ``block`` for all bytes that its windows cover, with their places relative to the anchor.
    """

    def __init__(self, data: np.ndarray, length: int, gram: int) -> None:
        self.piece = Piece(data, PIECE + length)
        self.length = length
        places = np.arange(len(data) - gram + 1)
        grams = self.piece.hashes(places, places + gram)
        marked = (grams & ~_PLACE) | places.astype(np.uint64)
        serving = (_least(marked, length - gram + 1) & _PLACE).astype(np.int64)
        edges = np.flatnonzero(np.diff(serving)) + 1
        self.first = np.concatenate(([0], edges))
        self.last = np.concatenate((edges - 1, [len(serving) - 1]))
        self.anchor = serving[self.first]
        self.name = grams[self.anchor]
        where = ((self.anchor - self.first) * 1024 + (self.last - self.first)).astype(np.uint64)
        whole = self.piece.hashes(self.first, self.last + length)
        self.block = mix(whole ^ mix(where + _BASE))

    def windows(self, number: int) -> np.ndarray:
        """Hashes of the windows that the anchor serves, each with its offset to the anchor."""
        starts = np.arange(self.first[number], self.last[number] + 1)
        offset = (self.anchor[number] - starts).astype(np.uint64)
        return mix(self.piece.hashes(starts, starts + self.length) + offset * _MIX)


def samples(raw: bytes, length: int, gram: int) -> Iterator[tuple[int, Sample]]:
    """(offset, sample) of each piece of a text; every window of the text lies in exactly one."""
    data = np.frombuffer(raw, dtype=np.uint8)
    for start in range(0, len(data) - length + 1, PIECE):
        yield start, Sample(data[start : start + PIECE + length - 1], length, gram)
