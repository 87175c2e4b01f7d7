"""Elias-Fano coding of ascending numbers, on flat buffers that can be mapped as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Places that are looked up together.
_AT_ONCE = 1 << 16


class EliasFano:
    """n ascending numbers (repeats allowed) below 2**64: about log2(universe / n) low bits
    each, kept in whole bytes, and two bits each for the rest, in unary code.

    ``low``, ``high`` and ``ranks``, the ones before each 64-bit word of ``high``, may be views
    of any buffer, a memory-mapped file included; they are read in place and never unpacked.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, shift: int):
        self.low, self.high, self.ranks, self.shift = low, high, ranks, shift

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        shift = max(0, (universe // max(1, n)).bit_length() - 1)
        low = values & np.uint64((1 << shift) - 1)
        size = next(s for s in (1, 2, 4, 8) if shift <= 8 * s)
        upper = (values >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(n, np.int64)
        bits = np.zeros(-(-(n + (int(upper[-1]) if n else 0) + 1) // 64) * 64, np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ranks = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]
        return cls(low.astype(f"<u{size}"), high, ranks, shift)

    @property
    def levels(self) -> tuple[np.ndarray, ...]:
        return self.low, self.high, self.ranks

    def mapped(self, levels: Iterator[np.ndarray]) -> EliasFano:
        """The same numbers over the next three of ``levels``."""
        return EliasFano(next(levels), next(levels), next(levels), self.shift)

    def __len__(self) -> int:
        return len(self.low)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.levels)

    def _select(self, number: np.ndarray, bit: int) -> np.ndarray:
        """The place of the given one (or zero) bit, numbered from 0; it has to be there."""
        before = self.ranks if bit else np.arange(len(self.ranks)) * 64 - self.ranks
        out = np.empty(len(number), np.int64)
        for start in range(0, len(number), _AT_ONCE):
            wanted = number[start : start + _AT_ONCE]
            k = np.searchsorted(before, wanted, side="right") - 1
            word = self.high[k] if bit else ~self.high[k]
            left, at = (wanted - before[k]).astype(np.uint8), np.zeros(len(wanted), np.uint8)
            for width in (32, 16, 8, 4, 2, 1):  # halves the part of the word that holds the bit
                ones = np.bitwise_count(word & np.uint64((1 << width) - 1))
                above = ones <= left
                left -= ones * above
                move = np.uint8(width) * above
                at += move
                word >>= move
            out[start : start + _AT_ONCE] = k * 64 + at
        return out

    def _ones_from(self, place: np.ndarray) -> np.ndarray:
        """How many ones follow each other from each place on."""
        out = np.zeros(len(place), np.int64)
        open_ = np.flatnonzero(place < len(self.high) * 64)
        while len(open_):  # runs that fill their word go on in the next
            at = place[open_] + out[open_]
            word = self.high[at >> 6] >> (at & 63).astype(np.uint8)
            run = np.bitwise_count(word & ~(word + np.uint64(1)))
            out[open_] += run
            at += run
            open_ = open_[((at & 63) == 0) & (run > 0) & (at < len(self.high) * 64)]
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        upper = (self._select(at, 1) - at).astype(np.uint64)
        return (upper << np.uint64(self.shift)) | self.low[at].astype(np.uint64)

    def _smaller(self, upper: np.ndarray) -> np.ndarray:
        """How many numbers have a smaller upper part."""
        zeros = len(self.high) * 64 - len(self)
        there = np.flatnonzero((upper > 0) & (upper <= zeros))
        out = np.where(upper > 0, len(self), 0)
        out[there] = self._select(upper[there] - 1, 0) - (upper[there] - 1)
        return np.minimum(out, len(self))

    def find(
        self, targets: np.ndarray, start: np.ndarray | int = 0, stop: np.ndarray | int | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The place from ``start`` on, before ``stop``, of the first number that is at least the
        target, ``stop`` if there is none, and whether it is the target; by default, of all.

        Numbers with the target's upper part stand together; low parts are searched there."""
        targets = targets.astype(np.uint64)
        stop = len(self) if stop is None else stop
        upper = (targets >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(targets), np.int64)
        first = self._smaller(upper)
        at = np.clip(first, start, stop)
        last = np.clip(first + self._ones_from(first + upper), start, stop)
        end = last.copy()
        low = (targets & np.uint64((1 << self.shift) - 1)).astype(self.low.dtype)
        while len(open_ := np.flatnonzero(at < end)):  # halves the open ranges
            middle = (at[open_] + end[open_]) // 2
            smaller = self.low[middle] < low[open_]
            at[open_[smaller]] = middle[smaller] + 1
            end[open_[~smaller]] = middle[~smaller]
        same = at < last
        same[same] = self.low[at[same]] == low[same]
        return at, same

    def successor(self, targets: np.ndarray) -> np.ndarray:
        """The place of the first number that is at least the target, n if there is none."""
        return self.find(targets)[0]
