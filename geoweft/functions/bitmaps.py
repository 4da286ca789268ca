"""Compressed bitmaps of 65,536 bits: sorted 16-bit positions while sparse, packed bits beyond 4,096 of them."""

from __future__ import annotations

import numpy as np

BITS = 65_536
SPARSE = 4_096


class Bitmap:
    __slots__ = ("at", "bits")

    def __init__(self, at: np.ndarray | None = None, bits: np.ndarray | None = None) -> None:
        self.at, self.bits = at, bits

    @classmethod
    def of(cls, positions: np.ndarray) -> Bitmap:
        """From positions in any order, repeats allowed."""
        at = np.unique(np.asarray(positions, dtype=np.uint16))
        return cls(at) if len(at) <= SPARSE else cls(bits=_pack(at))

    def __len__(self) -> int:
        return len(self.at) if self.at is not None else int(np.bitwise_count(self.bits).sum())

    def positions(self) -> np.ndarray:
        return self.at if self.at is not None else np.flatnonzero(np.unpackbits(self.bits)).astype(np.uint16)

    def packed(self) -> np.ndarray:
        return _pack(self.at) if self.at is not None else self.bits

    def has(self, at: np.ndarray) -> np.ndarray:
        """Which of the positions are set."""
        if self.at is not None:
            i = np.searchsorted(self.at, at)
            return (i < len(self.at)) & (self.at[np.minimum(i, len(self.at) - 1)] == at) if len(self.at) else np.zeros(len(at), bool)
        i = at.astype(np.int64)
        return (self.bits[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 == 1

    def __or__(self, other: Bitmap) -> Bitmap:
        if self.at is not None and other.at is not None:
            return Bitmap.of(np.concatenate([self.at, other.at]))
        return _slim(self.packed() | other.packed())

    def __and__(self, other: Bitmap) -> Bitmap:
        if self.at is not None:
            return Bitmap(self.at[other.has(self.at)])
        return other & self if other.at is not None else _slim(self.bits & other.bits)

    def and_not(self, other: Bitmap) -> Bitmap:
        if self.at is not None:
            return Bitmap(self.at[~other.has(self.at)])
        return _slim(self.bits & ~other.packed())


def _pack(at: np.ndarray) -> np.ndarray:
    flat = np.zeros(BITS, np.uint8)
    flat[at.astype(np.int64)] = 1
    return np.packbits(flat)


def _slim(bits: np.ndarray) -> Bitmap:
    b = Bitmap(bits=bits)
    return Bitmap(b.positions()) if len(b) <= SPARSE else b
