"""The wire format of protocol buffers, as far as map files need it: varints alone and packed, and tagged fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers with their values: numbers, or bytes of a length."""
    at, end = 0, len(data)
    while at < end:
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = read_varint(data, at)
        elif kind == 2:
            n, at = read_varint(data, at)
            if at + n > end:
                raise ValueError("a field runs beyond its message")
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def unpack(data: bytes, signed: bool = False) -> np.ndarray:
    """Packed varints, all at once: the groups of seven bits are shifted and summed between the bytes that end a number."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(b < 0x80)
    if not len(ends) or ends[-1] != len(b) - 1:
        raise ValueError("a number is cut off")
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    values = np.add.reduceat((b & 0x7F).astype(np.uint64) << (place * 7).astype(np.uint64), starts)
    if signed:
        return ((values >> np.uint64(1)) ^ (np.uint64(0) - (values & np.uint64(1)))).astype(np.int64)
    return values.astype(np.int64)


def deltas(data: bytes) -> np.ndarray:
    """Packed signed differences, summed up."""
    return np.cumsum(unpack(data, True))


def varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def pack(values, signed: bool = False) -> bytes:
    """Varints of many numbers, in vectors."""
    v = np.asarray(values, dtype=np.int64)
    if not len(v):
        return b""
    u = ((v << 1) ^ (v >> 63)).astype(np.uint64) if signed else v.astype(np.uint64)
    groups = (u[:, None] >> (np.arange(10, dtype=np.uint64) * np.uint64(7))) & np.uint64(0x7F)
    last = 9 - np.argmax(groups[:, ::-1] != 0, axis=1)
    last = np.where(u == 0, 0, last)
    keep = np.arange(10) <= last[:, None]
    out = groups.astype(np.uint8) | np.where(np.arange(10) < last[:, None], 0x80, 0).astype(np.uint8)
    return out[keep].tobytes()


def pack_deltas(values) -> bytes:
    v = np.asarray(values, dtype=np.int64)
    return pack(np.diff(v, prepend=np.int64(0)), True)


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value
