"""Lossless codecs for columns of time series, block by block.

A block's stream starts afresh, so blocks decode in any order. Only values that are not null are encoded; a bitmap of
all rows goes beside them.

    F64   XOR with the value before: first value in 64 bits; then `0` for an equal one, `10` and the meaningful bits where
          they fit the window in force, else `11`, 5 bits of leading zeros (31 at most), 6 bits of length (64 as 0), bits
    I64   differences of differences modulo 2^64, zig-zag, LEB128; the first value and the first difference go the same way
    TS    as I64
    I32   zig-zag, LEB128
    BOOL  a bit each, most significant first

STR is not compressible.
"""

from __future__ import annotations

import numpy as np

from tidewake.types import Type

U64 = np.uint64


def zigzag(v: np.ndarray) -> np.ndarray:
    return (v.view(U64) << U64(1)) ^ (v >> np.int64(63)).view(U64)


def unzigzag(v: np.ndarray) -> np.ndarray:
    return ((v >> U64(1)) ^ (~(v & U64(1)) + U64(1))).view(np.int64)


def varints(v: np.ndarray) -> bytes:
    """LEB128 of unsigned values: seven bits a byte, low ones first, the top bit set on all but the last."""
    if not len(v):
        return b""
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += (v >> U64(7 * k)) != 0
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) - np.repeat(ends - size, size)
    out = (np.repeat(v, size) >> (at * 7).astype(U64)) & U64(127)
    out[at < np.repeat(size, size) - 1] |= U64(128)
    return out.astype(np.uint8).tobytes()


def unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, U64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    at = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.bitwise_or.reduceat((raw & 127).astype(U64) << (at * 7).astype(U64), first)


def encode_ints(v: np.ndarray) -> bytes:
    u = v.astype(np.int64).view(U64)
    first = np.concatenate([u[:1], np.diff(u)])
    return varints(zigzag(np.concatenate([first[:1], first[1:2], np.diff(first[1:])]).view(np.int64)))


def decode_ints(data: bytes) -> np.ndarray:
    second = unzigzag(unvarints(data)).view(U64)
    first = np.concatenate([second[:1], np.cumsum(second[1:], dtype=U64)])
    return np.cumsum(first, dtype=U64).view(np.int64)


def _zeros(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading and trailing zeros of values that are not 0."""
    filled = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        filled |= filled >> U64(k)
    return 64 - np.bitwise_count(filled).astype(np.int64), np.bitwise_count((x & (~x + U64(1))) - U64(1)).astype(np.int64)


def encode_floats(v: np.ndarray) -> bytes:
    if not len(v):
        return b""
    bits = v.astype(np.float64).view(U64)
    x = bits[1:] ^ bits[:-1]
    some = np.flatnonzero(x)
    zeros, tails = _zeros(x[some])
    # the window in force depends on all before it: numbers only in this loop, bits are laid out after it
    lead, end, leads, ends, opened = 65, 0, [], [], []
    for z, t in zip(np.minimum(zeros, 31).tolist(), tails.tolist(), strict=True):
        new = z < lead or t < end
        if new:
            lead, end = z, t
        leads.append(lead)
        ends.append(end)
        opened.append(new)
    lead, end, new = np.array(leads, np.int64), np.array(ends, np.int64), np.array(opened, bool)
    size = 64 - lead - end
    # a row for each value but the first: 2 bits of control, 11 of window, 64 of payload; `used` says which are written
    rows, used = np.zeros((len(x), 77), np.uint8), np.zeros((len(x), 77), bool)
    used[:, 0] = True
    rows[some, 0] = used[some, 1] = 1
    rows[some, 1] = new
    window = (lead << 6 | size & 63).astype(">u2").view(np.uint8).reshape(-1, 2)
    rows[some, 2:13] = np.unpackbits(window, axis=1)[:, 5:]
    used[some, 2:13] = new[:, None]
    rows[some, 13:] = np.unpackbits((x[some] >> end.astype(U64)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    used[some, 13:] = np.arange(64) >= (64 - size)[:, None]
    return bits[:1].astype(">u8").tobytes() + np.packbits(rows[used]).tobytes()


def decode_floats(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.float64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tobytes()
    data += bytes(9)  # windows and payloads are read by whole bytes, beyond the stream's last one too
    # first where each value's payload lies, by its control bits; then all payloads at once
    at, lead, size, width = 64, 0, 0, 0
    places, leads, sizes = [], [], []
    for _ in range(n - 1):
        if not bits[at]:
            at += 1
            width = 0
        else:
            if bits[at + 1]:
                window = int.from_bytes(data[at + 2 >> 3 : (at + 2 >> 3) + 3], "big") >> (13 - (at + 2 & 7)) & 2047
                lead, size = window >> 6, window & 63 or 64
                at += 13
            else:
                at += 2
            width = size
        places.append(at)
        sizes.append(width)
        leads.append(lead)
        at += width
    place, size, lead = (np.array(c, np.int64) for c in (places, sizes, leads))
    raw = np.frombuffer(data, np.uint8)
    words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    shift = (place & 7).astype(U64)
    value = (words[place >> 3].astype(U64) << shift) | (raw[(place >> 3) + 8].astype(U64) >> (U64(8) - shift))
    x = np.where(size > 0, value >> (U64(64) - np.maximum(size, 1).astype(U64)) << np.clip(64 - lead - size, 0, 63).astype(U64), U64(0))
    first = np.frombuffer(data[:8], ">u8").astype(U64)
    return np.bitwise_xor.accumulate(np.concatenate([first, x])).view(np.float64)


def encode(values: np.ndarray, kind: Type) -> bytes:
    """values without nulls."""
    if kind is Type.STR:
        raise ValueError("STR columns are not compressed")
    if kind is Type.F64:
        return encode_floats(values)
    if kind is Type.BOOL:
        return np.packbits(values.astype(bool)).tobytes()
    return varints(zigzag(values.astype(np.int64))) if kind is Type.I32 else encode_ints(values)


def decode(data: bytes, n: int, kind: Type) -> np.ndarray:
    if kind is Type.F64:
        return decode_floats(data, n)
    if kind is Type.BOOL:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
    return unzigzag(unvarints(data)).astype(np.int32) if kind is Type.I32 else decode_ints(data)


def bitmap(valid: np.ndarray) -> bytes:
    return np.packbits(valid, bitorder="little").tobytes()


def unbitmap(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)
