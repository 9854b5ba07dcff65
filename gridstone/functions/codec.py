"""Fixed-rate transform coding of 4x4x4 float32 blocks (Lindstrom 2014), in NumPy across blocks.

A block becomes 64 integers of a common exponent, which an orthogonal-like lifting along
each axis decorrelates; their bit planes are coded from the highest on by group tests, and
the code is cut at 64 * rate bits. A prefix of a block is the block at a lower rate. Blocks
of one and two dimensions (4 and 16 values) are coded alike.
"""

from __future__ import annotations

import numpy as np

#: Order of coefficients by total frequency, as (x, y, z); fixed values of the format.
ORDER = (
    (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 0), (2, 0, 0),
    (0, 2, 0), (0, 0, 2), (1, 1, 1), (2, 1, 0), (2, 0, 1), (0, 2, 1), (1, 2, 0), (1, 0, 2),
    (0, 1, 2), (3, 0, 0), (0, 3, 0), (0, 0, 3), (2, 1, 1), (1, 2, 1), (1, 1, 2), (0, 2, 2),
    (2, 0, 2), (2, 2, 0), (3, 1, 0), (3, 0, 1), (0, 3, 1), (1, 3, 0), (1, 0, 3), (0, 1, 3),
    (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 1), (1, 3, 1), (1, 1, 3), (3, 2, 0), (3, 0, 2),
    (0, 3, 2), (2, 3, 0), (2, 0, 3), (0, 2, 3), (2, 2, 2), (3, 2, 1), (3, 1, 2), (1, 3, 2),
    (2, 3, 1), (2, 1, 3), (1, 2, 3), (0, 3, 3), (3, 0, 3), (3, 3, 0), (3, 2, 2), (2, 3, 2),
    (2, 2, 3), (1, 3, 3), (3, 1, 3), (3, 3, 1), (2, 3, 3), (3, 2, 3), (3, 3, 2), (3, 3, 3),
)
#: The same for two dimensions, as (x, y).
ORDER_2D = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (3, 0), (0, 3), (2, 2), (3, 1), (1, 3), (3, 2), (2, 3), (3, 3))
_PERM = {64: np.array([x + 4 * y + 16 * z for x, y, z in ORDER]), 16: np.array([x + 4 * y for x, y in ORDER_2D]), 4: np.arange(4)}
_BIAS, _PLANES, _HEADER = 127, 32, 9
_NEGABINARY = np.uint32(0xAAAAAAAA)


def _lift(a: np.ndarray, axis: int) -> None:
    x, y, z, w = (np.take(a, k, axis=axis) for k in range(4))
    x = (x + w) >> 1
    w = w - x
    z = (z + y) >> 1
    y = y - z
    x = (x + z) >> 1
    z = z - x
    w = (w + y) >> 1
    y = y - w
    w = w + (y >> 1)
    y = y - (w >> 1)
    np.copyto(a, np.stack([x, y, z, w], axis=axis))


def _unlift(a: np.ndarray, axis: int) -> None:
    x, y, z, w = (np.take(a, k, axis=axis) for k in range(4))
    y = y + (w >> 1)
    w = w - (y >> 1)
    y = y + w
    w = (w << 1) - y
    z = z + x
    x = (x << 1) - z
    y = y + z
    z = (z << 1) - y
    w = w + x
    x = (x << 1) - w
    np.copyto(a, np.stack([x, y, z, w], axis=axis))


class _Bits:
    """A cursor in each row of a matrix of bits; nothing is written or read beyond the rows' end."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.at = bits, np.zeros(len(bits), np.int64)

    def left(self) -> np.ndarray:
        return self.at < self.bits.shape[1]

    def put(self, rows: np.ndarray, values: np.ndarray) -> None:
        k = np.flatnonzero(rows & self.left())
        self.bits[k, self.at[k]] = values[k]
        self.at[k] += 1

    def get(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        k = np.flatnonzero(rows & self.left())
        out[k] = self.bits[k, self.at[k]]
        self.at[k] += 1
        return out


def block_bytes(rate: float, size: int = 64) -> int:
    return int(size * rate) // 8


def _cubes(x: np.ndarray) -> tuple[np.ndarray, range]:
    """Blocks as arrays of their dimensions, and these, the fastest last."""
    dims = {4: 1, 16: 2, 64: 3}[x.shape[1]]
    return x.reshape(len(x), *[4] * dims), range(1, dims + 1)


def _coefficients(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Negabinary coefficients in the order of coding, the common exponents, and which blocks aren't zero."""
    if not np.isfinite(blocks).all():
        raise ValueError("values must be finite")
    n, size = blocks.shape
    _, exponent = np.frexp(np.abs(blocks).max(axis=1, initial=0))
    some = blocks.any(axis=1)
    top = np.where(some, np.maximum(exponent, 1 - _BIAS), -_BIAS)
    ints, axes = _cubes(np.trunc(np.ldexp(blocks.astype(np.float64), (30 - top)[:, None])).astype(np.int32))
    for axis in reversed(axes):
        _lift(ints, axis)
    code = (ints.reshape(n, size)[:, _PERM[size]].view(np.uint32) + _NEGABINARY) ^ _NEGABINARY
    return code, top, some


def _values(code: np.ndarray, top: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The inverse of _coefficients()."""
    n, size = code.shape
    ints = np.empty((n, size), np.int32)
    ints[:, _PERM[size]] = ((code ^ _NEGABINARY) - _NEGABINARY).view(np.int32)
    ints, axes = _cubes(ints)
    for axis in axes:
        _unlift(ints, axis)
    scaled = np.ldexp(ints.reshape(n, size).astype(np.float32).astype(np.float64), (top - 30)[:, None])
    return np.where(some[:, None], scaled, 0).astype(np.float32)


def at_tolerance(blocks: np.ndarray, tolerance: float) -> np.ndarray:
    """Values as they come back if each block keeps the bit planes that an absolute error of at most tolerance needs."""
    blocks = np.ascontiguousarray(blocks, np.float32)
    code, top, some = _coefficients(blocks)
    dims = {4: 1, 16: 2, 64: 3}[blocks.shape[1]]
    kept = np.clip(top - int(np.floor(np.log2(tolerance))) + 2 * (dims + 1), 0, _PLANES)
    mask = np.where(kept > 0, (np.uint64(0xFFFFFFFF) << (_PLANES - kept).astype(np.uint64)) & np.uint64(0xFFFFFFFF), np.uint64(0)).astype(np.uint32)
    return _values(code & mask[:, None], top, some & (kept > 0))


def encode(blocks: np.ndarray, rate: float) -> np.ndarray:
    """(n, size) float32 in C order to (n, size * rate / 8) bytes; size: 64, or 16 or 4 for fewer dimensions."""
    blocks = np.ascontiguousarray(blocks, np.float32)
    code, top, some = _coefficients(blocks)
    n, size = blocks.shape
    stream = _Bits(np.zeros((n, int(size * rate)), bool))
    stream.put(np.ones(n, bool), some)
    for k in range(8):
        stream.put(some, (top + _BIAS) >> k & 1 == 1)
    known = np.zeros(n, np.int64)  # coefficients that have had a bit set
    for plane in range(_PLANES - 1, -1, -1):
        live = some & stream.left()
        if not live.any():
            break
        bit = (code >> np.uint32(plane) & np.uint32(1)).astype(bool)
        rest = np.logical_or.accumulate(bit[:, ::-1], axis=1)[:, ::-1]
        start, test = known.copy(), np.ones(n, bool)
        for c in range(size):
            head = live & (c < start)
            stream.put(head, bit[:, c])
            tail = live & ~head
            asks = tail & test
            stream.put(asks, rest[:, c])
            live = live & ~(asks & ~rest[:, c])
            tail &= live
            if not (live.any()):
                break
            if c < size - 1:
                stream.put(tail, bit[:, c])
            found = tail & bit[:, c]
            known[found] = c + 1
            test = np.where(tail, found, test)
    return np.packbits(stream.bits, axis=1, bitorder="little")


def decode(data: np.ndarray, size: int = 64) -> np.ndarray:
    """(n, bytes) to (n, size) float32; the rate follows from the width."""
    n = len(data)
    stream = _Bits(np.unpackbits(np.ascontiguousarray(data, np.uint8), axis=1, bitorder="little").astype(bool))
    some = stream.get(np.ones(n, bool))
    top = np.zeros(n, np.int64)
    for k in range(8):
        top += stream.get(some).astype(np.int64) << k
    top -= _BIAS
    code, known = np.zeros((n, size), np.uint32), np.zeros(n, np.int64)
    for plane in range(_PLANES - 1, -1, -1):
        live = some & stream.left()
        if not live.any():
            break
        start, test, value = known.copy(), np.ones(n, bool), np.uint32(1 << plane)
        for c in range(size):
            head = live & (c < start)
            code[head & stream.get(head), c] |= value
            tail = live & ~head
            asks = tail & test
            live &= ~(asks & ~stream.get(asks))
            tail &= live
            if not live.any():
                break
            # Where the code ends inside a run the coefficient it stopped at is set.
            ended = tail & ~stream.left() if c < size - 1 else tail
            found = ended | stream.get(tail & ~ended) if c < size - 1 else tail
            code[found, c] |= value
            known[found] = c + 1
            test = np.where(tail, found, test)
            live &= ~ended
    return _values(code, top, some)
