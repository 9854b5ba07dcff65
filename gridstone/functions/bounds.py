"""Predicates as half-open ranges lo < x <= hi of float32 values, compared in double."""

from __future__ import annotations

import math
import struct


def next_single_below(x: float) -> float:
    """The largest single that is smaller than x, so that v >= x means v > next_single_below(x) for all singles v."""
    if math.isinf(x):
        return x if x < 0 else struct.unpack("<f", b"\xff\xff\x7f\x7f")[0]
    try:
        near = struct.unpack("<f", struct.pack("<f", x))[0]
    except OverflowError:  # beyond the largest single
        return next_single_below(math.inf) if x > 0 else -math.inf
    if near < x:
        return near
    if near == 0:
        return -struct.unpack("<f", b"\x01\0\0\0")[0]
    bits = struct.unpack("<i", struct.pack("<f", near))[0]
    return struct.unpack("<f", struct.pack("<i", bits - 1 if near > 0 else bits + 1))[0]


def range_bounds(lo: float | None, hi: float | None, lo_inclusive: bool = False, hi_inclusive: bool = True) -> tuple[float, float]:
    """(lo, hi) with lo < x <= hi; None is unbounded."""
    low, high = (-math.inf if lo is None else float(lo)), (math.inf if hi is None else float(hi))
    if math.isnan(low) or math.isnan(high):
        raise ValueError("a bound is NaN")
    if low > high:
        raise ValueError("lo is above hi")
    if lo is not None and lo_inclusive:
        low = next_single_below(low)
    if hi is not None and not hi_inclusive:
        high = next_single_below(high)
    return low, high
