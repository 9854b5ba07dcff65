"""Column expressions of zone maps: ranks, quantised bounds, block errors, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridstone.plans.spec import BLOCK, ArraySpec

OUT, IN, MAYBE = 0, 1, 2
#: 8 times the spacing of doubles at 1: what a dequantised bound may be off by.
SLACK = 8 * 2.220446049250313e-16


def _raveled(parts: list[Column], sizes: list[int]) -> Column:
    out = parts[0]
    for p, n in zip(parts[1:], sizes[1:], strict=True):
        out = out * n + p
    return out


def _div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("int")


def _unraveled(index: Column, sizes: tuple[int, ...]) -> list[Column]:
    """C-order coordinates of an index."""
    out, step = [], 1
    for n in reversed(sizes):
        out.append(F.floor(index / step).cast("int") % n)
        step *= n
    return out[::-1]


def place(spec: ArraySpec, t: str = "t", y: str = "y", x: str = "x") -> dict[str, Column]:
    """chunk_id, unit_id (in the array), pos (of a block in its chunk) and cell (of a value in its block)."""
    axes = [F.col(t), F.col(y), F.col(x)]
    chunk = _raveled([_div(a, c) for a, c in zip(axes, spec.chunk, strict=True)], list(spec.grid))
    unit = _raveled([_div(a, u) for a, u in zip(axes, spec.unit, strict=True)], [s // u for s, u in zip(spec.shape, spec.unit, strict=True)])
    sub = _raveled([_div(a % c, u) for a, c, u in zip(axes, spec.chunk, spec.unit, strict=True)], list(spec.units))
    inside = [_div(a % u, BLOCK) for a, u in zip(axes, spec.unit, strict=True)]
    rank = _raveled([inside[k] for k in spec.block_order], [spec.inner[k] for k in spec.block_order])
    cell = _raveled([a % BLOCK for a in axes], [BLOCK] * 3)
    return {"chunk_id": chunk.cast("int"), "unit_id": unit.cast("int"), "pos": (sub * spec.blocks_per_unit + rank).cast("int"), "cell": cell.cast("int")}


def block_axes(spec: ArraySpec, chunk: str = "chunk_id", pos: str = "pos") -> list[Column]:
    """A block's place (bt, by, bx) in the grid of all blocks, whatever the order of blocks."""
    sub, rank = F.floor(F.col(pos) / spec.blocks_per_unit), F.col(pos) % spec.blocks_per_unit
    ordered = _unraveled(rank, tuple(spec.inner[a] for a in spec.block_order))
    inside = dict(zip(spec.block_order, ordered, strict=True))
    of_chunk, of_unit = _unraveled(F.col(chunk), spec.grid), _unraveled(sub, spec.units)
    return [(of_chunk[k] * (spec.chunk[k] // BLOCK) + of_unit[k] * spec.inner[k] + inside[k]).cast("int") for k in range(3)]


def cell_axes(spec: ArraySpec, cell: str = "cell") -> list[Column]:
    """A value's place (t, y, x) by its block's chunk_id and pos and its place in the block."""
    return [(b * BLOCK + c).cast("int") for b, c in zip(block_axes(spec), _unraveled(F.col(cell), (BLOCK,) * 3), strict=True)]


def quantised(bmin: Column, bmax: Column, cmin: Column, cmax: Column) -> tuple[Column, Column]:
    """Offsets 0..255 of a block's bounds inside its unit's, rounded outward."""
    span = cmax.cast("double") - cmin.cast("double")
    scale = F.lit(255.0) / F.nullif(span, F.lit(0.0))
    low = F.floor((bmin.cast("double") - cmin.cast("double")) * scale)
    high = F.ceil((bmax.cast("double") - cmin.cast("double")) * scale)
    fit = lambda q: F.coalesce(F.least(F.greatest(q, F.lit(0)), F.lit(255)), F.lit(0)).cast("short")
    return fit(low), fit(high)


def block_bounds(cmin: str = "cmin", cmax: str = "cmax", qmin: str = "qmin", qmax: str = "qmax") -> tuple[Column, Column]:
    """A block's bounds in double, with slack, from its offsets."""
    low, high = F.col(cmin).cast("double"), F.col(cmax).cast("double")
    span, slack = high - low, F.lit(SLACK) * (F.abs(low) + F.abs(high))
    bmin = low + (F.col(qmin) / F.lit(255.0)) * span - slack
    bmax = low + (F.col(qmax) / F.lit(255.0)) * span + slack
    return F.when(span == 0, low).otherwise(bmin), F.when(span == 0, low).otherwise(bmax)


def error_code(err: Column, eps: Column) -> Column:
    """The least of 16 steps of the unit's error that isn't below the block's."""
    q = F.ceil(15 * err / F.nullif(eps, F.lit(0.0)))
    q = q + F.when(eps * q / 15.0 < err, 1).otherwise(0)
    return F.coalesce(F.when(q > 15, F.raise_error(F.lit("a block's error is larger than its unit's"))).otherwise(q), F.lit(0)).cast("short")


def block_error(spec: ArraySpec, layer: int = 0) -> Column:
    eps = F.col(f"eps{layer}").cast("double")
    return eps * F.col("code") / F.lit(15.0) if spec.block_error_bits else eps


def state(bmin: Column, bmax: Column, eps: Column, lo: float, hi: float) -> Column:
    """IN if all values that the block may hold, originals and decoded ones, are in (lo, hi]; OUT if none; else MAYBE."""
    low, high = bmin - eps, bmax + eps
    inside = (low > F.lit(lo)) & (high <= F.lit(hi))
    return F.when(inside, IN).when((high <= F.lit(lo)) | (low > F.lit(hi)), OUT).otherwise(MAYBE)


def n_valid(valid: str = "valid") -> Column:
    """Values of a block, by its flags; null flags: all 64."""
    return F.coalesce(F.bit_count(F.col(valid)), F.lit(64))


def in_range(value: Column, lo: float, hi: float) -> Column:
    v = value.cast("double")
    return (v > F.lit(lo)) & (v <= F.lit(hi))


def next_up(x: Column) -> Column:
    """The next larger double. By Java's own method and its decimal text, which is exact; for single rows."""
    return F.java_method(F.lit("java.lang.Math"), F.lit("nextUp"), x.cast("double")).cast("double")


def next_down(x: Column) -> Column:
    """The next smaller double; for single rows."""
    return F.java_method(F.lit("java.lang.Math"), F.lit("nextDown"), x.cast("double")).cast("double")


def sort_key(x: Column) -> Column:
    """A long that orders doubles (floats widen to them) as they are ordered: their bits, turned over below zero. Null stays null."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double") + F.lit(0.0)).cast("long")
    return F.when(x.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits))


def key_value(key: Column) -> Column:
    """The double of a sort_key()."""
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(key)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


# ---------------------------------------------------------------- 4-bit codes


def pack_nibbles(codes: Column) -> Column:
    """Codes 0..15 as an array of bytes, two in each, the first in the low half; an odd one is followed by 0."""
    at = lambda k: F.coalesce(F.get(codes, k.cast("int")), F.lit(0)).cast("int")
    places = F.when(F.size(codes) > 0, F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: at(k * 2).bitwiseOR(F.shiftleft(at(k * 2 + 1), 4)))


def unpack_nibbles(packed: Column, n: Column) -> Column:
    """The first n codes of pack_nibbles()."""
    halves = F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(F.lit(15)), F.shiftright(b, 4).bitwiseAND(F.lit(15)))))
    return F.slice(halves, F.lit(1), n.cast("int"))
