"""What an array is cut into, and the checks on it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from math import ceil, prod

import numpy as np

BLOCK = 4
#: Bytes that an object of zone-map records holds at about the most, and units along the first axis that it covers.
OBJECT_BYTES, OBJECT_UNITS = 2_000_000, 16


@dataclass(frozen=True)
class ArraySpec:
    """A 3-D float32 array of chunks, units of a chunk and 4x4x4 blocks of 64 values.

    length: if not 0, only the first so many values in C order exist; the rest of the last
    chunks is padding that no query sees. folder_chunks: chunks that share a folder of the
    store; 0: as their bytes suggest. An array that grows needs it.
    """

    shape: tuple[int, int, int]
    chunk: tuple[int, int, int] = (16, 16, 16)
    sub_chunk: tuple[int, int, int] = ()
    block_order: tuple[int, int, int] = (0, 1, 2)
    rate: float = 8.0
    layers: tuple[float, ...] = ()
    block_error_bits: int = 0
    length: int = 0
    folder_chunks: int = 0

    def __post_init__(self) -> None:
        for name in ("shape", "chunk", "sub_chunk", "block_order", "layers"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if not self.rate > 0 or self.rate * 8 % 1:
            raise ValueError("rate must be greater than 0 and a multiple of 0.125")
        if self.layers and (list(self.layers) != sorted(set(self.layers)) or self.layers[-1] != self.rate or any(x <= 0 or x * 8 % 1 for x in self.layers)):
            raise ValueError("layers must be increasing, be multiples of 0.125 and end at rate")
        if sorted(self.block_order) != [0, 1, 2]:
            raise ValueError("block_order must be a permutation of (0, 1, 2)")
        if self.sub_chunk and (len(self.sub_chunk) != 3 or any(x <= 0 or x % BLOCK for x in self.sub_chunk)):
            raise ValueError("sub_chunk must be three positive multiples of 4")
        if self.block_error_bits not in (0, 4) or (self.block_error_bits and len(self.layers) > 1):
            raise ValueError("block_error_bits must be 0, or 4 with a single layer")
        if len(self.shape) != 3 or len(self.chunk) != 3:
            raise ValueError("the array must be 3-D")
        if any(c <= 0 or c % BLOCK for c in self.chunk) or any(c % u for c, u in zip(self.chunk, self.unit, strict=True)):
            raise ValueError("the chunk must be a whole number of blocks and units")
        if any(s <= 0 or s % c for s, c in zip(self.shape, self.chunk, strict=True)):
            raise ValueError("the shape must be a whole multiple of the chunk")
        if not 0 <= self.length <= prod(self.shape):
            raise ValueError("length must be between 0 and the number of values")

    @property
    def unit(self) -> tuple[int, int, int]:
        return self.sub_chunk or self.chunk

    @property
    def rates(self) -> tuple[float, ...]:
        return self.layers or (self.rate,)

    @property
    def top(self) -> int:
        """The layer of the full rate."""
        return len(self.rates) - 1

    @property
    def grid(self) -> tuple[int, ...]:
        """Chunks along each axis."""
        return tuple(s // c for s, c in zip(self.shape, self.chunk, strict=True))

    @property
    def units(self) -> tuple[int, ...]:
        """Units of a chunk along each axis."""
        return tuple(c // u for c, u in zip(self.chunk, self.unit, strict=True))

    @property
    def inner(self) -> tuple[int, ...]:
        """Blocks of a unit along each axis."""
        return tuple(u // BLOCK for u in self.unit)

    @property
    def blocks_per_unit(self) -> int:
        return prod(self.inner)

    @property
    def blocks_per_chunk(self) -> int:
        return prod(c // BLOCK for c in self.chunk)

    @property
    def n_chunks(self) -> int:
        return prod(self.grid)

    @property
    def n_values(self) -> int:
        return self.length or prod(self.shape)

    @property
    def total_blocks(self) -> int:
        """Blocks of the whole shape, padding included."""
        return prod(self.shape) // 64

    @property
    def stored_blocks(self) -> int:
        """Blocks that hold a value."""
        if not self.length:
            return self.total_blocks
        # Whole rows and planes of blocks in front of the last value, by corners alone.
        _, ny, nx = self.shape
        t, rest = divmod(self.length - 1, ny * nx)
        y, x = divmod(rest, nx)
        whole = t // BLOCK * (ny // BLOCK) * (nx // BLOCK)
        if t % BLOCK:  # an earlier plane of these blocks is full
            return whole + (ny // BLOCK) * (nx // BLOCK)
        return whole + y // BLOCK * (nx // BLOCK) + (nx // BLOCK if y % BLOCK else x // BLOCK + 1)

    def layer_bytes(self, layer: int) -> int:
        """Bytes that a layer adds to each block."""
        return int(8 * (self.rates[layer] - (self.rates[layer - 1] if layer else 0)))

    def prefix_bytes(self, layer: int) -> int:
        return int(8 * self.rates[layer])

    @property
    def record_bytes(self) -> int:
        """Zone-map bytes of a unit: minimum, maximum, an error for each layer, two bytes a block and its code."""
        n = self.blocks_per_unit
        return 8 + 4 * len(self.rates) + 2 * n + (-(-n * self.block_error_bits // 8) if self.block_error_bits else 0)

    @property
    def object_units(self) -> int:
        """Units along the first axis whose records one object holds."""
        rows = self.record_bytes * prod(g * u for g, u in zip(self.grid[1:], self.units[1:], strict=True))
        return min(self.grid[0] * self.units[0], max(1, min(OBJECT_UNITS, OBJECT_BYTES // rows)))

    @property
    def objects(self) -> int:
        return ceil(self.grid[0] * self.units[0] / self.object_units)

    def corners(self, chunk: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        """The first cell (t, y, x) of blocks by chunk and place in it."""
        sub, rank = np.divmod(pos, self.blocks_per_unit)
        ordered = np.unravel_index(rank, tuple(self.inner[a] for a in self.block_order))
        inside = dict(zip(self.block_order, ordered, strict=True))
        of_chunk, of_unit = np.unravel_index(chunk, self.grid), np.unravel_index(sub, self.units)
        return tuple(of_chunk[k] * self.chunk[k] + of_unit[k] * self.unit[k] + inside[k] * BLOCK for k in range(3))

    def exists(self, chunk: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """(n, 64) flags: which cells of blocks are values and not padding."""
        if not self.length:
            return np.ones((len(pos), 64), bool)
        t, y, x = (c[:, None] + a.ravel() for c, a in zip(self.corners(chunk, pos), np.indices((BLOCK,) * 3), strict=True))
        return (t.astype(np.int64) * self.shape[1] + y) * self.shape[2] + x < self.length

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ArraySpec:
        values = json.loads(text)
        if not isinstance(values, dict):
            raise TypeError("the configuration must be an object")
        return cls(**values)


def layout(name: str, rate: float = 8.0, sub_chunk: tuple[int, int, int] = (64, 16, 32)) -> tuple[dict, bool]:
    """Arguments of ArraySpec by a layout's name, and whether its zone map is packed.

    A t behind the first part: blocks along time follow each other; -b4: an error code of 4 bits
    for each block; -z: packed records.
    """
    first, *rest = name.split("-")
    if not set(rest) <= {"b4", "z"}:
        raise ValueError(f"unknown layout: {name}")
    order = (1, 2, 0) if first.endswith("t") else (0, 1, 2)
    return {"rate": rate, "sub_chunk": sub_chunk, "block_order": order, "block_error_bits": 4 if "b4" in rest else 0}, "z" in rest
