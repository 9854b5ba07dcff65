"""Zone-map records as bytes: one for each unit, and objects of many, raw or with planes apart."""

from __future__ import annotations

import numpy as np
import zstandard

from gridstone.plans.spec import ArraySpec

PACKINGS = (None, "planar-zstd")


def records(spec: ArraySpec, cmin: np.ndarray, cmax: np.ndarray, eps: np.ndarray, qmin: np.ndarray, qmax: np.ndarray, code: np.ndarray | None = None) -> np.ndarray:
    """(units, record_bytes) of uint8 from bounds and errors (units, layers) of units and the offsets (units, blocks) of their blocks.

    Errors are rounded up to single precision, so that none falls below the true one.
    """
    single = eps.astype("<f4")
    single = np.where(single.astype(np.float64) < eps, np.nextafter(single, np.float32(np.inf)), single).astype("<f4")
    parts = [cmin.astype("<f4").reshape(-1, 1).view(np.uint8), cmax.astype("<f4").reshape(-1, 1).view(np.uint8), np.ascontiguousarray(single).view(np.uint8), np.stack([qmin, qmax], axis=2).astype(np.uint8).reshape(len(qmin), -1)]
    if spec.block_error_bits:
        parts.append(nibbles(code.astype(np.uint8)))
    return np.concatenate(parts, axis=1)


def fields(spec: ArraySpec, rec: np.ndarray) -> dict[str, np.ndarray]:
    """The inverse of records()."""
    n, layers = spec.blocks_per_unit, len(spec.rates)
    bounds = np.ascontiguousarray(rec[:, : 8 + 4 * layers]).view("<f4")
    offsets = rec[:, 8 + 4 * layers : 8 + 4 * layers + 2 * n].reshape(len(rec), n, 2)
    out = {"cmin": bounds[:, 0], "cmax": bounds[:, 1], "eps": bounds[:, 2:], "qmin": offsets[..., 0], "qmax": offsets[..., 1]}
    return out | ({"code": halves(rec[:, 8 + 4 * layers + 2 * n :], n)} if spec.block_error_bits else {})


def nibbles(codes: np.ndarray) -> np.ndarray:
    """(rows, n) codes 0..15 to bytes, two in each, the first in the low half."""
    even = np.pad(codes, [(0, 0), (0, codes.shape[1] % 2)])
    return even[:, ::2] + 16 * even[:, 1::2]


def halves(packed: np.ndarray, n: int) -> np.ndarray:
    """The first n codes of nibbles()."""
    out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = packed % 16, packed // 16
    return out[:, :n]


def planes(spec: ArraySpec, rec: np.ndarray) -> bytes:
    """Records with like bytes together: all bounds and errors, all minima as steps from the block before, all widths, all codes."""
    lead, n = 8 + 4 * len(spec.rates), spec.blocks_per_unit
    offsets = rec[:, lead : lead + 2 * n].reshape(len(rec), n, 2)
    steps = np.diff(offsets[..., 0], axis=1, prepend=np.uint8(0))  # of uint8, so modulo 256
    return b"".join(x.tobytes() for x in (rec[:, :lead], steps, offsets[..., 1] - offsets[..., 0], rec[:, lead + 2 * n :]))


def unplanes(spec: ArraySpec, data: bytes) -> np.ndarray:
    """The inverse of planes()."""
    size, lead, n = spec.record_bytes, 8 + 4 * len(spec.rates), spec.blocks_per_unit
    count = len(data) // size
    flat, at, out = np.frombuffer(data, np.uint8), 0, []
    for width in (lead, n, n, size - lead - 2 * n):
        out.append(flat[at : at + count * width].reshape(count, width))
        at += count * width
    low = np.add.accumulate(out[1], axis=1, dtype=np.uint8)
    return np.concatenate([out[0], np.stack([low, low + out[2]], axis=2).reshape(count, 2 * n), out[3]], axis=1)


def packed(spec: ArraySpec, rec: np.ndarray, packing: str | None) -> bytes:
    """An object of records."""
    if packing not in PACKINGS:
        raise ValueError(f"unknown packing of the zone map: {packing!r}")
    return zstandard.ZstdCompressor(level=3).compress(planes(spec, rec)) if packing else rec.tobytes()


def unpacked(spec: ArraySpec, data: bytes, packing: str | None, n: int | None = None) -> np.ndarray:
    """The records of an object; n: how many there must be."""
    if packing not in PACKINGS:
        raise ValueError(f"unknown packing of the zone map: {packing!r}")
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data) if packing else data
    if len(raw) % spec.record_bytes or (n is not None and len(raw) != n * spec.record_bytes):
        raise ValueError(f"an object of the zone map has {len(raw)} bytes, which doesn't match the layout")
    return unplanes(spec, raw) if packing else np.frombuffer(raw, np.uint8).reshape(-1, spec.record_bytes)
