"""Stores without a block codec, to compare with: compressed chunks, and shards of them with an index at their end.

chunks   chunk, data: a chunk's values, their bytes shuffled and compressed
shards   shard, data: inner chunks one after another, then their (offset, size) pairs, then a checksum
stats    bounds and numbers of values of (inner) chunks, what skipping needs
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.functions import codec

#: Offset and size of an inner chunk that has no bytes; fixed value of the format.
EMPTY = 0xFFFFFFFFFFFFFFFF
#: Chunks to read that are broadcast at most; more are joined by shuffles.
MOST_LISTED = 100_000

Shape = tuple[int, int, int]


def _ravel(parts: list[Column], sizes: tuple[int, ...]) -> Column:
    out = parts[0]
    for p, n in zip(parts[1:], sizes[1:], strict=True):
        out = out * n + p
    return out


def _press(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpress(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<f4").ravel()


def _coded(values: np.ndarray, shape: Shape, tolerance: float) -> np.ndarray:
    """What fixed-accuracy coding of a chunk's 4x4x4 blocks gives back; absent values (NaN) stay."""
    x = values.reshape(shape[0] // 4, 4, shape[1] // 4, 4, shape[2] // 4, 4).transpose(0, 2, 4, 1, 3, 5)
    flat = x.reshape(-1, 64)
    real = np.isfinite(flat)
    low = np.where(real.any(axis=1), np.where(real, flat, np.inf).min(axis=1), 0)
    back = np.where(real, codec.at_tolerance(np.where(real, flat, low[:, None]), tolerance), np.nan)
    return back.reshape(x.shape).transpose(0, 3, 1, 4, 2, 5).reshape(-1).astype(np.float32)


@dataclass(frozen=True)
class Chunked:
    """An array as compressed chunks; shard: so many chunks' shape share a row with an index."""

    spark: SparkSession
    folder: str
    shape: Shape
    chunk: Shape
    shard: Shape | None = None

    @property
    def whole(self) -> Shape:
        return self.shard or self.chunk

    @property
    def n_inner(self) -> int:
        return prod(w // c for w, c in zip(self.whole, self.chunk, strict=True))

    @property
    def data(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/data")

    @property
    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/stats")

    def place(self) -> dict[str, Column]:
        """name (of the stored row), inner (of a chunk in it) and at (of a value in the chunk)."""
        axes = [F.col(a) for a in "tyx"]
        row = _ravel([F.floor(a / w).cast("int") for a, w in zip(axes, self.whole, strict=True)], tuple(s // w for s, w in zip(self.shape, self.whole, strict=True)))
        inner = _ravel([F.floor(a % w / c).cast("int") for a, w, c in zip(axes, self.whole, self.chunk, strict=True)], tuple(w // c for w, c in zip(self.whole, self.chunk, strict=True)))
        at = _ravel([a % c for a, c in zip(axes, self.chunk, strict=True)], self.chunk)
        return {"name": row.cast("int"), "inner": inner.cast("int"), "at": at.cast("int")}

    def axes(self, name: str = "name", inner: str = "inner", at: str = "at") -> list[Column]:
        """t, y, x of a value by place()."""

        def unravel(index: Column, sizes: tuple[int, ...]) -> list[Column]:
            out, step = [], 1
            for n in reversed(sizes):
                out.append(F.floor(index / step).cast("int") % n)
                step *= n
            return out[::-1]

        rows = unravel(F.col(name), tuple(s // w for s, w in zip(self.shape, self.whole, strict=True)))
        parts = unravel(F.col(inner), tuple(w // c for w, c in zip(self.whole, self.chunk, strict=True)))
        cells = unravel(F.col(at), self.chunk)
        return [(r * w + p * c + k).cast("int") for r, w, p, c, k in zip(rows, self.whole, parts, self.chunk, cells, strict=True)]


def write(cells: DataFrame, folder: str, shape: Shape, chunk: Shape, shard: Shape | None = None, tolerance: float | None = None) -> Chunked:
    """Write cells (t, y, x, v) as chunks or shards, and the bounds of their original values.

    tolerance: store what fixed-accuracy coding gives back instead of the values. The shape
    must be whole chunks (shards); cells that are absent are stored as NaN, which no predicate
    meets.
    """
    spark = cells.sparkSession
    out = Chunked(spark, folder, shape, chunk, shard)
    if any(s % w or w % c for s, w, c in zip(shape, out.whole, chunk, strict=True)):
        raise ValueError("the shape must be whole chunks and shards")
    if tolerance is not None and any(c % 4 for c in chunk):
        raise ValueError("chunks of coded values must be whole blocks")
    rows = cells.select(*[c.alias(k) for k, c in out.place().items()], F.col("v").cast("float").alias("v"))
    rows = rows.repartitionByRange("name").sortWithinPartitions("name", "inner")
    size, n_inner, sharded = prod(chunk), out.n_inner, shard is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        kind = pa.list_(pa.struct([("inner", pa.int32()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("err", pa.float64())]))

        def stored() -> pa.RecordBatch:
            name, inner, at, v = (np.concatenate(c) for c in zip(*waiting, strict=True))
            index, body, stats, place = np.full((n_inner, 2), EMPTY, np.uint64), [], [], 0
            for k in np.unique(inner).tolist():
                of = inner == k
                values = np.full(size, np.nan, np.float32)
                values[at[of]] = v[of]
                kept = values if tolerance is None else _coded(values, chunk, tolerance)
                err = float(np.nanmax(np.abs(kept.astype(np.float64) - values)))
                data = _press(kept)
                index[k] = place, len(data)
                place += len(data)
                body.append(data)
                stats.append({"inner": k, "n": int(of.sum()), "low": float(v[of].min()), "high": float(v[of].max()), "err": err})
            tail = index.astype("<u8").tobytes() if sharded else b""
            data = b"".join(body) + (tail + zlib.crc32(tail).to_bytes(4, "little") if sharded else b"")
            return pa.RecordBatch.from_arrays([pa.array(name[:1]), pa.array([data], pa.binary()), pa.array([stats], kind)], ["name", "data", "stats"])

        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(4)]
            cuts = [0, *(np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if waiting and waiting[0][0][0] != columns[0][a]:
                        yield stored()
                        waiting.clear()
                    waiting.append([c[a:b] for c in columns])
        if waiting:
            yield stored()

    rows.mapInArrow(work, "name int, data binary, stats array<struct<inner:int,n:long,low:double,high:double,err:double>>").write.mode("overwrite").option("compression", "uncompressed").parquet(f"{folder}/rows")
    written = spark.read.parquet(f"{folder}/rows")
    written.select("name", "data").write.mode("overwrite").option("compression", "uncompressed").parquet(f"{folder}/data")
    written.select("name", F.inline("stats")).write.mode("overwrite").parquet(f"{folder}/stats")
    from gridstone.sources.store import delete

    delete(spark, f"{folder}/rows")
    return out


def _index(data: bytes, n_inner: int) -> np.ndarray:
    tail, check = data[-16 * n_inner - 4 : -4], data[-4:]
    if len(tail) != 16 * n_inner or zlib.crc32(tail).to_bytes(4, "little") != check:
        raise ValueError("a shard's index is damaged")
    return np.frombuffer(tail, "<u8").reshape(n_inner, 2)


def shard_index(store: Chunked) -> DataFrame:
    """(name, inner, offset, size) of the inner chunks that shards hold, by the index at their end."""
    n_inner = store.n_inner

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                index = _index(data.as_py(), n_inner)
                some = np.flatnonzero(index[:, 0] != EMPTY)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(index[some, 0].astype(np.int64)), pa.array(index[some, 1].astype(np.int64))], ["name", "inner", "offset", "size"])

    return store.data.mapInArrow(work, "name int, inner int, offset long, size long")


def _parts(data: bytes, store_shard: bool, n_inner: int, wanted: list[int] | None) -> Iterator[tuple[int, np.ndarray]]:
    """(inner, values) of a stored row: of a shard only the inner chunks wanted."""
    if not store_shard:
        yield 0, _unpress(data)
        return
    index = _index(data, n_inner)
    for k in range(n_inner) if wanted is None else wanted:
        if index[k, 0] != EMPTY:
            yield k, _unpress(data[int(index[k, 0]) : int(index[k, 0] + index[k, 1])])


def _counted(rows: DataFrame, store: Chunked, lo: float, hi: float) -> DataFrame:
    """One row (met): values in the range of rows (data, wanted): wanted null for all inner chunks."""
    sharded, n_inner = store.shard is not None, store.n_inner

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = 0
            for data, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for _, v in _parts(data.as_py(), sharded, n_inner, wanted):
                    met += int(((v > np.float64(lo)) & (v <= np.float64(hi))).sum())
            yield pa.RecordBatch.from_arrays([pa.array([met], pa.int64())], ["n"])

    return rows.select("data", "wanted").mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("met"))


def full_scan_count(store: Chunked, lo: float, hi: float) -> DataFrame:
    """COUNT by decoding everything."""
    return _counted(store.data.withColumn("wanted", F.lit(None).cast("array<int>")), store, lo, hi).select(F.col("met").alias("count"))


def zone_count(store: Chunked, lo: float, hi: float) -> DataFrame:
    """(count, zones_read, zones): COUNT by the stored bounds of (inner) chunks, widened by their error: those inside count unread, those outside are skipped, of the others' rows only the chunks that are undecided are decoded."""
    z = store.stats.withColumn("state", F.when((F.col("low") - F.col("err") > lo) & (F.col("high") + F.col("err") <= hi), 1).when((F.col("high") + F.col("err") <= lo) | (F.col("low") - F.col("err") > hi), 0).otherwise(2))
    told = z.agg(F.coalesce(F.sum(F.when(F.col("state") == 1, F.col("n"))), F.lit(0)).alias("sure"), F.count_if(F.col("state") == 2).alias("zones_read"), F.count("*").alias("zones")).first()
    listed = z.where("state = 2").groupBy("name").agg(F.sort_array(F.collect_list("inner")).alias("wanted"))
    rows = store.data.join(F.broadcast(listed) if told.zones_read <= MOST_LISTED else listed, "name")
    met = _counted(rows, store, lo, hi)
    return met.select((F.lit(told.sure) + F.col("met")).cast("long").alias("count"), F.lit(told.zones_read).cast("long").alias("zones_read"), F.lit(told.zones).cast("long").alias("zones"))


def point_series(store: Chunked, points: DataFrame) -> DataFrame:
    """(t, y, x, v) of points (y, x) over all t: each chunk over a point is decoded once; of a shard only the inner chunks over points."""
    sharded, n_inner = store.shard is not None, store.n_inner
    steps = store.spark.range(0, store.shape[0], store.chunk[0]).select(F.col("id").cast("int").alias("t"))
    near = points.select("y", "x").distinct()
    over = steps.join(F.broadcast(near)).select(*[c.alias(k) for k, c in store.place().items()]).select("name", "inner").distinct()
    listed = over.groupBy("name").agg(F.sort_array(F.collect_list("inner")).alias("wanted"))
    rows = store.data.join(listed, "name").select("name", "data", "wanted")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                for k, v in _parts(data.as_py(), sharded, n_inner, wanted):
                    n = len(v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(v)], ["name", "inner", "at", "v"])

    values = rows.mapInArrow(work, "name int, inner int, at int, v float").where(~F.isnan("v"))
    cells = values.select(*[c.alias(a) for a, c in zip("tyx", store.axes(), strict=True)], "v")
    return cells.join(F.broadcast(near), ["y", "x"], "left_semi").select("t", "y", "x", "v")
