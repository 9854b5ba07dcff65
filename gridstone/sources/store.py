"""Arrays as tables: cells from rows, blocks from cells, payload and zone map in a store.

payload     block, chunk_id, pos, unit_id, valid, crc, the zone map's columns, l0, l1, ...
zone_map    the same without the layers: what planning reads
source      the layout that the zone map was built for, and chunk_crc, what its chunks were

Both tables are sorted by block (a chunk's number times its blocks, plus pos) and cut into
folders by ranges of it, so that a range of blocks is a few pages of a few files. A payload
row carries its own zone-map columns: a query classifies it where it is read, and payload
and zone map are never joined.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.functions import codec
from gridstone.functions.expr import error_code, place, quantised
from gridstone.plans.spec import ArraySpec

#: Payload bytes of a folder at least, and folders at most.
FOLDER_BYTES, MOST_FOLDERS = 64 << 20, 1024
#: How payload files are cut: a reader skips row groups and pages of blocks that no range names.
FILE_OPTIONS = {"parquet.block.size": str(16 << 20), "parquet.page.row.count.limit": "256"}
ALL = -1  # flags of a block whose 64 values all exist


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names; a private one only if all run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridstone-"))
    return sc.getCheckpointDir()


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _path(spark, folder)
    return files.exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def indexed(df: DataFrame, order: list[str], index: str = "i") -> DataFrame:
    """df with the 0-based place of each row in an order: range partitions, and counts of the partitions before."""
    return _indexed(df, order, index)[0]


def _indexed(df: DataFrame, order: list[str], index: str = "i") -> tuple[DataFrame, int]:
    """indexed(), and the number of rows."""
    shared_folder(df.sparkSession)
    mark = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", mark).checkpoint()
    rows = rows.withColumns({"_p": F.shiftright("_m", 33), "_k": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = sorted((r[0], r[1]) for r in rows.groupBy("_p").count().collect())  # a row for each partition
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _s long")
    return rows.join(F.broadcast(offsets), "_p").withColumn(index, F.col("_s") + F.col("_k")).drop("_m", "_p", "_k", "_s"), at


def cells_from_table(df: DataFrame, value: Column, order: list[str], width: tuple[int, int] = (16, 16), step: int = 16) -> tuple[DataFrame, int, int]:
    """(t, y, x, v) of all rows in an order, the steps t of an array that holds them in whole chunks, and their number.

    The last chunk may be padded: pass the number of rows as ArraySpec.length.
    """
    plane = width[0] * width[1]
    rows, n = _indexed(df.select(*order, value.cast("float").alias("v")), order)
    t = F.floor(F.col("i") / plane).cast("int")
    cells = rows.select(t.alias("t"), F.floor(F.col("i") % plane / width[1]).cast("int").alias("y"), (F.col("i") % width[1]).cast("int").alias("x"), "v")
    return cells, -(-n // (plane * step)) * step, n


# ---------------------------------------------------------------- encoding


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow array."""
    n, width = x.shape
    offsets = np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Bytes of equal length of an Arrow array, as rows."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int32, 1, 4 * column.offset)[0])
    out = np.frombuffer(data, np.uint8, len(column) * width, first).reshape(-1, width)
    last = int(np.frombuffer(offsets, np.int32, 1, 4 * (column.offset + len(column)))[0])
    if last - first != len(column) * width:
        raise ValueError("a stored block has another length than its layout says")
    return out


def _flags(exist: np.ndarray) -> np.ndarray:
    """(n, 64) flags as 64-bit numbers."""
    return np.packbits(exist, axis=1, bitorder="little").view("<i8").ravel()


def existing(valid: pa.Array) -> np.ndarray:
    """(n, 64) flags from a column of 64-bit numbers, null for all."""
    numbers = valid.fill_null(ALL).to_numpy(zero_copy_only=False).astype("<i8")
    return np.unpackbits(numbers.view(np.uint8).reshape(len(numbers), 8), axis=1, bitorder="little").astype(bool)


def _blocks(spec: ArraySpec, chunk: np.ndarray, unit: np.ndarray, pos: np.ndarray, cell: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Encoded blocks of whole units, from their cells in order of (chunk, pos, cell)."""
    if not np.isfinite(v).all():
        raise ValueError("a value isn't finite")
    new = np.append(True, (pos[1:] != pos[:-1]) | (chunk[1:] != chunk[:-1]))
    first, of = np.flatnonzero(new), np.cumsum(new) - 1
    given, values = np.zeros((len(first), 64), bool), np.zeros((len(first), 64), np.float32)
    given[of, cell], values[of, cell] = True, v
    chunk, unit, pos = chunk[first], unit[first], pos[first]
    exist = spec.exists(chunk, pos)
    starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    every = np.repeat(chunk[starts], spec.blocks_per_unit), (pos[starts] // spec.blocks_per_unit * spec.blocks_per_unit)[:, None] + np.arange(spec.blocks_per_unit)
    if given.sum() != len(v) or (given != exist).any() or spec.exists(every[0], every[1].ravel()).any(axis=1).sum() != len(first):
        raise ValueError("a block lacks values, or has one twice")
    low = np.where(exist, values, np.inf).min(axis=1).astype(np.float32)
    high = np.where(exist, values, -np.inf).max(axis=1).astype(np.float32)
    sizes = np.diff(np.append(starts, len(first)))
    of_unit = lambda f, x: np.repeat(f.reduceat(x, starts), sizes)
    values = np.where(exist, values, low[:, None])
    data = codec.encode(values, spec.rate)
    names, columns = ["chunk_id", "unit_id", "pos", "valid", "bmin", "bmax", "cmin", "cmax", "crc"], [pa.array(chunk), pa.array(unit), pa.array(pos)]
    flags = _flags(exist)
    columns += [pa.array(flags, mask=flags == ALL), pa.array(low), pa.array(high), pa.array(of_unit(np.minimum, low)), pa.array(of_unit(np.maximum, high)), pa.array([zlib.crc32(row) for row in data], pa.int64())]
    at = 0
    for layer in range(len(spec.rates)):
        to = spec.prefix_bytes(layer)
        err = (np.abs(values.astype(np.float64) - codec.decode(data[:, :to])) * exist).max(axis=1)
        names += [f"err{layer}", f"eps{layer}", f"l{layer}"]
        columns += [pa.array(err), pa.array(of_unit(np.maximum, err)), _binary(data[:, at:to])]
        at = to
    return pa.RecordBatch.from_arrays(columns, names)


def encoded(cells: DataFrame, spec: ArraySpec) -> DataFrame:
    """A row for each block that holds a value: bounds of its originals and its unit's, errors, checksum and layers, in order of chunk and pos.

    One shuffle brings the cells of a unit together, by ranges, so that the result is sorted;
    a task holds some units at once. Raises if a value is missing, doubled or not finite.
    """
    if dict(cells.dtypes)["v"] != "float":
        raise TypeError("values must be float")
    rows = cells.select(*[c.alias(k) for k, c in place(spec).items()], "v")
    rows = rows.withColumn("sub", F.floor(F.col("pos") / spec.blocks_per_unit))
    rows = rows.repartitionByRange("chunk_id", "sub").sortWithinPartitions("chunk_id", "pos", "cell").drop("sub")
    least = max(1, 4096 // spec.blocks_per_unit)  # units at once

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            waiting.append([batch.column(k).to_numpy() for k in range(5)])
            n += batch.num_rows
            if n >= least * 64 * spec.blocks_per_unit:
                parts = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                earlier = np.flatnonzero(parts[1] != parts[1][-1])  # the last unit may go on in the next batch
                whole = int(earlier[-1]) + 1 if len(earlier) else 0
                if whole:
                    yield _blocks(spec, *(p[:whole] for p in parts))
                waiting, n = [[p[whole:] for p in parts]], len(parts[0]) - whole
        if n:
            yield _blocks(spec, *(np.concatenate(c) for c in zip(*waiting, strict=True)))

    schema = "chunk_id int, unit_id int, pos int, valid long, bmin float, bmax float, cmin float, cmax float, crc long"
    return rows.mapInArrow(work, schema + "".join(f", err{k} double, eps{k} double, l{k} binary" for k in range(len(spec.rates))))


def zone_columns(spec: ArraySpec) -> list[str]:
    return ["cmin", "cmax", *(f"eps{k}" for k in range(len(spec.rates))), "qmin", "qmax", *(["code"] if spec.block_error_bits else [])]


def folder_blocks(spec: ArraySpec) -> int:
    """Blocks whose numbers share a folder."""
    whole = spec.total_blocks * spec.prefix_bytes(spec.top)
    n = max(1, min(MOST_FOLDERS, whole // FOLDER_BYTES))
    return (spec.folder_chunks or -(-spec.n_chunks // n)) * spec.blocks_per_chunk


def payload_rows(cells: DataFrame, spec: ArraySpec) -> DataFrame:
    """Encoded blocks with their folder, number and zone-map columns, in order of block."""
    rows = encoded(cells, spec)
    qmin, qmax = quantised(F.col("bmin"), F.col("bmax"), F.col("cmin"), F.col("cmax"))
    block = F.col("chunk_id").cast("long") * spec.blocks_per_chunk + F.col("pos")
    rows = rows.withColumns({"block": block, "qmin": qmin, "qmax": qmax} | ({"code": error_code(F.col("err0"), F.col("eps0"))} if spec.block_error_bits else {}))
    part = F.floor(F.col("block") / folder_blocks(spec)).cast("int").alias("part")
    rows = rows.select(part, "block", "chunk_id", "pos", "unit_id", "valid", "crc", *zone_columns(spec), *layer_columns(spec, None))
    return rows.sortWithinPartitions("part", "block")


def _write(rows: DataFrame, folder: str, **options: str) -> None:
    """Replace the folders of a table that the rows belong to; the folders are parts of the table."""
    rows.write.mode("overwrite").options(**{"partitionOverwriteMode": "dynamic"} | options).partitionBy("part").parquet(folder)


def write_payload(cells: DataFrame, spec: ArraySpec, folder: str) -> None:
    """Encode once; payload rows carry their zone-map columns."""
    _write(payload_rows(cells, spec), f"{folder}/payload", **FILE_OPTIONS)
    cells.sparkSession.createDataFrame([(spec.to_json(),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{folder}/array")


def write_zone_map(spark: SparkSession, spec: ArraySpec, folder: str, parts: Column | None = None) -> None:
    """The payload's narrow columns, the layout that they are for, and a checksum for each chunk; of all parts or of those named."""
    rows = spark.read.parquet(f"{folder}/payload").select("part", "block", "chunk_id", "pos", "unit_id", "valid", *zone_columns(spec), "crc")
    rows = rows if parts is None else rows.where(parts)
    _write(rows.drop("crc"), f"{folder}/zone_map", compression="zstd")
    n = spark.read.parquet(f"{folder}/zone_map").count()
    if n != spec.stored_blocks:
        raise ValueError(f"the array has {n} of {spec.stored_blocks} blocks: units lack values")
    _write(_chunk_crc(rows).withColumn("part", F.floor(F.col("chunk_id") / (folder_blocks(spec) // spec.blocks_per_chunk)).cast("int")), f"{folder}/chunk_crc")
    spark.createDataFrame([(spec.to_json(),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{folder}/source")


def _schema(spec: ArraySpec, payload: bool) -> str:
    """Columns of the stored tables: given, so that opening one reads no file."""
    kinds = {"cmin": "float", "cmax": "float", "qmin": "smallint", "qmax": "smallint", "code": "smallint"}
    zone = "".join(f", {c} {kinds.get(c, 'double')}" for c in zone_columns(spec))
    if not payload:
        return f"block bigint, chunk_id int, pos int, unit_id int, valid bigint{zone}, part int"
    return f"block bigint, chunk_id int, pos int, unit_id int, valid bigint, crc bigint{zone}" + "".join(f", {c} binary" for c in layer_columns(spec, None)) + ", part int"


@dataclass(frozen=True)
class Store:
    """An opened array: payload and zone map."""

    spark: SparkSession
    folder: str
    spec: ArraySpec

    @property
    def payload(self) -> DataFrame:
        return self.spark.read.schema(_schema(self.spec, True)).parquet(f"{self.folder}/payload")

    @property
    def zone_map(self) -> DataFrame:
        return self.spark.read.schema(_schema(self.spec, False)).parquet(f"{self.folder}/zone_map")

    def source(self) -> ArraySpec | None:
        """The layout that the zone map was built for; None if it wasn't recorded, which is trusted."""
        folder = f"{self.folder}/source"
        return ArraySpec.from_json(self.spark.read.text(folder).first()[0]) if exists(self.spark, folder) else None

    def check_source(self, spec: ArraySpec | None = None) -> None:
        if (spec or self.source() or self.spec) != self.spec:
            raise ValueError("the zone map was built for another layout")


def create(cells: DataFrame, spec: ArraySpec, folder: str | None = None) -> Store:
    """Write cells (t, y, x, v) as an array: payload, zone map and checksums."""
    spark = cells.sparkSession
    folder = folder or f"{shared_folder(spark)}/array-{uuid.uuid4().hex}"
    write_payload(cells, spec, folder)
    write_zone_map(spark, spec, folder)
    return Store(spark, folder, spec)


def open_store(spark: SparkSession, source: str | Store, array_path: str = "", storage_options: dict[str, str] | None = None) -> Store:
    """An array by its folder on any file system, or as it is if it was opened before.

    storage_options: settings for the file system, such as credentials. A folder that isn't an
    array raises TypeError, one that doesn't exist FileNotFoundError, a zone map for another
    layout ValueError.
    """
    if isinstance(source, Store):
        for name, given in (("array_path", array_path), ("storage_options", storage_options)):
            if given:
                raise ValueError(f"{name} cannot be used with an opened array")
        return source
    for key, value in (storage_options or {}).items():
        spark.sparkContext._jsc.hadoopConfiguration().set(key, value)
    folder = source.rstrip("/") + (f"/{array_path.strip('/')}" if array_path else "")
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    if not exists(spark, f"{folder}/array"):
        raise TypeError(f"not an array: {folder}")
    found = Store(spark, folder, ArraySpec.from_json(spark.read.text(f"{folder}/array").first()[0]))
    if not exists(spark, f"{folder}/zone_map"):
        raise ValueError("the array has no zone map")
    found.check_source()
    return found


# ---------------------------------------------------------------- decoding


def layer_columns(spec: ArraySpec, layer: int | None) -> list[str]:
    return [f"l{k}" for k in range((spec.top if layer is None else layer) + 1)]


def decoding(spec: ArraySpec, layer: int | None, at: int, most_bytes: int | None = None):
    """A function from Arrow batches to (part of a batch, its values (n, 64)): the layers begin at column ``at``, at most most_bytes of them at once."""
    top = spec.top if layer is None else layer
    widths = [spec.layer_bytes(k) for k in range(top + 1)]
    step = max(1, most_bytes // sum(widths)) if most_bytes else 1 << 16

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                yield part, codec.decode(np.concatenate([_fixed(part.column(at + j), w) for j, w in enumerate(widths)], axis=1))

    return values


def decoded(payload: DataFrame, spec: ArraySpec, layer: int | None = None, keep: tuple[str, ...] = ("chunk_id", "pos", "valid")) -> DataFrame:
    """(keep..., v ARRAY<FLOAT>): only the layers up to one are read; v has 64 values, of which padding is to be left out by valid."""
    rows = payload.select(*keep, *layer_columns(spec, layer))
    values = decoding(spec, layer, len(keep))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in values(batches):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * len(v) + 1, 64), pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], [*part.schema.names[: len(keep)], "v"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(work, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "v array<float>"]))


def blocks_of(cells: DataFrame, spec: ArraySpec) -> DataFrame:
    """(chunk_id, pos, v ARRAY<FLOAT>): original values of blocks in C order, null where padded."""
    rows = cells.select(*[c.alias(k) for k, c in place(spec).items()], "v")
    at = F.map_from_entries(F.collect_list(F.struct("cell", "v")))
    return rows.groupBy("chunk_id", "pos").agg(at.alias("m")).select("chunk_id", "pos", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.try_element_at("m", k)).alias("v"))


# ---------------------------------------------------------------- checksums


def _chunk_crc(rows: DataFrame) -> DataFrame:
    """(chunk_id, crc) from (chunk_id, pos, crc): the checksum of a chunk's ordered block checksums."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "crc")))
    text = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["pos"].cast("string"), s["crc"].cast("string"))), ",")
    return rows.groupBy("chunk_id").agg(text.alias("t")).select("chunk_id", F.crc32(F.col("t").cast("binary")).alias("crc"))


def chunk_crc(payload: DataFrame) -> DataFrame:
    """(chunk_id, crc) of the stored bytes."""
    layers = sorted((c for c in payload.columns if c[0] == "l" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    return _chunk_crc(payload.select("chunk_id", "pos", F.crc32(F.concat(*layers)).alias("crc")))


def check_meta(store: Store) -> DataFrame:
    """chunk_id of the chunks whose stored bytes changed, went or came since the zone map was built."""
    if not exists(store.spark, f"{store.folder}/chunk_crc"):
        raise ValueError("no zone map source recorded")
    old, new = store.spark.read.parquet(f"{store.folder}/chunk_crc").alias("o"), chunk_crc(store.payload).alias("n")
    both = old.join(new, F.col("o.chunk_id") == F.col("n.chunk_id"), "full_outer")
    return both.where(~F.col("o.crc").eqNullSafe(F.col("n.crc"))).select(F.coalesce("o.chunk_id", "n.chunk_id").alias("chunk_id"))


def slabs(cells: DataFrame, steps: int, step: int = 4096) -> Iterator[DataFrame]:
    """Cells by ranges of t, one after another."""
    for t in range(0, steps, step):
        yield cells.where((F.col("t") >= t) & (F.col("t") < t + step))

