"""Zarr v3 directories of block-coded arrays: read into a store, and a store's objects for writing one.

An array's folder has zarr.json (shape, chunk grid, codec and attributes) and one object for
each chunk, which holds its layers one after another, each with all blocks in order. The zone
map is an array of bytes beside it, one record for each unit; attributes of the array tell its
path, the units along the first axis in each object, how objects are packed and what it was
built from. Attributes are known by how their names end: _meta, _meta_t_chunk, _meta_packing
and _meta_source. No other encoder was at hand to compare written codes with.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.functions import records
from gridstone.plans.spec import ArraySpec
from gridstone.sources import store as st

CONFIG = ("rate", "layers", "block_order", "sub_chunk", "block_error_bits")


def _document(spark: SparkSession, folder: str) -> dict:
    if not st.exists(spark, f"{folder}/zarr.json"):
        raise FileNotFoundError(f"{folder}/zarr.json")
    return json.loads(spark.read.text(f"{folder}/zarr.json", wholetext=True).first()[0])


def spec_of(document: dict) -> ArraySpec:
    """The layout that an array's zarr.json describes."""
    if document.get("zarr_format") != 3 or document.get("node_type") != "array":
        raise TypeError("not a Zarr v3 array")
    if document["data_type"] != "float32":
        raise TypeError("only float32 is supported")
    coded = [c for c in document["codecs"] if isinstance(c, dict) and "rate" in (c.get("configuration") or {})]
    if not coded:
        raise ValueError("the array has no block codec")
    config = coded[0]["configuration"]
    if not isinstance(config, dict):
        raise TypeError("the configuration must be an object")
    if config.get("block_dim", 4) != 4:
        raise ValueError("blocks must be 4x4x4")
    chosen = {k: config[k] for k in CONFIG if config.get(k)}
    return ArraySpec(shape=document["shape"], chunk=document["chunk_grid"]["configuration"]["chunk_shape"], **chosen)


def _attribute(document: dict, ending: str):
    return next((v for k, v in document.get("attributes", {}).items() if k.endswith(ending)), None)


def _separator(document: dict) -> str:
    return document.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")


def _objects(spark: SparkSession, folder: str, dims: int, separator: str) -> DataFrame:
    """(c0, ..., content) of the chunk objects below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/c") if separator == "/" else spark.read.format("binaryFile").load(f"{folder}/c{separator}*")
    place = F.regexp_extract("path", "/c" + "".join([("/" if separator == "/" else f"\\{separator}") + "([0-9]+)"] * dims) + "$", 0)
    numbers = F.regexp_extract_all(place, F.lit("([0-9]+)"), F.lit(1))
    return files.select(*[F.get(numbers, F.lit(k)).cast("int").alias(f"c{k}") for k in range(dims)], "content").where("c0 is not null")


def _payload(objects: DataFrame, spec: ArraySpec) -> DataFrame:
    """(chunk_id, pos, crc, l0, ...) of chunk objects."""
    widths, n = [spec.layer_bytes(k) for k in range(len(spec.rates))], spec.blocks_per_chunk
    chunk = (F.col("c0") * spec.grid[1] + F.col("c1")) * spec.grid[2] + F.col("c2")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(content.as_py(), np.uint8)
                if len(data) != n * sum(widths):
                    raise ValueError(f"chunk {name} has {len(data)} bytes, not {n * sum(widths)}")
                parts = [p.reshape(n, -1) for p in np.split(data, np.cumsum([n * w for w in widths])[:-1])]
                crc = [zlib.crc32(row) for row in np.concatenate(parts, axis=1)]
                columns = [pa.array(np.full(n, name, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(crc, pa.int64()), *map(st._binary, parts)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "pos", "crc", *(f"l{k}" for k in range(len(widths)))])

    schema = "chunk_id int, pos int, crc long" + "".join(f", l{k} binary" for k in range(len(widths)))
    return objects.select(chunk.cast("int").alias("chunk_id"), "content").mapInArrow(work, schema)


def _zones(objects: DataFrame, spec: ArraySpec, per_object: int, packing: str | None) -> DataFrame:
    """(unit_id, rank, bounds, errors, offsets) of zone-map objects."""
    across = prod(g * u for g, u in zip(spec.grid[1:], spec.units[1:], strict=True))
    along, layers, n = spec.grid[0] * spec.units[0], len(spec.rates), spec.blocks_per_unit
    names = ["unit_id", "rank", "cmin", "cmax", *(f"eps{k}" for k in range(layers)), "qmin", "qmax", *(["code"] if spec.block_error_bits else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                real = min(per_object, along - i * per_object) * across
                if packing:
                    raw = records.zstandard.ZstdDecompressor().decompressobj().decompress(data)  # its padding behind the records isn't in planes
                    if len(raw) != per_object * across * spec.record_bytes:
                        raise ValueError(f"object {i} of the zone map has {len(raw)} bytes, which doesn't match the layout")
                    rec = records.unplanes(spec, raw[: real * spec.record_bytes])
                else:
                    rec = records.unpacked(spec, data, packing, per_object * across)
                rec = rec[:real]
                f = records.fields(spec, rec)
                units = np.arange(len(rec)) + i * per_object * across
                of = lambda x, kind: pa.array(np.repeat(x, n).astype(kind))
                columns = [of(units, np.int32), pa.array(np.tile(np.arange(n, dtype=np.int32), len(rec))), of(f["cmin"], np.float32), of(f["cmax"], np.float32), *[of(f["eps"][:, k], np.float64) for k in range(layers)], *[pa.array(f[k].ravel().astype(np.int16)) for k in names[4 + layers :]]]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ["int", "int", "float", "float", *["double"] * layers, *["short"] * (len(names) - 4 - layers)]
    return objects.select("c0", "content").mapInArrow(work, ", ".join(f"{k} {t}" for k, t in zip(names, kinds, strict=True)))


def read(spark: SparkSession, folder: str, array: str = "data", to: str | None = None) -> st.Store:
    """Bring an array of a Zarr group, and its zone map, into a store; objects are read once.

    A missing object raises FileNotFoundError, one of a wrong length, an unknown packing or a
    zone map for another layout ValueError; an array that was written without its zone map
    can't be queried (ValueError). One without a recorded source is trusted.
    """
    folder = folder.rstrip("/")
    document = _document(spark, f"{folder}/{array}")
    spec, path = spec_of(document), _attribute(document, "_meta")
    if not path:
        raise ValueError("the array has no zone map")
    source, packing, per_object = (_attribute(document, e) for e in ("_meta_source", "_meta_packing", "_meta_t_chunk"))
    if packing not in records.PACKINGS:
        raise ValueError(f"unknown packing of the zone map: {packing!r}")
    if source and (list(source["shape"]) != list(spec.shape) or list(source["chunks"]) != list(spec.chunk) or source["codec"] not in document["codecs"]):
        raise ValueError("the zone map was built for another layout")
    beside = f"{folder}/{path.strip('/')}"
    if per_object is None:
        per_object = _document(spark, beside)["chunk_grid"]["configuration"]["chunk_shape"][0]
    chunks = _objects(spark, f"{folder}/{array}", 3, _separator(document))
    zone_objects = _objects(spark, beside, 4, "/")
    for found, n in ((chunks, spec.n_chunks), (zone_objects, -(-spec.grid[0] * spec.units[0] // per_object))):
        if found.count() != n:
            raise FileNotFoundError(f"{n} objects make the array or its zone map; not all are there")
    zones = unpack(zone_objects, spec, packing, per_object)
    rows = _payload(chunks, spec).join(zones, ["chunk_id", "pos"]).withColumns({"block": F.col("chunk_id").cast("long") * spec.blocks_per_chunk + F.col("pos"), "valid": F.lit(None).cast("long")})
    rows = rows.withColumn("part", F.floor(F.col("block") / st.folder_blocks(spec)).cast("int"))
    rows = rows.select("part", "block", "chunk_id", "pos", "unit_id", "valid", "crc", *st.zone_columns(spec), *st.layer_columns(spec, None))
    to = to or f"{st.shared_folder(spark)}/array-{st.uuid.uuid4().hex}"
    st._write(rows.repartitionByRange("block").sortWithinPartitions("part", "block"), f"{to}/payload", **st.FILE_OPTIONS)
    spark.createDataFrame([(spec.to_json(),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{to}/array")
    st.write_zone_map(spark, spec, to)
    if not source:
        for name in ("source", "chunk_crc"):
            st.delete(spark, f"{to}/{name}")
    return st.Store(spark, to, spec)


def pack(store: st.Store, packing: str | None = None) -> DataFrame:
    """(c0, content): the zone map as objects of records; blocks that an array's padding leaves out have offsets of 0."""
    spec = store.spec
    if packing not in records.PACKINGS:
        raise ValueError(f"unknown packing of the zone map: {packing!r}")
    per, across = spec.object_units, prod(g * u for g, u in zip(spec.grid[1:], spec.units[1:], strict=True))
    along, layers, n = spec.grid[0] * spec.units[0], len(spec.rates), spec.blocks_per_unit
    names = st.zone_columns(spec)
    of_units = store.zone_map.groupBy("unit_id").agg(F.collect_list(F.struct("pos", *names)).alias("s"))
    of_objects = of_units.groupBy(F.floor(F.col("unit_id") / (per * across)).cast("int").alias("object")).agg(F.collect_list(F.struct("unit_id", "s")).alias("units"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                real = min(per, along - i * per) * across
                bounds = {k: np.zeros(real, np.float32 if k in ("cmin", "cmax") else np.float64) for k in names if k[0] in "ce" and k != "code"}
                offsets = {k: np.zeros((real, n), np.uint8) for k in names if k not in bounds}
                for u in units:
                    at = u["unit_id"] - i * per * across
                    for k, v in bounds.items():
                        v[at] = u["s"][0][k]
                    for r in u["s"]:
                        for k, v in offsets.items():
                            v[at, r["pos"] % n] = r[k]
                eps = np.stack([bounds[f"eps{k}"] for k in range(layers)], axis=1)
                rec = records.records(spec, bounds["cmin"], bounds["cmax"], eps, offsets["qmin"], offsets["qmax"], offsets.get("code"))
                raw = records.planes(spec, rec) if packing else rec.tobytes()
                raw += bytes(per * across * spec.record_bytes - len(raw))  # the last object is padded
                data = records.zstandard.ZstdCompressor(level=3).compress(raw) if packing else raw
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([data], pa.binary())], ["c0", "content"])

    return of_objects.mapInArrow(work, "c0 int, content binary")


def unpack(objects: DataFrame, spec: ArraySpec, packing: str | None = None, per_object: int | None = None) -> DataFrame:
    """(chunk_id, pos, unit_id, bounds, errors, offsets) of a zone map's objects (c0, content)."""
    per = [g * u for g, u in zip(spec.grid, spec.units, strict=True)]
    # A unit's place in its chunk from its place in the array.
    axes = [F.floor(F.col("unit_id") / (per[1] * per[2])), F.floor(F.col("unit_id") / per[2]) % per[1], F.col("unit_id") % per[2]]
    chunk = (F.floor(axes[0] / spec.units[0]) * spec.grid[1] + F.floor(axes[1] / spec.units[1])) * spec.grid[2] + F.floor(axes[2] / spec.units[2])
    sub = (axes[0] % spec.units[0] * spec.units[1] + axes[1] % spec.units[1]) * spec.units[2] + axes[2] % spec.units[2]
    found = _zones(objects, spec, per_object or spec.object_units, packing)
    return found.select("*", chunk.cast("int").alias("chunk_id"), (sub * spec.blocks_per_unit + F.col("rank")).cast("int").alias("pos")).drop("rank")


def objects(store: st.Store, array: str = "data", codec: str = "blocks", attributes: str = "zones", packing: str | None = None) -> DataFrame:
    """(key, content): all objects of a Zarr group that holds the store's array and zone map, a row each.

    codec and attributes: the codec's name and how attributes begin, which readers of the
    directory expect. packing: of the zone map's objects, None or planar-zstd.
    """
    spec, spark = store.spec, store.spark
    if spec.length:
        raise ValueError("a padded array can't be a Zarr array: it has no values for its last chunk")
    if packing not in records.PACKINGS:
        raise ValueError(f"unknown packing of the zone map: {packing!r}")
    layers = len(spec.rates)
    separate = lambda c, sizes: [F.floor(c / (sizes[1] * sizes[2])).cast("int"), (F.floor(c / sizes[2]) % sizes[1]).cast("int"), (c % sizes[2]).cast("int")]
    key = F.concat_ws("/", F.lit(f"{array}/c"), *separate(F.col("chunk_id"), spec.grid))
    of = store.payload.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", *st.layer_columns(spec, None)))).alias("s"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([b"".join(r[f"l{k}"] for k in range(layers) for r in rows)], pa.binary())], ["key", "content"])

    config = {"rate": spec.rate, "block_dim": 4, "layers": list(spec.rates), "block_order": list(spec.block_order), "sub_chunk": list(spec.sub_chunk)} | ({"block_error_bits": 4} if spec.block_error_bits else {})
    coded = {"name": codec, "configuration": config}
    common = {"zarr_format": 3, "node_type": "array", "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "storage_transformers": []}
    main = common | {"shape": list(spec.shape), "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(spec.chunk)}}, "fill_value": 0.0, "codecs": [coded]}
    main["attributes"] = {f"{attributes}_meta": f"{array}_meta", f"{attributes}_meta_t_chunk": spec.object_units, f"{attributes}_meta_packing": packing, f"{attributes}_meta_source": {"codec": coded, "shape": list(spec.shape), "chunks": list(spec.chunk), "chunk_crc32": []}}
    per, grid = spec.object_units, [g * u for g, u in zip(spec.grid, spec.units, strict=True)]
    zone = common | {"shape": [*grid, spec.record_bytes], "data_type": "uint8", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [per, *grid[1:], spec.record_bytes]}}, "fill_value": 0, "codecs": [{"name": "bytes"}] + ([{"name": "zstd", "configuration": {"level": 3, "checksum": False}}] if packing else []), "attributes": {}}
    zones = pack(store, packing).select(F.concat(F.lit(f"{array}_meta/c/"), F.col("c0").cast("string"), F.lit("/0/0/0")).alias("key"), "content")
    documents = [("zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {}}), (f"{array}/zarr.json", main), (f"{array}_meta/zarr.json", zone)]
    texts = spark.createDataFrame([(k, bytearray(json.dumps(v).encode())) for k, v in documents], "key string, content binary")
    return of.select(key.alias("key"), "s").mapInArrow(chunks, "key string, content binary").union(zones).union(texts)


def save(found: DataFrame, folder: str) -> int:
    """Write objects below a folder of any file system that Spark knows, one after another from the driver; returns how many."""
    spark, n = found.sparkSession, 0
    for row in found.toLocalIterator():
        path, files = st._path(spark, f"{folder}/{row.key}")
        out = files.create(path, True)
        out.write(bytes(row.content))
        out.close()
        n += 1
    return n
