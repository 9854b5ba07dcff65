"""WARC archives in Zstandard: a dictionary in a leading skippable frame, one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import discard, settled

#: Of the .warc.zst format: the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of a dictionary, and of the records (a partition's first ones) that it is built from at most.
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 2 << 20
#: An archive closes after so many compressed bytes.
ARCHIVE_BYTES = 1 << 20
#: Repeated payloads whose digests are broadcast at most; with more of them payloads are joined by shuffles.
MOST_REPEATED = 500_000
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: int | None, place: str = "") -> str:
    """The same for the same page wherever and however often it is written; a page without id is named by its place."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{name}" if name is not None else f"nameless:{place}"))


def record(name: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """A response record, or a revisit record, which has the HTTP header only."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id(name, place)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if name is not None:
        head.append(f"X-Page-ID: {name}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> zstd.ZstdCompressionDict:
    """Built from records; from their beginnings alone if there are too few to learn from."""
    if len(records) >= 16:
        try:
            return zstd.train_dictionary(DICTIONARY_BYTES, [r[: 64 << 10] for r in records], level=3)
        except zstd.ZstdError:
            pass
    raw = b"".join(r[:2048] for r in records)[:DICTIONARY_BYTES]
    return zstd.ZstdCompressionDict(raw.ljust(8, b"\0"), dict_type=zstd.DICT_TYPE_RAWCONTENT)


def leading_frame(dictionary: zstd.ZstdCompressionDict) -> bytes:
    data = dictionary.as_bytes()
    return struct.pack("<II", DICTIONARY_FRAME, len(data)) + data


def read_records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame, by the dictionary of its leading frame."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(archive[8 : 8 + size]))
    rest = archive[8 + size :]
    while rest:
        one = reader.decompressobj()
        yield one.decompress(rest)
        rest = one.unused_data


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:n]


def write(pages: DataFrame, folder: str, least_bytes: int = 0, id_column: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Archives of pages as a Parquet table (archive, content) in a folder of any file system that Spark writes.

    A row is a whole archive: content saved as a file is a valid .warc.zst. The table is
    committed by Spark, so a lost executor leaves no half archive; archives are named by
    partition and number. Of rows with equal payloads of at least least_bytes bytes, that
    with the largest id is the response and the others revisit it (rows that repeat this id
    too are responses); smaller ones are all responses. Null payload or url: empty. A null
    id is smaller than all; rows without any id revisit nothing. Empty table: no archive.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("name"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("node", F.unhex(F.sha1("payload")))
    counted = rows.where(F.octet_length("payload") >= least_bytes).groupBy("node").agg(F.max("name").alias("keeper"), F.count("*").alias("n"))
    repeated, n = settled(counted.where("n > 1 and keeper is not null").select("node", "keeper"))
    # Only payloads that several rows have need a partner: few enough are broadcast, so that no payload is shuffled.
    both = rows.join(F.broadcast(repeated) if n <= MOST_REPEATED else repeated, "node", "left")
    ready = both.select("name", "url", "payload", F.when(~F.col("name").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting: list[bytes] = []
        state = {"dictionary": None, "press": None, "n": 0, "records": 0}
        body = bytearray()

        def closed() -> pa.RecordBatch:
            name = f"part-{part:05d}-{state['n']:05d}.warc.zst"
            content = leading_frame(state["dictionary"]) + bytes(body)
            state["n"] += 1
            body.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

        def learn() -> None:
            state["dictionary"] = dictionary_of(waiting)
            state["press"] = zstd.ZstdCompressor(level=3, dict_data=state["dictionary"], write_checksum=True)

        def press(data: bytes) -> Iterator[pa.RecordBatch]:
            body.extend(state["press"].compress(data))
            if len(body) >= ARCHIVE_BYTES:
                yield closed()

        size = 0
        for batch in batches:
            for name, target, payload, refers_to in zip(*batch.columns, strict=True):
                state["records"] += 1
                data = record(name.as_py(), target.as_py(), payload.as_py(), refers_to.as_py(), refers_to.is_valid, f"{part}-{state['records']}")
                if state["press"] is None:
                    waiting.append(data)
                    size += len(data)
                    if size < SAMPLE_BYTES:
                        continue
                    learn()
                    for w in waiting:
                        yield from press(w)
                    waiting.clear()
                else:
                    yield from press(data)
        if waiting:
            learn()
            for w in waiting:
                yield from press(w)
        if body:
            yield closed()

    ready.mapInArrow(archive, "archive string, content binary").write.option("compression", "uncompressed").parquet(folder)
    discard(repeated)


def read(spark, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of all archives of a folder.

    The digest of a response is computed from its payload and must equal its header's; a
    revisit's digest and length are its headers'.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                out = []
                for data in read_records(content.as_py()):
                    fields, block = parse(data)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n = int(head.decode().split("Content-Length: ")[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    if kind == "response" and (len(payload) != n or payload_digest(payload) != digest):
                        raise ValueError(f"a payload doesn't match its header: {fields['warc-record-id']}")
                    name, other = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    out.append((name and int(name), fields["warc-target-uri"], kind, n, digest, other and int(other), payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)), schema.types, strict=True)], schema=schema)

    stored = spark.read.schema("archive string, content binary").parquet(folder).select("content")
    return stored.mapInArrow(records, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def export(spark, folder: str, to: str, by_tasks: bool = False) -> list[str]:
    """Save the archives as files below a folder and return their names.

    By default one after another through the driver, to a folder of its own. by_tasks: each
    task writes its archives itself; the folder must be mounted on all executors under the
    same path. A file appears whole or not at all, and a task that runs again replaces it.
    """
    import os
    from pathlib import Path

    def save(name: str, content: bytes) -> str:
        part = Path(to) / f".{name}.{uuid.uuid4().hex}"
        part.write_bytes(content)
        os.replace(part, Path(to) / name)
        return name

    stored = spark.read.schema("archive string, content binary").parquet(folder)
    if not by_tasks:
        return [save(row.archive, row.content) for row in stored.toLocalIterator()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([save(name.as_py(), content.as_py())])], ["archive"])

    return sorted(r.archive for r in stored.mapInArrow(work, "archive string").collect())  # a name for each file
