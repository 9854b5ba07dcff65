"""Token counts through a cache keyed by digests of normalised content and tokenizer version."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm.common import discard, kept, mark_for, named, settled, shared_folder

#: Chunks between white space whose counts a worker remembers at most; then it starts anew.
MOST_CHUNKS = 1_200_000


def collapse_white(text: Column) -> Column:
    """ASCII white space runs become one space: for tokenizers that drop white space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def version_of(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class ChunkCounter:
    """Counts tokens as the library does, by the chunks between ASCII white space.

    The tokenizer drops white space and never joins over it, so a text's count is the sum
    over its chunks. Texts with other white space or separators, or with what may be a
    special token, go to the library whole.
    """

    _odd = re.compile("[\x1c-\x1f\x85\xa0  -‏ -  　]|<[|]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        if self._odd.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        chunks = text.split()
        try:
            return sum(map(self.known.__getitem__, chunks))
        except KeyError:
            if len(self.known) > MOST_CHUNKS:
                self.known.clear()
            new = list({c for c in chunks if c not in self.known})
            self.known.update(zip(new, (len(x.ids) for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            return sum(map(self.known.__getitem__, chunks))


def counter(path: str) -> ChunkCounter:
    """One counter for each tokenizer in a worker."""
    mine = kept("token counts")
    if path not in mine:
        mine[path] = ChunkCounter(path)
    return mine[path]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(content, n_tokens) stored for a tokenizer version; None if nothing was ever stored."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    stored = spark.read.schema("content binary, version string, n_tokens long").parquet(cache)
    return stored.where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


#: Digests to pick rows by that are broadcast at most; more are joined by shuffles.
MOST_LISTED = 500_000


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", normalise=collapse_white) -> DataFrame:
    """docs with n_tokens: what the library counts without added special tokens.

    cache: a folder that all executors share. Each different content that it lacks for this
    tokenizer is encoded once and appended: a content that only one row has where that row
    is read, the others after a shuffle that keeps one text of each. Then all rows get their
    counts by a join on the content's digest. normalise must not change counts. A null text
    counts as empty (0). Repeated rows get equal counts. Empty table: no rows. A column
    n_tokens of docs is replaced, any other kept, whatever its name.
    """
    spark, mark = docs.sparkSession, mark_for(docs)
    version, key = version_of(tokenizer), f"{mark}content"
    whole = normalise(named(text))
    todo = docs.select(whole.alias("text")).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("content"), "text")
    stored = read_cache(spark, cache, version)
    counted = todo.groupBy("content").agg(F.count("*").alias("n"))
    if stored is None:
        listed, n = settled(counted.where("n > 1").select("content"))
        once = todo.join(F.broadcast(listed) if n <= MOST_LISTED else listed, "content", "left_anti")
        shared = listed
    else:  # only digests meet what is stored; then the rows of what it lacks are picked
        listed, n = settled(counted.join(stored.select("content"), "content", "left_anti"))
        some = lambda where: listed.where(where).select("content")
        once = todo.join(F.broadcast(some("n = 1")) if n <= MOST_LISTED else some("n = 1"), "content", "left_semi")
        shared = some("n > 1")
    many = todo.join(F.broadcast(shared) if n <= MOST_LISTED else shared, "content", "left_semi")
    many = many.groupBy("content").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            counts = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    fresh = once.select("content", "text").union(many).mapInArrow(encode, "content binary, n_tokens long")
    fresh.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    discard(listed)
    known = read_cache(spark, cache, version).withColumnRenamed("content", key)
    rows = docs.drop("n_tokens").withColumn(key, F.unhex(F.md5(whole.cast("binary"))))
    return rows.join(known, key).drop(key)


def own_cache(spark: SparkSession) -> str:
    """A new folder for a cache under the cluster's shared folder."""
    return f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
