"""What several operators share: reading tables, cutting lineage, word hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names; a private one only if all run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridstone-checkpoint-"))
    return sc.getCheckpointDir()


def mark_for(*tables: DataFrame) -> str:
    """The beginning of names for columns of one's own: no column of the tables has it, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    mark = "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return mark


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of these names, in any case, under names of no other column, and what they were: {new: old}."""
    mark, taken = mark_for(df), {n.lower() for n in names}
    back = {f"{mark}{k}": c for k, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed({old: new for new, old in back.items()}), back


def restored(df: DataFrame, columns: list[str], back: dict[str, str]) -> DataFrame:
    """The columns of a table before aside(), in their order."""
    new = {old: name for name, old in back.items()}
    return df.select(*[named(new.get(c, c)).alias(c) for c in columns])


def named(column: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator remembers in a worker from task to task; what other operators left there goes, so that memory is that of one."""
    for other in [o for o in _kept if o != owner]:
        del _kept[other]
    return _kept.setdefault(owner, {})


def digest(text: Column) -> Column:
    """16 bytes that stand for a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


# ---------------------------------------------------------------- word hashes

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, size=256, dtype=np.uint64) | U64(1)
_BASE, _PIECE = 0x9E3779B97F4A7C15, 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        steps = np.full(max(n, _PIECE), base, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of concatenated texts, and how many words each text has.

    data: the UTF-8 bytes; ends: where each text ends. A word is a run of bytes other than
    ASCII white space, so that it is one of ``[^\\x20\\x09-\\x0D]+``. Works through the
    bytes by pieces cut between words: memory follows the piece, not the text.
    """
    n = len(data)
    cuts = np.zeros(n + 1, dtype=bool)  # a text begins here
    cuts[ends[ends < n]] = True
    hashes, starts, at = [], [], 0
    while at < n:
        to = min(n, at + _PIECE)
        while to < n and not (cuts[to] or _WHITE[data[to]]):
            ahead = data[to : to + _PIECE]
            stop = np.flatnonzero(_WHITE[ahead] | cuts[to : to + len(ahead)])
            to = to + int(stop[0]) if len(stop) else to + len(ahead)
        part = data[at:to]
        black = ~_WHITE[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[:-1] = cuts[at:to]
        first = black.copy()
        first[1:] &= ~black[:-1] | edge[1:-1]
        last = black.copy()
        last[:-1] &= ~black[1:] | edge[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * _power("up", len(part)), out=total[1:])
        hashes.append(mix((total[e] - total[s]) * _power("down", len(part))[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = to
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first_of = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(first_of, np.concatenate([[0], ends])))
    return words, counts


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of so many words; of all words if there are fewer; none of no words."""
    n = len(words)
    width = min(width, n)
    if not n:
        return words
    out = words[: n - width + 1].copy()
    for k in range(1, width):
        out = mix(out * U64(0xD6E8FEB86659FD93) + words[k : n - width + 1 + k])
    return mix(out + U64(width))


def texts_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array, where each text begins in them and where it ends (null: empty)."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), at[:-1], at[1:]


def text_groups(column, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first to last of an Arrow string array with their bytes and ends, by groups of about so many bytes."""
    data, begin, end = texts_of(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + most, side="right")))
        yield at, to, data[begin[at] : end[to - 1]], end[at:to] - begin[at]
        at = to


# ---------------------------------------------------------------- connected components

#: Rows of a checkpointed table that one task is worth.
TASK_ROWS = 100_000


def parts_for(n: int) -> int:
    return 1 + n // TASK_ROWS


def settled(df: DataFrame, wide: bool = False) -> tuple[DataFrame, int]:
    """A written table in the shared folder, and the number of its rows; narrow rows are read by as many tasks as they are worth.

    Unlike a checkpoint it is computed once and keeps no constraints of its plan, which
    would double with every turn of a loop. discard() takes it away.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    n = out.count()
    out = out if wide else out.coalesce(parts_for(n))
    _folders[id(out)] = (weakref.ref(out), folder)
    return out, n


_folders: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing to come reads: what was made of them has been written."""
    for t in tables:
        known, folder = _folders.pop(id(t), (lambda: None, None))
        if known() is t:
            delete(t.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _united(edges: DataFrame) -> DataFrame:
    """components() of links (u, v) that are worth one task: a union-find inside it, TASK_ROWS links at most."""
    kind = edges.schema["u"].dataType
    arrow = to_arrow_type(kind)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = find(root.setdefault(u, u)), find(root.setdefault(v, v))
                root[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(root), arrow), pa.array([find(x) for x in root], arrow)], ["node", "component"])

    return checkpoint(edges.select("u", "v").coalesce(1).mapInArrow(unite, f"node {kind.simpleString()}, component {kind.simpleString()}"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that links (a, b) reach; only nodes with links appear.

    Links that one task is worth (TASK_ROWS at most) are united in it. More of them
    alternate large-star and small-star until they stand still; every step is a
    pre-aggregated minimum and a join, and its result is checkpointed, so a hub's links
    are never gathered in one task and a lost executor repeats one step only.
    """
    edges, n = settled(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if n <= TASK_ROWS:
        return _united(edges)
    parts, seen = parts_for(n), None
    while True:
        # Large star: every neighbour larger than u moves to the smallest node around u.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours move to the smallest of them.
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.union(least.select("u", F.col("m").alias("v")))
        edges = checkpoint(stars.distinct().coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
