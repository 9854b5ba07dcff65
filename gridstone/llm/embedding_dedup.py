"""Near-duplicate vectors: sorted projection passes find groups, in which every pair is compared exactly.

1. Equal vectors become one node. Signs of BITS random projections are its sketch.
2. Each pass permutes the sketch's bits, sorts all nodes by it and compares neighbours: a
   node with all of its own block of WINDOW rows and of the block before. Nodes whose
   sketches differ in few bits are joined; passes_for() gives the number of passes for
   which a lone pair at the threshold is missed in about MISS of cases.
3. What passes joined makes candidate groups. In each, all pairs are compared by products
   of blocks of bounded size, so links are exact however many neighbours a vector has.
4. Verified links make the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gridstone.llm.common import checkpoint, components, discard, settled

#: Random projections of a sketch.
BITS = 256
#: Rows of a block of neighbours.
WINDOW = 512
#: Share of lone pairs at the threshold that all passes may miss, for evenly spread vectors.
MISS = 1e-3
#: Share of near neighbours in a pass's order that the border of a task may part.
PARTED = 0.1
#: Rows of all passes that a sorting task gets at about the most.
TASK_ROWS = 1 << 16
#: Vectors, and bytes of them, that a block of a group holds on average at most; all pairs of a group's blocks meet.
BLOCK_ROWS, BLOCK_BYTES = 8192, 32 << 20
#: Rows of a block that are multiplied at once.
STRIP = 512


def differing(least: float) -> tuple[float, int]:
    """The chance that a bit of two sketches at this cosine differs, and in how many bits all but 1 of 30,000 such pairs differ at most."""
    p = acos(max(-1.0, min(1.0, least))) / pi
    return p, min(BITS, ceil(BITS * p + 4 * sqrt(BITS * p * (1 - p))))


def passes_for(n: int, least: float) -> int:
    """How many passes n vectors need: a pair meets in one if it agrees in the bits that tell WINDOW rows from the others."""
    p, _ = differing(least)
    depth = max(0.0, log2(max(n, 1) / WINDOW))
    met = (1 - PARTED) * (1 - p) ** depth
    return max(2, ceil(log(MISS) / log(1 - met)))


def _kind(vectors: DataFrame, column: str):
    """Single precision is kept as it is; anything else becomes double."""
    kind = vectors.schema[column].dataType
    return np.float32 if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else np.float64


def _nodes(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec, node, data) of each row: node names the vector's values, null if it links with nothing; data are its bytes."""
    kind = _kind(vectors, column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            flat = lists.flatten()
            known = ~flat.is_null().to_numpy(zero_copy_only=False)
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zeros
            bad = np.concatenate([[0], np.cumsum(~(known & np.isfinite(x)))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            ok = (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
            raw = [x[a:b].tobytes() if good else None for a, b, good in zip(ends[:-1], ends[1:], ok, strict=True)]
            names = [r and hashlib.md5(r).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(raw, pa.binary())], ["vec", "node", "data"])

    rows = vectors.select(F.col(id_column).cast("long").alias("vec"), F.col(column).cast(f"array<{'float' if kind is np.float32 else 'double'}>"))
    return rows.mapInArrow(work, "vec long, node binary, data binary")


def unit(rows: list[bytes], kind) -> np.ndarray:
    """Vectors of one dimension over their lengths, in double precision and without overflow."""
    x = np.frombuffer(b"".join(rows), kind).astype(np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give what pairs (u, v), ordered by u, connect the smallest of its labels."""
    if not len(u):
        return
    starts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
    for k, end in zip(starts.tolist(), [*starts[1:].tolist(), len(u)], strict=True):
        own, met = label[u[k]], label[v[k:end]]
        if (met != own).any():
            same = np.zeros(len(label), bool)
            same[met] = same[own] = True
            label[same[label]] = min(met.min(), own)


# ---------------------------------------------------------------- passes


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow array."""
    n, width = x.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def candidates(nodes: DataFrame, n: int, least: float, kind) -> DataFrame:
    """(a, b) from n different vectors (n, data): pairs that connect neighbours of any pass whose sketches differ in few bits.

    A task sorts its range of (dimension, pass, permuted sketch, n) and holds two blocks; a
    block gives a pair for each node that it joins to another, not one for each two of them.
    """
    passes, (_, most) = passes_for(n, least), differing(least)
    rng = np.random.default_rng(20240611)
    orders = [rng.permutation(BITS) for _ in range(passes)]
    planes: dict[int, np.ndarray] = {}

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(d) for d in data], np.int64)
            for size in np.unique(sizes).tolist():
                rows, dim = np.flatnonzero(sizes == size), size // np.dtype(kind).itemsize
                if dim not in planes:
                    planes[dim] = np.random.default_rng((7, dim)).standard_normal((dim, BITS)).astype(np.float32)
                bits = unit([data[k] for k in rows], kind).astype(np.float32) @ planes[dim] > 0
                for k, order in enumerate(orders):
                    place = pa.array(np.full(len(rows), dim * (1 << 16) + k, np.int64))
                    yield pa.RecordBatch.from_arrays([place, _binary(np.packbits(bits[:, order], axis=1)), pa.array(names[rows])], ["place", "sketch", "n"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[np.ndarray] = []
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        place = None

        def joined(names: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
            own = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
            all_names, x = (names, own) if not before else (np.concatenate([before[0], names]), np.concatenate([before[1], own]))
            first = len(all_names) - len(names)
            u, v = np.nonzero(own @ x.T >= BITS - 2 * most)
            label = np.arange(len(all_names))
            _unite(label, u + first, v)
            before[:] = [names, own]
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(all_names[moved]), pa.array(all_names[label[moved]])], ["a", "b"])

        def taken(whole: bool) -> Iterator[pa.RecordBatch]:
            names, packed = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            at = 0
            while len(names) - at >= WINDOW or (whole and at < len(names)):
                yield joined(names[at : at + WINDOW], packed[at : at + WINDOW])
                at += WINDOW
            waiting[:] = [(names[at:], packed[at:])] if at < len(names) else []

        for batch in batches:
            places, names = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(names), -1)
            cuts = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if places[a] != place:
                    if waiting:
                        yield from taken(True)
                    before.clear()
                    place = places[a]
                waiting.append((names[a:b], packed[a:b]))
                if sum(len(w[0]) for w in waiting) >= WINDOW:
                    yield from taken(False)
        if waiting:
            yield from taken(True)

    sketched = nodes.select("n", "data").mapInArrow(sketch, "place long, sketch binary, n long")
    ordered = sketched.repartitionByRange(1 + passes * n // TASK_ROWS, "place", "sketch", "n").sortWithinPartitions("place", "sketch", "n")
    return ordered.mapInArrow(neighbours, "a long, b long")


# ---------------------------------------------------------------- exact links of the groups


def _linked(rows: list[tuple], least: float, kind) -> list[tuple[int, int, int]]:
    """(node, root, others) of the vectors with links, from rows (side, n, copies, data) of one block or of two sides.

    others: the copies of all vectors linked within the pair of blocks; root: a node that
    stands for those that links connect here. Products in single precision decide only
    where their largest possible error cannot; the rest is decided in double precision.
    """
    rows = sorted(rows, key=lambda r: r[0])
    n, cut = len(rows), sum(r[0] == rows[0][0] for r in rows)
    one = cut == n
    x = unit([r[3] for r in rows], kind)
    single, margin = x.astype(np.float32), x.shape[1] * 1.2e-7 + 1e-6
    copies = np.array([r[2] for r in rows], np.float64)
    first = 0 if one else cut
    others, label = np.zeros(n), np.arange(n)
    for at in range(0, cut, STRIP):
        to = min(at + STRIP, cut)
        cosine = single[at:to] @ single[first:].T
        u, v = np.nonzero(cosine >= least - margin)
        near = cosine[u, v] < least + margin
        u, v = u + at, v + first
        ok = u != v
        doubt = np.flatnonzero(near & ok)
        for k in range(0, len(doubt), 100_000):
            some = doubt[k : k + 100_000]
            ok[some] = np.einsum("ij,ij->i", x[u[some]], x[v[some]]) >= least
        u, v = u[ok], v[ok]
        if not len(u):
            continue
        others += np.bincount(u, copies[v], n)
        if not one:
            others += np.bincount(v, copies[u], n)
        _unite(label, u, v)
    return [(rows[k][1], rows[label[k]][1], int(others[k])) for k in np.flatnonzero(others)]


#: Members of groups that are broadcast at most, so that the vectors of no group aren't shuffled.
MOST_MEMBERS = 200_000


def links(groups: DataFrame, n_members: int, nodes: DataFrame, least: float, kind) -> DataFrame:
    """(a, b, others) from groups (n, label) of vectors (n, copies, data): every pair of a group is compared, in one pair of blocks.

    others: the copies of the vectors that a links with there, to be summed over rows; the
    pairs (a, b) connect the vectors that links connect. A row for each vector and pair of
    blocks in which it has a link, so that rows follow the blocks, not a group's pairs.
    """
    width = np.dtype(kind).itemsize
    narrow = groups.join(nodes.select("n", (F.octet_length("data") / width).cast("int").alias("dim")), "n")
    counts = narrow.groupBy("label").agg(F.count("*").alias("size"), F.max("dim").alias("dim"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("size") * F.col("dim") * width / BLOCK_BYTES)).cast("int")
    sized = groups.join(counts.select("label", blocks.alias("blocks")), "label")
    sized = sized.withColumn("side", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("n", "label", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    vectors = nodes.select("n", "copies", "data")
    dealt = vectors.join(F.broadcast(dealt), "n") if n_members <= MOST_MEMBERS else vectors.join(dealt, "n")
    rows = dealt.select("label", "i", "j", "side", "n", "copies", "data")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], None

        def batch_of() -> pa.RecordBatch:
            # Of two blocks, one can be empty: its own pairs are compared in the group of it alone.
            out = _linked(rows, least, kind) if at[1] == at[2] or len({r[0] for r in rows}) == 2 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["a", "b", "others"])

        for batch in batches:
            for label, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, i, j) != at:
                    if rows:
                        yield batch_of()
                    rows, at = [], (label, i, j)
                rows.append(tuple(row))
        if rows:
            yield batch_of()

    return rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(compare, "a long, b long, others long")


def dedup(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row for each of vectors: id, n_links, component_id, kept.

    Two rows link if they hold equal values or their cosine in double precision is at least
    least; no pair below it links. n_links counts other rows linked directly; component_id
    is the smallest id reachable; kept: the id is component_id. Pairs that passes bring
    together are all compared, so large groups lose nothing; a lone pair is missed in about
    MISS of cases. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, not even equal ones, and are their own component; vectors of
    different dimensions don't link. Null ids: passed over for component_id, null if a
    component has no other. Repeated rows are copies like any others. Empty table: no rows.
    Extra columns, whatever their names, are left out.
    """
    kind = _kind(vectors, column)
    rows = _nodes(vectors, id_column, column)
    valid = rows.where("node is not null").groupBy("node").agg(F.min("vec").alias("vec"), F.count("*").alias("copies"), F.first("data").alias("data"))
    nodes, n = settled(valid.withColumn("n", F.monotonically_increasing_id()), wide=True)
    near, _ = settled(candidates(nodes, n, least, kind).distinct())
    groups, n_members = settled(components(near).select(F.col("node").alias("n"), F.col("component").alias("label")))
    found, _ = settled(links(groups, n_members, nodes, least, kind))
    degree = found.groupBy("a").agg(F.sum("others").alias("others")).withColumnRenamed("a", "n")
    label = components(found.select("a", "b")).withColumnRenamed("node", "n")
    known = nodes.select("n", "node", "vec", "copies").join(degree, "n", "left").join(label, "n", "left").withColumn("label", F.coalesce("component", "n"))
    smallest = known.groupBy("label").agg(F.min("vec").alias("component_id"))
    answer = checkpoint(known.join(smallest, "label").select("node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    discard(nodes, near, groups, found)
    out = rows.select("vec", "node").join(answer, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec")).otherwise(F.col("component_id"))
    return out.select(F.col("vec").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec").eqNullSafe(component).alias("kept"))
