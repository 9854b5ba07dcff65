"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all shingles go into a sketch of fixed size: one counter for
   each of BUCKETS hash values. Counters grow with the corpus, but a shingle's share of
   documents, which the weight is made of, is off by about (shingles of a text / BUCKETS)
   at any size.
2. Each different text is sampled BANDS * ROWS times (Ioffe 2010); a band's samples make
   a key, and texts that share a key are candidates.
3. Candidates are compared with one text of their key, the most central one, which brings
   together most of a large group. All other pairs of a key whose texts are still apart
   and whose samples agree in least_agreement() or more are then compared, by blocks of
   bounded size; only pairs that links found in the same block connect are passed over.
   Weighted Jaccard similarity of whole shingle sets decides.
4. Links make groups by connected components; equal texts are one node from the start.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.llm.common import checkpoint, components, digest, discard, kept, mark_for, mix, named, settled, shingles, text_groups, word_hashes

U64 = np.uint64
BUCKETS = 1 << 18
SEGMENTS, FAN = 16, 64
#: Chance that two texts of similarity 0.8 share no key: (1 - 0.8 ** ROWS) ** BANDS = 0.0008.
BANDS, ROWS = 10, 3
SLOTS_LOG2 = 14
#: Texts, and bytes of them, that a block of a key's members holds on average at most; all pairs of blocks meet.
BLOCK_TEXTS, BLOCK_BYTES = 512, 4 << 20
#: A shingle in at most this share of the documents has the full weight.
RARE_SHARE = 2e-2
#: The weight that a shingle of every document would come down to, next to 1 for a rare one.
LEAST_IDF = 0.75


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - 18)).astype(np.int64)


def weighted(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of a text, ascending, and their weights: count times idf."""
    h, count = np.unique(shingles(words), return_counts=True)
    return h, count * idf[bucket_of(h)]


def idf_of(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """Weights by bucket, from LEAST_IDF (in every document) to 1 (in RARE_SHARE of them or fewer)."""
    share = np.maximum(counts / max(n_docs, 1), RARE_SHARE)
    damped = np.log1p(1 / share) / np.log1p(1 / RARE_SHARE)
    return (LEAST_IDF + (1 - LEAST_IDF) * damped).astype(np.float64)


class Sampler:
    """Improved consistent weighted sampling; a sample's random numbers follow from its shingle's hash alone."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1, 2**63, size=samples, dtype=np.uint64) * U64(2) + U64(1)
        size = (samples, 1 << SLOTS_LOG2)
        r = rng.gamma(2, 1, size).astype(np.float32)
        self.r, self.inv_r = r, 1 / r
        self.ln_c_less_r = (np.log(rng.gamma(2, 1, size)) - r).astype(np.float32)
        self.beta = rng.random(size, dtype=np.float32)

    def __call__(self, h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """64-bit values, a row for each text; starts: where the texts' shingles begin in h and w, none empty."""
        out = np.empty((len(starts), len(self.odd)), np.uint64)
        ln_w, sizes = np.log(w).astype(np.float32), np.diff(np.append(starts, len(h)))
        for i in range(len(self.odd)):
            p = h * self.odd[i]
            slot = (p >> U64(64 - SLOTS_LOG2)).view(np.int64)
            r, beta = self.r[i].take(slot), self.beta[i].take(slot)
            t = np.floor(ln_w * self.inv_r[i].take(slot) + beta)
            a = self.ln_c_less_r[i].take(slot) - r * (t - beta)
            tied = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
            if len(tied) > len(starts):  # equal slots: the smaller product
                text = np.searchsorted(starts, tied, side="right")
                tied = tied[np.lexsort((p[tied], text))]
                text = np.searchsorted(starts, tied, side="right")
                tied = tied[np.append(True, text[1:] != text[:-1])]
            out[:, i] = mix(p[tied] + mix(t[tied].astype(np.int64).view(np.uint64)))
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """Keys of the bands of each text, as int64."""
    x = samples.reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15), x.shape[:2])
    for j in range(ROWS):
        key = mix(key * U64(0xD6E8FEB86659FD93) + x[:, :, j])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: shared shingles count with their smaller weight, all with their larger one."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


# ---------------------------------------------------------------- stages


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Counters by bucket over all texts (a column text), and how many texts have a shingle.

    Each input partition sends its counters once, by segments, compressed. They are added up
    in two steps: FAN tasks for a segment each take a share of the partitions, then one adds
    up FAN sums. The driver gets BUCKETS numbers.
    """
    width = BUCKETS // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("minhash")
        counts, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for at, to, data, ends in text_groups(batch.column(0)):
                words, sizes = word_hashes(data, ends)
                n += int((sizes > 0).sum())
                for w in np.split(words, np.cumsum(sizes)[:-1]):
                    if len(w):
                        counts[np.unique(bucket_of(shingles(w)))] += 1
        parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(SEGMENTS, width)] if n else []
        yield pa.RecordBatch.from_pydict({"segment": pa.array(range(len(parts)), pa.int32()), "n": pa.array([n] * len(parts), pa.int64()), "counts": pa.array(parts, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for segment, n, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = total.setdefault(segment, [0, np.zeros(width, np.int64)])
                seen[0] += n
                seen[1] += np.frombuffer(zlib.decompress(counts), np.int64)
        yield pa.RecordBatch.from_pydict({"segment": pa.array(list(total), pa.int32()), "n": pa.array([x[0] for x in total.values()], pa.int64()), "counts": pa.array([zlib.compress(x[1].tobytes(), 1) for x in total.values()], pa.binary())})

    schema = "segment int, n long, counts binary"
    sent = texts.select("text").mapInArrow(count, schema).withColumn("share", F.spark_partition_id() % FAN)
    shares = sent.repartition("segment", "share").drop("share").mapInArrow(add, schema)
    counts, n_docs = np.zeros(BUCKETS, np.int64), 0
    for r in shares.repartition(SEGMENTS, "segment").mapInArrow(add, schema).collect():
        counts[r.segment * width : (r.segment + 1) * width] = np.frombuffer(zlib.decompress(r.counts), np.int64)
        n_docs = r.n
    return counts, n_docs


def keys_of(nodes: DataFrame, idf, common) -> DataFrame:
    """(key, node, marks, central) for each different text with a word, from rows (node, text); a text met again in a partition is skipped.

    marks: a byte of each sample; the share that agrees estimates the similarity of two texts.
    central: the mean of its shingles' log counts; of a large group of copies with changes,
    the texts with the fewest changes have the largest.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = kept("minhash")
        sampler = mine["sampler"] = mine.get("sampler") or Sampler()
        weights, logs, done = idf.value, common.value, set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, to, data, ends in text_groups(batch.column(1), 512 << 10):
                fresh = []
                for i in range(at, to):
                    fresh.append(names[i] not in done)
                    done.add(names[i])
                words, sizes = word_hashes(data, ends)
                parts, out, central = [], [], []
                for new, name, w in zip(fresh, names[at:to], np.split(words, np.cumsum(sizes)[:-1]), strict=True):
                    if new and len(w):
                        parts.append(weighted(w, weights))
                        out += [name] * BANDS
                        central += [float(logs[bucket_of(parts[-1][0])].mean())] * BANDS
                if parts:
                    starts = np.cumsum([0, *(len(x[0]) for x in parts[:-1])])
                    samples = sampler(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), starts)
                    marks = [m for x in (samples >> U64(56)).astype(np.uint8) for m in [x.tobytes()] * BANDS]
                    yield pa.RecordBatch.from_arrays([pa.array(band_keys(samples).ravel(), pa.int64()), pa.array(out, pa.binary()), pa.array(marks, pa.binary()), pa.array(central, pa.float32())], ["key", "node", "marks", "central"])
            if len(done) > 1_000_000:
                done.clear()

    return nodes.select("node", "text").mapInArrow(sign, "key long, node binary, marks binary, central float")


#: Names of texts, and pairs of them, that are broadcast at most, so that other texts aren't shuffled; more meet all texts by joins.
MOST_WANTED, MOST_NAMED = 500_000, 100_000


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[zip]:
    """Rows of batches as tuples, a few at a time, so that texts aren't held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)


def verified(pairs: DataFrame, n_pairs: int, nodes: DataFrame, idf, least: float) -> DataFrame:
    """Of pairs (a, b) those whose texts are similar enough. Texts of hot nodes meet their pairs by joins that AQE can split."""
    if n_pairs <= MOST_NAMED:
        named = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        nodes = nodes.join(F.broadcast(named), "node", "left_semi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, recent = idf.value, OrderedDict()

        def parsed(node: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
            if node not in recent:
                data = np.frombuffer(text, np.uint8)
                recent[node] = weighted(word_hashes(data, np.array([len(data)]))[0], weights)
                if len(recent) > 200:
                    recent.popitem(last=False)
            recent.move_to_end(node)
            return recent[node]

        for rows in _slices(batches):
            out = [(a, b) for a, b, s, t in rows if similarity(parsed(b, t), parsed(a, s)) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])

    text = nodes.select("node", F.col("text").cast("binary").alias("text")).hint("merge")
    one = pairs.join(text.withColumnsRenamed({"node": "a", "text": "s"}), "a")
    both = one.join(text.withColumnsRenamed({"node": "b", "text": "t"}), "b").select("a", "b", "s", "t")
    return both.mapInArrow(compare, "a binary, b binary")


def _pair(x: str, y: str):
    """p: the two nodes as (a, b), a > b."""
    return F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).alias("p")


def least_agreement(least: float) -> int:
    """Samples that agree in all but about 1 of 10,000 pairs of this similarity."""
    n = BANDS * ROWS
    return max(1, int(n * least - 4 * (n * least * (1 - least)) ** 0.5))


def _links_in(block: list[tuple], weights: np.ndarray, least: float) -> list[tuple[bytes, bytes]]:
    """Links (a, b), a > b, of a pair of blocks: rows (i, j, side, node, label, marks, lower, text); if i < j, only rows of different sides meet.

    lower: the text's smaller keys; a pair that shares one of them is compared there. Links
    and labels connect the same texts as the links of all pairs would.
    """
    n, floor = len(block), least_agreement(least)
    across = block[0][0] != block[0][1]
    side = np.array([r[2] for r in block])
    marks = np.frombuffer(b"".join(r[5] for r in block), np.uint8).reshape(n, -1)
    number = {x: k for k, x in enumerate(dict.fromkeys(r[4] for r in block))}
    label = np.array([number[r[4]] for r in block])  # of the label itself, then of what links unite
    lower = np.zeros((n, BANDS), np.int64)
    for k, r in enumerate(block):
        lower[k, : len(r[6])] = r[6]
    begun = []
    for k in range(n - 1):
        ok = ((marks[k + 1 :] == marks[k]).sum(axis=1) >= floor) & (label[k + 1 :] != label[k])
        if across:
            ok &= side[k + 1 :] != side[k]
        to = np.flatnonzero(ok) + k + 1
        if len(to) and block[k][6]:
            to = to[~(lower[to][:, :, None] == np.array(block[k][6], np.int64)).any(axis=(1, 2))]
        if len(to):
            begun.append((k, to))
    if not begun:
        return []
    used = np.unique(np.concatenate([np.append(to, k) for k, to in begun]))
    sets = {}
    for k in used.tolist():
        data = np.frombuffer(block[k][7], np.uint8)
        sets[k] = weighted(word_hashes(data, np.array([len(data)]))[0], weights)
    total = {k: x[1].sum() for k, x in sets.items()}
    names, places = np.unique(np.concatenate([x[0] for x in sets.values()]), return_inverse=True)
    place = dict(zip(sets, np.split(places, np.cumsum([len(x[0]) for x in sets.values()])[:-1]), strict=True))
    dense, out = np.zeros(len(names)), []
    for k, to in begun:
        to = to[label[to] != label[k]]
        if not len(to):
            continue
        dense[place[k]] = sets[k][1]
        sizes = [len(place[t]) for t in to.tolist()]
        shared = np.minimum(dense[np.concatenate([place[t] for t in to.tolist()])], np.concatenate([sets[t][1] for t in to.tolist()]))
        dense[place[k]] = 0
        low = np.add.reduceat(shared, np.cumsum([0, *sizes[:-1]]))
        ratio = low / (np.array([total[t] for t in to.tolist()]) + total[k] - low)
        for t, x in zip(to.tolist(), ratio.tolist(), strict=True):
            if x >= least + 1e-9 or x > least - 1e-9 and similarity(sets[k], sets[t]) >= least:
                out.append((max(block[k][3], block[t][3]), min(block[k][3], block[t][3])))
                label[label == label[t]] = label[k]
    return out


def remaining(members: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """Links (a, b) between texts of different labels that share a key and whose samples agree enough, from rows (key, node, marks, center, label).

    Pairs with a key's center have been compared. A key's other members are dealt to blocks
    by hashes of their names, and each pair of blocks is a group of rows: a task holds the
    texts of two blocks, whatever the key's size.
    """
    rest = members.where("node != center").join(texts.select("node", F.octet_length("text").alias("size")), "node")
    apart = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("low != high")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    met = rest.select("key", "node", "marks", "label").join(apart.select("key", blocks.alias("blocks")), "key")
    keys = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    side = F.pmod(F.xxhash64("key", "node"), F.col("blocks")).cast("int")
    dealt = met.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "label", "marks")
    dealt = dealt.join(keys, "node").join(texts.select("node", F.col("text").cast("binary").alias("text")), "node")
    rows = dealt.select("key", "i", "j", "side", "node", "label", "marks", F.filter("keys", lambda k: k < F.col("key")).alias("lower"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, block, at = idf.value, [], None

        def batch_of(links: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], ["a", "b"])

        for rows in _slices(batches):
            for key, *row in rows:
                if (key, row[0], row[1]) != at:
                    if block:
                        yield batch_of(_links_in(block, weights, least))
                    block, at = [], (key, row[0], row[1])
                block.append(tuple(row))
        if block:
            yield batch_of(_links_in(block, weights, least))

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a binary, b binary").distinct()


def groups(docs: DataFrame, id_column: str = "doc_id", least: float = 0.8) -> DataFrame:
    """(node, class_id) for every different text of docs: node is digest(text), class_id the smallest id of its group.

    Texts are near duplicates from a weighted Jaccard similarity of ``least`` on; groups
    are connected by such links. Equal texts are always one group. A null text counts as
    empty; texts without words group with equal texts only. Fewer than five words make one
    shingle. Null ids are passed over for class_id, which is null only if a group has no
    other. Repeated rows and extra columns change nothing. Empty table: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(named(id_column).alias("doc"), digest(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    counts, n_docs = document_frequencies(rows)
    idf = spark.sparkContext.broadcast(idf_of(counts, n_docs))
    common = spark.sparkContext.broadcast(np.log1p(counts).astype(np.float32))
    names = checkpoint(rows.groupBy("node").agg(F.min("doc").alias("doc")))
    keys, _ = settled(keys_of(rows, idf, common).distinct())
    shared = keys.groupBy("key").agg(F.max(F.struct("central", "node")).alias("top"), F.min("node").alias("first"), F.max("node").alias("last")).where("first != last")
    many, _ = settled(keys.select("key", "node", "marks").join(shared.select("key", F.col("top.node").alias("center")), "key"))  # the keys that texts share
    # Any row has a text that equals another's, so one is taken before texts meet their pairs.
    wanted, n_wanted = settled(many.select("node").distinct())
    wanted_rows = rows.join(F.broadcast(wanted) if n_wanted <= MOST_WANTED else wanted, "node", "left_semi")
    texts, _ = settled(wanted_rows.select("node", "text").dropDuplicates(["node"]), wide=True)
    discard(keys, wanted)
    compared, n = settled(many.where("node != center").select(_pair("node", "center")).select("p.*").distinct())
    links, _ = settled(verified(compared, n, texts, idf, least))
    members, _ = settled(many.join(components(links), "node", "left").select("key", "node", "marks", "center", F.coalesce("component", "node").alias("label")))
    discard(many, compared, links)
    # Inside a key, what its center didn't bring together: all other pairs that can be links.
    found, n_found = settled(remaining(members, texts, idf, least))
    discard(texts)
    state = members.select("node", "label").distinct()
    if n_found:
        label_of = state
        ends = found.join(label_of.withColumnsRenamed({"node": "a", "label": "u"}), "a").join(label_of.withColumnsRenamed({"node": "b", "label": "v"}), "b")
        merged = components(ends.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnRenamed("node", "label")
        state = state.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("label"))
    whole, _ = settled(state.withColumnRenamed("label", "component"))
    discard(members, found)
    labelled = names.join(whole, "node", "left").withColumn("label", F.coalesce("component", "node"))
    smallest = labelled.groupBy("label").agg(F.min("doc").alias("class_id"))
    return labelled.join(smallest, "label").select("node", "class_id", "label")


def classes(docs: DataFrame, id_column: str = "doc_id", least: float = 0.8) -> DataFrame:
    """One row for each of docs: its id, class_id and kept (its id is class_id); see groups()."""
    found = groups(docs, id_column, least).select("node", "class_id")
    rows = docs.select(named(id_column).alias("doc"), digest(F.col("text")).alias("node"))
    return rows.join(found, "node").select(F.col("doc").alias(id_column), "class_id", F.col("doc").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", least: float = 0.8) -> DataFrame:
    """docs with one row for each group: that of the smallest id, of rows with this id the first by text and other columns; all columns stay, whatever their names."""
    columns, mark = [named(c) for c in docs.columns], mark_for(docs)
    node, smallest, label, place = (f"{mark}{x}" for x in ("node", "class", "label", "n"))
    found = groups(docs, id_column, least).select(F.col("node").alias(node), F.col("class_id").alias(smallest), F.col("label").alias(label))
    tagged = docs.withColumn(node, digest(F.col("text"))).join(found, node)
    first = tagged.where(named(id_column).eqNullSafe(F.col(smallest)))
    repeated, n = settled(first.groupBy(label).count().where("count > 1").select(label))
    if not n:
        return first.select(columns)
    once = first.join(F.broadcast(repeated) if n < 100_000 else repeated, label, "left_anti")
    order = W.partitionBy(label).orderBy(F.to_json(F.struct(*columns)))
    again = first.join(repeated, label, "left_semi").withColumn(place, F.row_number().over(order)).where(f"{place} = 1")
    return once.select(columns).union(again.select(columns))
