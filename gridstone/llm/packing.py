"""Packing: Karmarkar-Karp multiway differencing makes near-equal windows."""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import kept

CAPACITY = 1024
#: Windows that one differencing balances, and tokens of a part that moves as one.
WINDOWS, PART = 32, 256
#: Tokens that a full group leaves free, so that near-equal windows stay within the capacity.
SLACK = 8
#: Chunks whose ids a worker remembers at most (about 80 MB): those met lately, and those met before them.
MOST_CHUNKS = 300_000


#: The published pattern by which byte-level tokenizers split texts; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokenizer:
    """Ids of a byte-level tokenizer by chunks that its pattern never joins.

    The pattern gives a space to what follows it and splits off other white space, so a
    text may be cut before each space and line feed as long as no run of white space has
    three characters, or two at the end. Texts with runs, other white space, or with what
    may be a special token go to the tokenizer's own library whole. A chunk that was not
    met before is merged by the same ranks in a second library, which takes single words
    at less cost; a vocabulary whose ids aren't in the order of its merges isn't so read.
    """

    _rare = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.word = self._ranked(path) or (lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids)

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocab.get(a + b) for a, b in merges]
        if None in order or order != sorted(order) or model.get("ignore_merges"):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {bytes(map(byte_of.__getitem__, t)): k for t, k in vocab.items() if all(c in byte_of for c in t)}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={t: k for t, k in ranks.items() if len(t) == 1 or k >= (order[0] if order else 0)}, special_tokens={}).encode_ordinary

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fill(self, chunks: list[str]) -> None:
        """A chunk that begins with a line feed stands for itself, any other for a space and itself."""
        if len(self.known) > MOST_CHUNKS // 2:  # what isn't met again goes with the next turn
            self.older, self.known = self.known, {}
        known, older, word = self.known, self.older, self.word
        for x in chunks:
            if x not in known:
                packed = older.get(x)
                if packed is None:
                    ids = word(x if x[:1] == "\n" else " " + x)
                    packed = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
                known[x] = packed

    def __call__(self, text: str) -> bytes:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "<|" in text or self._rare.search(text):
            return self._plain(text)
        first, *chunks = text.replace("\n", " \n").split(" ")
        try:
            rest = b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            self._fill(chunks)
            rest = b"".join(map(self.known.__getitem__, chunks))
        return (self._plain(first) if first else b"") + rest


#: Packers of few ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


def byte_tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer for each file in a worker."""
    mine = kept("packing")
    if path not in mine:
        mine[path] = ByteTokenizer(path)
    return mine[path]


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Indexes of sizes dealt to m sets of near-equal sums, by Karmarkar-Karp differencing.

    Each partial partition has m sums in descending order. The two of the largest spread
    merge, the largest sum of one with the smallest of the other, until one is left.
    """
    heap = [(-s, k, [s] + [0] * (m - 1), [(k,)] + [()] * (m - 1)) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = [p + q for p, q in zip(a, reversed(b))]
        order = sorted(range(m), key=sums.__getitem__, reverse=True)
        y = y[::-1]
        # Sets are pairs of pairs until the end, so that a merge costs the same for any number of members.
        sets = [(x[k], y[k]) if x[k] and y[k] else x[k] or y[k] for k in order]
        sums = [sums[k] for k in order]
        heapq.heappush(heap, (sums[-1] - sums[0], tie, sums, sets))
        tie += 1
    return [_members(s) for s in heap[0][3]] if heap else [[] for _ in range(m)]


def _members(pair: tuple) -> list[int]:
    out, todo = [], [pair]
    while todo:
        x = todo.pop()
        if isinstance(x, int):
            out.append(x)
        else:
            todo.extend(x)
    return out


def balanced(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few near-equal windows as hold the sizes: the count rises while one is beyond the capacity."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = difference(sizes, m)
        if all(sum(sizes[k] for k in s) <= capacity for s in sets):
            return sets
        m += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian unsigned 32-bit bytes.

    Each document is its ids and end_id. What fills windows goes there as it is; the rests
    of a partition's documents, in parts of PART ids at most, are gathered up to WINDOWS
    windows, less SLACK, and dealt to near-equal windows. No shuffle: an input partition
    packs its own documents, so at most its last group leaves part of a window free, and
    memory holds one group and one document. sequence_id has the partition's number above
    its 40 low bits; it isn't gapless.

    Null text: empty, one piece of end_id. Null ids and repeated rows: each row is packed.
    Extra columns are left out. Empty table: no rows.
    """
    part = min(PART, capacity)
    goal = WINDOWS * capacity - min(SLACK, capacity // 8)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = byte_tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        out: list[tuple] = []
        group: list[tuple] = []  # id, start, ids, doc_tokens
        gathered = 0

        def close() -> None:
            nonlocal sequence, gathered
            for members in balanced([len(g[2]) // 4 for g in group], capacity):
                at = 0
                for k in sorted(members):
                    name, start, ids, total = group[k]
                    out.append((name, start, len(ids) // 4, ids, total, sequence, at))
                    at += len(ids) // 4
                sequence += bool(members)
            group.clear()
            gathered = 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return batch

        for batch in batches:
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(words.as_py() or "") + tail
                total = len(ids) // 4
                at = total - total % capacity
                for start in range(0, at, capacity):
                    out.append((name, start, capacity, ids[4 * start : 4 * (start + capacity)], total, sequence, 0))
                    sequence += 1
                while at < total:
                    size = min(part, total - at, goal - gathered)
                    group.append((name, at, ids[4 * at : 4 * (at + size)], total))
                    gathered, at = gathered + size, at + size
                    if gathered == goal:
                        close()
                if len(out) >= 2000:
                    yield flush()
        if group:
            close()
        yield flush()

    found = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text)).mapInArrow(work, "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return found.withColumnRenamed("doc", id_column)
