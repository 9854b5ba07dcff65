"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines in a row, compiled from a model file: the normaliser rewrites the longest
mapped run at each place and then white space; the pieces read the result; byte fallback
reads a character that no piece reads. Composed with an input their states are (place in
the input, last piece). An arc reads a piece and weighs minus its score, and the shortest
path in the tropical semiring is the answer, for both kinds of model. In a model of merges
(BPE) an arc also weighs infinity after a piece that merging would not leave beside it:
if merging the two pieces' characters alone doesn't give just these two. Every text then
has one path of finite weight, and it is the merges' result: the first merge across a
border of two pieces would be one in these two pieces alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import kept

BAR = "▁"
#: Segments and pairs that a worker remembers at most; then it starts anew.
MOST_SEGMENTS, MOST_PAIRS = 1_200_000, 1_000_000
#: What a character without a piece scores below the least piece; fixed value of the library.
UNKNOWN_PENALTY = 10.0


def mappings(packed: bytes) -> dict[str, str]:
    """The rewritings of a packed normaliser: a double-array trie of keys, then the texts that its leaves point to."""
    if not packed:
        return {}
    size = int.from_bytes(packed[:4], "little")
    units, texts = np.frombuffer(packed, "<u4", size // 4, 4), packed[4 + size :]
    first = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    letters = np.arange(256, dtype=np.uint32)
    keys, places, out = [b""], np.zeros(1, np.uint32), {}
    while keys:
        to = (places ^ first(units[places]))[:, None] ^ letters
        to[to >= len(units)] = 0
        rows, letter = np.nonzero((units[to] & np.uint32(0x800000FF)) == letters)
        live = letter > 0  # a key doesn't hold the byte 0
        rows, letter = rows[live], letter[live]
        places, keys = to[rows, letter], [keys[r] + bytes([c]) for r, c in zip(rows.tolist(), letter.tolist(), strict=True)]
        leaf = (units[places] >> 8) & 1 == 1
        values = units[places ^ first(units[places])] & np.uint32(0x7FFFFFFF)
        for k in np.flatnonzero(leaf).tolist():
            at = int(values[k])
            out[keys[k].decode()] = texts[at : texts.index(b"\0", at)].decode()
    return out


class Normaliser:
    """From a text to what the pieces read: mapped runs, one space for many if the model says so, BAR for a space."""

    def __init__(self, spec, kept: list[str]):
        if spec.HasField("escape_whitespaces") and not spec.escape_whitespaces:
            raise ValueError("white space must be escaped")
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.arcs = mappings(spec.precompiled_charsmap) | {p: p for p in kept}  # pieces that users defined stay as they are
        self.kept = set(kept)
        self.longest = max(map(len, self.arcs), default=0)
        self.begins = {k[0] for k in self.arcs}
        self.plain = not self.arcs and not self.squeeze

    def _rewritten(self, text: str) -> Iterator[str]:
        at, n = 0, len(text)
        while at < n:
            run = 1
            if text[at] in self.begins:
                sizes = range(min(self.longest, n - at), 0, -1)
                run = next((k for k in sizes if text[at : at + k] in self.kept), 0) or next((k for k in sizes if text[at : at + k] in self.arcs), 1)
            part = text[at : at + run]
            yield self.arcs.get(part, part)
            at += run

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            return (BAR if self.prefix else "") + text.replace(" ", BAR)
        parts, out, spaced = list(self._rewritten(text)), [BAR if self.prefix else ""], self.squeeze
        if self.squeeze:
            while parts and parts[0] == " ":
                parts.pop(0)
            if not parts:
                return ""
        for part in parts:
            if spaced:
                part = part.lstrip(" ")
            if part:
                out.append(part.replace(" ", BAR))
                spaced = self.squeeze and part.endswith(" ")
        whole = "".join(out)
        return whole.rstrip(BAR) if self.squeeze else whole


class Transducer:
    """Normaliser, pieces and byte fallback of a model file, composed with inputs."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model_pb2.ModelProto.SentencePiece
        trainer = model.trainer_spec
        self.merges = trainer.model_type == 2
        unused = any(p.type == kinds.UNUSED for p in model.pieces)
        if trainer.treat_whitespace_as_suffix or trainer.model_type not in (1, 2) or (unused and self.merges):
            raise ValueError("only white space before words, and unigram or BPE pieces, all of them in use, are supported")
        self.normalise = Normaliser(model.normalizer_spec, [p.piece for p in model.pieces if p.type == kinds.USER_DEFINED])
        self.prefix = self.normalise.prefix
        self.pieces: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        users: list[str] = []
        for k, p in enumerate(model.pieces):
            kind = p.type
            self.pieces.append(b"" if kind == kinds.CONTROL else p.piece.encode())
            if kind == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value], self.pieces[-1] = k, bytes([value])
            elif kind == kinds.UNKNOWN:
                self.unknown, self.pieces[-1] = k, " ⁇ ".encode()
            elif kind == kinds.NORMAL:
                self.score[p.piece], self.ids[p.piece] = p.score, k
            elif kind == kinds.USER_DEFINED:
                users.append(p.piece)
                self.ids[p.piece] = k
        scores = list(self.score.values())
        self.least = np.float32(min(scores, default=0.0)) - np.float32(UNKNOWN_PENALTY)
        # A piece that a user defined is always taken: alone among merges, by a score beyond any path's otherwise.
        self.frozen = re.compile("|".join(map(re.escape, sorted(users, key=len, reverse=True)))) if users and self.merges else None
        if not self.merges:
            most = np.float32(max([*scores, 0.0]))  # the library's largest score is never below zero
            self.score |= {p: float(np.float32(np.float32(len(p.encode())) * most) - np.float32(0.1)) for p in users}
        # Arcs start and end at BAR unless a piece holds a BAR behind another character; then words may be read apart.
        # Weights of unigrams are rounded along the whole text, and unknown characters beside each other become one.
        self.borders = self.merges and not any(BAR in p.lstrip(BAR) for p in self.ids) and bool(self.bytes)
        self.line_feed_alone = not any("\n" in p for p in self.ids)
        self._allowed: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # Arcs by the letters that they read: a node has, by letter, the next node, the piece that ends there (or None) and its weight.
        self.arcs = {p for p in self.score if not self.merges or self._merged(p) == [p]}
        self.start: dict[str, list] = {}
        for piece in self.arcs:
            node = self.start
            for letter in piece:
                entry = node.setdefault(letter, [{}, None, 0.0])
                node = entry[0]
            entry[1:] = [piece, -self.score[piece]]

    def _merged(self, text: str) -> list[str]:
        """The result of merging the best-scored neighbours, the leftmost of equal ones, as long as there are any."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, a: str, b: str) -> bool:
        """Whether the arc of b may come after that of a."""
        if not self.merges:
            return True
        found = self._allowed.get((a, b))
        if found is None:
            if len(self._allowed) > MOST_PAIRS:
                self._allowed.clear()
            if a[-1] + b[0] not in self.inside:  # no merge reaches over the border
                found = True
            elif a + b in self.arcs:  # the two become one
                found = False
            else:
                found = self._merged(a + b) == [a, b]
            self._allowed[a, b] = found
        return found

    def path(self, text: str) -> list[str]:
        """The pieces of the shortest path through a normalised text; a character without a piece is one by itself.

        A place keeps its lightest state: with merges only one last piece has a finite weight
        there, and otherwise the last piece doesn't matter for what follows. Whether an arc
        weighs infinity is asked only if it would be the lightest. Of equally light paths the
        one whose last arc begins first stays, as in the library; unigram weights are summed
        in single precision as there.
        """
        merges, allowed, start, unknown = self.merges, self._allowed, self.start, -float(self.least)
        if merges and text in self.arcs:  # merging the whole gives one piece
            return [text]
        n = len(text)
        weight: list[float] = [0.0] + [inf] * n
        back: list[tuple[str, int]] = [("", 0)] * (n + 1)
        for begin in range(n):
            so_far = weight[begin]
            if so_far == inf:
                continue
            last, node = back[begin][0], start
            if text[begin] not in node or node[text[begin]][1] is None:
                w, piece = so_far + unknown, text[begin]
                w = w if merges else float(np.float32(w))
                if w < weight[begin + 1] and (not merges or not last or self._follows(last, piece)):
                    weight[begin + 1], back[begin + 1] = w, (piece, begin)
            for end in range(begin, n):
                entry = node.get(text[end])
                if entry is None:
                    break
                node, piece, w = entry
                if piece is None:
                    continue
                w += so_far
                if not merges:
                    w = float(np.float32(w))
                if w < weight[end + 1]:
                    if merges and last:
                        ok = allowed.get((last, piece))
                        if ok is None:
                            ok = self._follows(last, piece)
                        if not ok:
                            continue
                    weight[end + 1], back[end + 1] = w, (piece, begin)
        out, end = [], n
        while end:
            piece, end = back[end]
            out.append(piece)
        return out[::-1]

    def _taken(self, segment: str) -> Iterator[str]:
        """The pieces of a segment: those that users defined stand alone among merges."""
        at = 0
        for met in self.frozen.finditer(segment) if self.frozen else ():
            if met.start() > at:
                yield from self.path(segment[at : met.start()])
            yield met[0]
            at = met.end()
        if at < len(segment):
            yield from self.path(segment[at:])

    def _ids(self, segment: str) -> bytes:
        ids: list[int] = []
        of = self.ids
        for piece in self._taken(segment) if self.frozen else self.path(segment):
            if piece in of:
                ids.append(of[piece])
            elif self.bytes:
                ids += [self.bytes[b] for b in piece.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def _parts(self, segment: str) -> bytes:
        """A line feed that no piece holds is a border on both sides."""
        return b"".join(map(self._ids, re.findall("\n|[^\n]+", segment))) if self.line_feed_alone else self._ids(segment)

    def _fill(self, chunks: list[str]) -> None:
        """Ids of what stands between spaces: behind its space, or from its line feed on."""
        if len(self.known) > MOST_SEGMENTS:
            self.known.clear()
        known = self.known
        for chunk in chunks:
            if chunk not in known:
                stem = chunk[:-1]
                if len(stem) > 1 and chunk[-2:] not in self.inside and chunk[-1] != "\n":  # a border that no piece reaches over
                    if stem not in known:
                        known[stem] = self._parts(stem if stem[:1] == "\n" else BAR + stem)
                    known[chunk] = known[stem] + self._parts(chunk[-1])
                else:
                    known[chunk] = self._parts(chunk if chunk[:1] == "\n" else BAR + chunk)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if self.normalise.plain and self.prefix and self.borders and self.line_feed_alone and "  " not in text and BAR not in text and text[0] != " ":
            chunks = text.replace("\n", " \n").split(" ")
            try:
                return b"".join(map(self.known.__getitem__, chunks))
            except KeyError:
                self._fill(chunks)
                return b"".join(map(self.known.__getitem__, chunks))
        text = self.normalise(text)
        return b"".join(map(self._parts, re.findall(f"{BAR}*[^{BAR}]+|{BAR}+", text))) if self.borders else self._ids(text)

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes of byte pieces join; the space before the first word goes, or all if the model keeps one of many."""
        pieces, bar = list(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())), BAR.encode()
        if self.prefix or self.normalise.squeeze:
            for k, p in enumerate(pieces):
                if p.startswith(bar):
                    pieces[k] = p[len(bar) :]
                    if not self.normalise.squeeze:
                        break
                if pieces[k]:
                    break
        return b"".join(pieces).decode("utf-8", "replace").replace(BAR, " ")


def transducer(path: str) -> Transducer:
    """One compiled transducer for each model in a worker."""
    mine = kept("sentencepiece")
    if path not in mine:
        mine[path] = Transducer(path)
    return mine[path]


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a binary column of ids (little-endian unsigned 32-bit). Null text: null ids; empty: no ids."""

    @F.pandas_udf("binary")
    def run(texts):
        t = transducer(model)
        return texts.map(lambda x: None if x is None else t.encode(x))

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the texts of a binary column of ids; null ids: null."""

    @F.pandas_udf("string")
    def run(values):
        t = transducer(model)
        return values.map(lambda x: None if x is None else t.decode(bytes(x)))

    return df.withColumn(text, run(F.col(ids)))


def round_trip(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, decoded) in one pass over the texts. A null text counts as empty; repeated rows stay; extra columns go; empty table: no rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [t.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(t.decode, ids), pa.string())], ["doc", "ids", "decoded"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text))
    return rows.mapInArrow(work, "doc long, ids binary, decoded string").withColumnRenamed("doc", id_column)
