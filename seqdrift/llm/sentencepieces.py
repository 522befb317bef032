"""SentencePiece encoding and decoding as shortest paths of weighted finite-state transducers.

Three transducers are compiled from a public model file: the normaliser (white space escapes, and
the optional leading space), the lexicon (a trie of the pieces) and byte fallback (a character that
is no piece is written as the pieces of its UTF-8 bytes). For byte-pair models an acceptor over
piece pairs joins them: a pair (a, b) has weight infinity in the tropical semiring unless merging
the string ab by piece rank leaves exactly a, b. A piece sequence is the model's own segmentation
exactly if all its neighbouring pairs are accepted, so the cheapest path through the composition of
an input with these machines is that segmentation (arcs of finite weight cost nothing more). Paths are found per chunk (cut where no piece
crosses) and chunks are remembered, since most words come again.

Decoding runs the same machines backwards: pieces to characters, byte pieces to UTF-8.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import read, text_chunks

#: Public model file; a parameter of every function that needs one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

SPACE = "▁"
#: Chunks (twice) and piece pairs that a Python worker remembers.
REMEMBERED = 400_000
#: Arcs are piece ids, or the number of pieces plus a code point (fallback). Piece 0 is no text.
START, ARC_BITS = 0, 22


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at:at + n]
            at += n


def load_model(path: str = MODEL) -> dict:
    """Pieces (text, score, type) and the settings that the transducers need.

    Model files hold pieces in field 1, the trainer's settings in 2 and the normaliser's in 3.
    """
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    pieces = []
    for number, value in message:
        if number == 1:
            p = dict(_fields(value))
            pieces.append((p[1].decode(), float(np.frombuffer(p.get(2, bytes(4)), "<f4")[0]), p.get(3, 1)))
    trainer = dict(_fields(next(v for k, v in message if k == 2)))
    normal = dict(_fields(next(v for k, v in message if k == 3)))
    if trainer.get(3, 1) != 2 or normal.get(2) or not trainer.get(35):
        raise ValueError("only byte-pair models with an identity normaliser and byte fallback are supported")
    return {"pieces": pieces, "dummy_prefix": bool(normal.get(3, 1)), "squeeze": bool(normal.get(4, 1))}


class PieceTransducer:
    """Encoder and decoder of one model."""

    NORMAL, BYTE = 1, 6

    def __init__(self, model: dict):
        self.model = model
        self.id_of = {p: i for i, (p, _, kind) in enumerate(model["pieces"]) if kind == self.NORMAL}
        self.score = {p: s for p, s, kind in model["pieces"] if kind == self.NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model["pieces"]) if kind == self.BYTE}
        self.n_pieces = len(model["pieces"])
        self.trie: dict = {}
        for p, i in self.id_of.items():
            node = self.trie
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        self.out = [p.encode() if kind == self.NORMAL else b"" for p, _, kind in model["pieces"]]
        for b, i in self.byte_id.items():
            self.out[i] = bytes([b])
        self.chunk = self._chunk_pattern()
        self.accepted: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _chunk_pattern(self) -> re.Pattern:
        """Splits a text where no piece can cross, as the pieces themselves tell.

        Merges only ever join what is inside one piece, so a text may be cut between two characters
        that no piece has side by side: before a run of spaces, between a letter or digit and the
        marks that follow none in any piece, and around line ends.
        """
        pairs = {(a, b) for p in self.id_of for a, b in zip(p, p[1:])}
        after_word = {b for a, b in pairs if a.isalnum()}
        marks = {b for _, b in pairs if not b.isalnum() and b not in after_word and b not in (SPACE, "_")}
        if any(a != SPACE and b == SPACE or "\n" in (a, b) for a, b in pairs):
            return re.compile(r"(?s:.+)")
        mark, stop = re.escape("".join(sorted(marks))), SPACE + r"\n"
        other = rf"(?:[^\w{stop}]|_)"
        return re.compile(rf"\n|{SPACE}*+{other}*+(?:[^\W_]++(?:(?:[^\w{stop}{mark}]|_){other}*+)?+)*+")

    def normalise(self, text: str) -> str:
        if self.model["squeeze"]:
            text = re.sub(" +", " ", text.strip(" "))
        if self.model["dummy_prefix"] and text:
            text = " " + text
        return text.replace(" ", SPACE)

    def merge(self, text: str) -> list[str]:
        """Segmentation by merging the neighbours whose union is the best piece, leftmost first."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return parts
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def accepts(self, a: int, b: int) -> bool:
        """Whether the pair acceptor gives arc b after arc a (START: at the beginning) weight zero."""
        if len(self.accepted) >= REMEMBERED:
            self.accepted.clear()
        pair = [x for x in (self.text_of(a), self.text_of(b)) if x]
        known = self.accepted[a << ARC_BITS | b] = self.merge("".join(pair)) == pair
        return known

    def text_of(self, arc: int) -> str:
        if arc == START:
            return ""
        return self.model["pieces"][arc][0] if arc < self.n_pieces else chr(arc - self.n_pieces)

    def shortest_path(self, chunk: str) -> list[int]:
        """Arcs of the cheapest accepted path through the composition; states are (place, last arc).

        The segmentation of a prefix is unique, so of all states at a place one has a finite
        weight: the search at a place ends with the first arc that reaches it. Arcs into a place are
        the pieces that end there (a walk down the trie of reversed pieces), or the fallback arc.
        """
        known, root = self.accepted, self.trie
        last, came = [START], [0]
        for end in range(1, len(chunk) + 1):
            node, start, arcs = root, end, []
            while start:
                node = node.get(chunk[start - 1])
                if node is None:
                    break
                start -= 1
                arc = node.get("")
                if arc is not None:
                    arcs.append((start, arc))
            if not arcs or arcs[0][0] != end - 1:
                arcs.insert(0, (end - 1, self.n_pieces + ord(chunk[end - 1])))
            for start, arc in reversed(arcs):
                before = last[start]
                ok = known.get(before << ARC_BITS | arc)
                if self.accepts(before, arc) if ok is None else ok:
                    break
            last.append(arc)
            came.append(start)
        path, end = [], len(chunk)
        while end:
            path.append(last[end])
            end = came[end]
        return path[::-1]

    def _chunk_ids(self, chunk: str) -> bytes:
        ids = array("i")
        for arc in self.shortest_path(chunk):
            if arc < self.n_pieces:
                ids.append(arc)
            else:
                ids.extend([self.byte_id[b] for b in chr(arc - self.n_pieces).encode()])
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        text = self.normalise(text)
        chunks = self.chunk.findall(text)
        known = self.known
        if chunks and not chunks[-1]:
            chunks.pop()  # the empty match at the end
        out = list(map(known.get, chunks))
        if None in out:
            for i, c in enumerate(chunks):
                if out[i] is None:
                    ids = known.get(c) or self.older.get(c) or self._chunk_ids(c)
                    if len(c) <= 64:
                        if len(known) >= REMEMBERED:
                            # chunks that don't come again are forgotten with the older half
                            self.older, self.known = known, {}
                            known = self.known
                        known[c] = ids
                    out[i] = ids
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        data = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return data[1:] if self.model["dummy_prefix"] and data.startswith(" ") else data


_machines: dict[int, PieceTransducer] = {}


def _machine(model) -> PieceTransducer:
    """The transducer of a broadcast model, compiled once per Python worker."""
    key = model._jbroadcast_id if hasattr(model, "_jbroadcast_id") else id(model.value)
    if key not in _machines:
        _machines.clear()
        _machines[key] = PieceTransducer(model.value)
    return _machines[key]


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row of ``docs`` (doc_id, text).

    round_trip: decoding the ids gives the normalised text back. Null and empty texts have no ids.
    Repeated rows and null ids are encoded like others. The model file is read on the driver.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    d = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _machine(model)
        for part, texts in text_chunks(batches, "text", 1 << 20):
            ids, same = [], []
            for t in texts:
                t = t.decode("utf-8", "replace")
                ids.append(m.encode(t))
                plain = m.normalise(t).replace(SPACE, " ")
                same.append(m.decode(ids[-1].tolist()) == (plain[1:] if m.model["dummy_prefix"] else plain))
            size = np.array([len(x) for x in ids], np.int64)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.ListArray.from_arrays(offsets, flat),
                                              pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, "
                             "ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of token rows (doc_id, ids); null ids give an empty text."""
    model = tokens.sparkSession.sparkContext.broadcast(load_model(model_path))
    d = tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _machine(model)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.decode(x.as_py()) for x in part.column(1)])],
                                                 names=["doc_id", "text"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
