"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton of all pieces reads a text once. At each position its output links give every piece
that ends there, and each relaxes the best score at that position; back pointers give the pieces.
The result is the segmentation with the largest sum of scores, as for SentencePiece's unigram
models. (For a model trained as BPE it is the best-scored segmentation into its pieces, which is
not always the one that merging would find.)

Characters that no piece covers cost the smallest score less 10, and become byte pieces. Of equally
good segmentations the one whose last pieces are longer wins. White space is U+2581 in pieces, and
one is put in front. A U+2581 in the text itself becomes byte pieces, so that decoding restores
every text. If no piece has U+2581 after another character (checked), segmentations never cross
the start of a word, and words are encoded one by one and remembered.
"""

from __future__ import annotations

import hashlib
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import text_or_empty

#: Fixed values of the model format: SentencePiece's space mark, field numbers and piece types.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
PENALTY = 10.0
#: Words remembered by a worker at most; then it forgets all.
MEMORY = 300_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes):
    """(field number, value) pairs of a protocol-buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            c = data[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id. Only models without text normalisation are taken."""
    pieces = []
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif field == 3:
            own = dict(_fields(value))
            if own.get(2):
                raise ValueError("models with a normalisation table are not taken")
    return pieces


class Codec:
    """Encodes and decodes texts with the pieces of one model."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces, so texts could not be restored")
        words = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED) and p]
        self.floor = min((s for _, s, _ in words), default=0.0) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in words:
            self.automaton.add_word(piece, (len(piece), score, i))
        if words:
            self.automaton.make_automaton()
        self.text_of = {i: p.replace(MARK, " ") for p, _, i in words}
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _, _ in words)
        self.known: dict[str, tuple[int, ...]] = {}

    def best(self, text: str) -> list[int]:
        """Viterbi over a text in which spaces are MARK already; "\\0" stands for a literal MARK."""
        n = len(text)
        score = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        at = 0  # positions up to here are settled
        floor = self.floor

        def settle(upto: int) -> None:
            # a character that no piece covers by itself can stand alone as an unknown one
            nonlocal at
            while at < upto:
                at += 1
                lone = score[at - 1] + floor
                if score[at] is None or lone > score[at]:
                    score[at], back[at] = lone, (1, -1)

        if len(self.automaton):
            for end, (size, value, i) in self.automaton.iter(text):
                end += 1
                if end - 1 > at:
                    settle(end - 1)
                total = score[end - size] + value
                old = score[end]
                if old is None or total > old or (total == old and size > back[end][0]):
                    score[end], back[end] = total, (size, i)
        settle(n)
        ids: list[int] = []
        while n:
            size, i = back[n]
            if i < 0:
                c = MARK if text[n - 1] == "\0" else text[n - 1]
                ids.extend(self.byte_ids[b] for b in reversed(c.encode("utf-8", "surrogatepass")))
            else:
                ids.append(i)
            n -= size
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if "\0" in text or MARK in text:
            return self._encode_marked(text)
        text = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.best(text)
        known, out = self.known, []
        if len(known) > MEMORY:
            known.clear()
        for word in self._words(text):
            ids = known.get(word)
            if ids is None:
                ids = tuple(self.best(word))
                if len(word) < 64:
                    known[word] = ids
            out.extend(ids)
        return out

    @staticmethod
    def _words(text: str):
        """Parts that begin with a run of MARK; only the last of a run is certain to join the word."""
        run = ""
        for part in text.split(MARK)[1:]:
            run += MARK
            if part:
                yield run + part
                run = ""
        if run:
            yield run

    def _encode_marked(self, text: str) -> list[int]:
        """Texts that hold a literal MARK or NUL: these characters become byte pieces."""
        out: list[int] = []
        part = [MARK]
        for c in text:
            if c in ("\0", MARK):
                out += self.best("".join(part)) if part else []
                out += [self.byte_ids[b] for b in c.encode()]
                part = []
            else:
                part.append(MARK if c == " " else c)
        return out + (self.best("".join(part)) if part else [])

    def decode(self, ids) -> str:
        parts, raw = [], bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "surrogatepass"))
                raw = bytearray()
            parts.append(self.text_of.get(i, ""))
        if raw:
            parts.append(raw.decode("utf-8", "surrogatepass"))
        text = "".join(parts)
        return text[1:] if text[:1] == " " else text


def _codec_rows(model: bytes, texts_to_ids: bool):
    pieces = None

    def run(batches):
        codec = Codec(read_model(model.value))
        for batch in batches:
            yield from _encode_batch(codec, batch) if texts_to_ids else _decode_batch(codec, batch)

    return run


def _encode_batch(codec: Codec, batch):
    for at in range(0, batch.num_rows, 512):
        part = batch.slice(at, 512)
        texts = part.column(part.num_columns - 1)
        ids = [codec.encode(t.as_py()) for t in texts]
        back = [codec.decode(i) == t.as_py() for i, t in zip(ids, texts, strict=True)]
        packed = [np.array(i, "<i4") for i in ids]
        yield pa.RecordBatch.from_arrays(
            [*part.columns[:-1], pa.array([len(i) for i in ids], pa.int64()), pa.array(packed, pa.list_(pa.int32())), pa.array([hashlib.sha256(p.tobytes()).hexdigest() for p in packed]), pa.array(back)],
            names=[*part.schema.names[:-1], "n_pieces", "ids", "ids_sha256", "restored"],
        )


def _decode_batch(codec: Codec, batch):
    ids = batch.column(batch.num_columns - 1)
    texts = [None if i.as_py() is None else codec.decode(i.as_py()) for i in ids]
    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_pieces, ids, ids_sha256 (of the ids as little-endian 32-bit
    numbers), restored (does decoding give the text?). Null texts count as empty and have no pieces.

    The driver reads the model and broadcasts its bytes (half a megabyte), so workers need no file.
    Repeated rows give equal rows; other columns are not read; an empty table gives an empty result.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]
    table = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    return table.mapInArrow(_codec_rows(shared, True), f"`{id_col}` {kind}, n_pieces bigint, ids array<int>, ids_sha256 string, restored boolean")


def decode(rows: DataFrame, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows; null ids give a null text."""
    with open(model_path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("__ids")).mapInArrow(_codec_rows(shared, False), f"`{id_col}` {kind}, text string")


def op7_query(spark, sf_dir):
    """Every whole text of documents, encoded; restored says whether decoding gave it back."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
