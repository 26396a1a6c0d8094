"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

The rank file lists byte strings and ranks. Each byte string becomes a piece of printable characters (one
character a byte) whose score is minus its rank, so that sentencepiece's BPE, which joins the best-scored
neighbours first, joins the lowest rank first. Nothing is trained and the text isn't normalised. Each match of
the splitting pattern is encoded on its own. Decoding looks each id up in the inverse table.

Defined results: a null text counts as empty and has no ids; repeated rows give repeated rows; columns other
than the id and the text aren't read, so their names can't clash.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: White space as Unicode defines it, which is what ``\s`` means in the splitting patterns.
SPACE = "\t-\r \x85\xa0  -     　"
#: Cuts a text where no match of a GPT-style pattern can cross: before each run of non-space with the one blank
#: ahead of it. The parts recur far more often than texts do and are worth remembering.
PART = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Parts that a Python worker remembers before it forgets them all: about 100 MB.
REMEMBERED = 500_000
#: The same in bytes, for texts without blanks, whose parts are long.
REMEMBERED_BYTES = 32 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, then the rank, a line each."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose ids are the ranks; the unknown piece comes last, and no text reaches it."""
    letters = byte_letters()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[p] for p in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(letters[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, normal))
        for rank, piece in enumerate(by_rank)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(by_rank))
    trainer += b"".join(_field(n, -1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def exact_spaces(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelled out, as libraries differ on control characters."""
    return pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")


class PartEncoder:
    """Texts -> their ids as little-endian 32-bit bytes. Parts not met before are encoded together."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        self.find = regex.compile(exact_spaces(pattern)).findall
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, parts: list[str]):
        if len(self.known) + len(parts) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        tokens, counts = [], []
        for part in parts:
            # letters, with or without a blank ahead, are one match of any GPT-style pattern
            found = [part] if part.isalpha() or part[0] == " " and part[1:].isalpha() else self.find(part)
            tokens += found
            counts.append(len(found))
        mapped = [t.encode().decode("latin-1").translate(self.table) for t in tokens]
        ids = iter(self.encode(mapped, num_threads=1) if mapped else [])
        for part, n in zip(parts, counts, strict=True):
            self.known[part] = array("I", next(ids) if n == 1 else chain.from_iterable(islice(ids, n))).tobytes()
            self.held += len(part) + len(self.known[part])

    def ids(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            some, parts = [], 0
            while at < len(texts) and (not some or parts < 200_000):
                some.append(PART.findall(texts[at]))
                parts += len(some[-1])
                at += 1
            if new := set().union(*some).difference(self.known):
                self._learn(list(new))
                if any(p not in self.known for found in some for p in found):  # forgotten just now
                    self._learn([p for p in set().union(*some) if p not in self.known])
            out += [b"".join(map(self.known.__getitem__, found)) for found in some]
        return out


class Decoder:
    """Ids -> the bytes they stand for, many at once: each byte is looked up in the joined pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = sorted(ranks, key=ranks.get)
        self.joined = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(lengths) - lengths)
        return self.joined[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))].tobytes()


def _lists(found: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``id_col`` and ``ids`` (array of int), one for each row of ``docs``. The vocabulary is bounded (about
    1 MB) and travels with the task."""
    return _encode(docs, ranks_path, pattern, id_col, text_col, False)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: rows of ``id_col``, ``ids`` and ``decoded`` (binary), decoded from the ids alone."""
    return _encode(docs, ranks_path, pattern, id_col, text_col, True)


def _encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, back: bool) -> DataFrame:
    ranks = read_ranks(ranks_path)
    model = serialise_model(ranks)
    fields = [docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("decoded", T.BinaryType())] * back)

    def run(batches):
        encoder, decoder = PartEncoder(model, pattern), Decoder(ranks)
        for batch in slices(batches):
            found = encoder.ids(batch.column(1).to_pylist())
            columns = [batch.column(0), _lists(found)]
            if back:
                columns.append(pa.array([decoder.bytes(np.frombuffer(f, dtype="<u4")) for f in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows of ``id_col`` and ``decoded`` (binary): the bytes that the ids stand for; null ids stay null."""
    ranks = read_ranks(ranks_path)
    schema = T.StructType([encoded.schema[id_col], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        decoder = Decoder(ranks)
        for batch in slices(batches):
            lists = batch.column(1)
            decoded = [decoder.bytes(lists[i].values.to_numpy()) if lists[i].is_valid else None for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=schema.names)

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
