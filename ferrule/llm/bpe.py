"""Byte-level BPE by way of a sentencepiece model that is written, not trained.

The vocabulary is a rank file: every token is a byte string with a rank.  The
model has one piece per rank, in the order of the ranks, so that piece ids are
token ids.  A piece is the token with each byte mapped to one printable
character, and its score is the negative rank: the piece model joins the
adjacent pair with the highest score, leftmost first, which is the merge order
of the ranks.  Normalisation is the identity and no prefix is added.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Character of byte b: a block of the CJK ideographs, where none is a space or changes under normalisation.
BYTE_BASE = 0x4E00
#: Distinct pre-tokens that a task remembers; beyond it the memory starts anew.
MEMORY = 400_000
#: Pre-tokens longer than this are encoded without being remembered.
LONGEST_REMEMBERED = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, ints varints, floats fixed 32 bit."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(data: bytes) -> str:
    """Bytes as text with one character a byte."""
    return data.decode("latin-1").translate(_UP)


_UP = {b: BYTE_BASE + b for b in range(256)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks.

    Ranks must run from 0 without gaps; the unknown piece comes after the last.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = [_field(1, _field(1, mapped(t).encode()) + _field(2, -float(r)) + _field(3, 1)) for r, t in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1 as a varint
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    trainer += _field(24, 0)  # treat_whitespace_as_suffix
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        n = self.sp.get_piece_size() - 1
        down = {BYTE_BASE + b: b for b in range(256)}
        self.tokens = [self.sp.id_to_piece(i).translate(down).encode("latin-1") for i in range(n)]
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.memory: dict[str, tuple[int, ...]] = {}

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens.  One that is a token as a whole is that token, as rank-file tokenizers have it."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        merged = iter(self.sp.encode([mapped(r) for r in raw if r not in self.whole], out_type=int, num_threads=1))
        return [(self.whole[r],) if r in self.whole else tuple(next(merged)) for r in raw]

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of whole texts."""
        for text in texts:
            words = self.split(text)
            if len(self.memory) > MEMORY:
                self.memory = {}
            memory = self.memory
            new = list({w for w in words if w not in memory})
            long = {}
            for a in range(0, len(new), 4096):
                part = new[a : a + 4096]
                for w, ids in zip(part, self.encode_words(part), strict=True):
                    (memory if len(w) <= LONGEST_REMEMBERED else long)[w] = ids
            out: list[int] = []
            if long:
                for w in words:
                    out += memory[w] if w in memory else long[w]
            else:
                for ids in map(memory.__getitem__, words):
                    out += ids
            yield out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Token ids and decoded bytes of every whole text.

    Returns id_col, n_tokens, ids array<int> (if `ids`), ids_sha256, decoded_sha256
    and decoded_ok, one row per input row, in any order.  A null text counts as
    empty: no tokens.  Repeated rows and null ids stay as they are; other columns
    of `docs` are not returned.  The vocabulary (under 1 MB) goes to the executors
    as a broadcast variable, its size being that of the file.
    """
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(serialise_model(load_ranks(ranks_path)))
    id_type = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = f"id {id_type.simpleString()}, n_tokens bigint, " + "ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string, decoded_ok boolean"

    def run(batches):
        codec = Codec(model.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(1).to_pylist()
                counts, all_ids, shas, decoded, ok = [], [], [], [], []
                for text, got in zip(texts, codec.encode_many(texts), strict=True):
                    back = codec.decode(got)
                    counts.append(len(got))
                    if ids:
                        all_ids.append(pa.array(got, pa.int32()))
                    shas.append(hashlib.sha256(",".join(map(str, got)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    ok.append(back == text.encode("utf-8", "surrogatepass"))
                cols = [batch.column(0), pa.array(counts, pa.int64())]
                if ids:
                    flat = pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())
                    offsets = pa.array([0, *_running(counts)], pa.int32())
                    cols.append(pa.ListArray.from_arrays(offsets, flat))
                cols += [pa.array(shas, pa.string()), pa.array(decoded, pa.string()), pa.array(ok, pa.bool_())]
                names = ["id", "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256", "decoded_ok"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return narrow.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def _running(counts: list[int]) -> list[int]:
    out, total = [], 0
    for c in counts:
        total += c
        out.append(total)
    return out
