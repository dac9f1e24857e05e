"""Encoding with a public byte-level BPE vocabulary (problem 8), through sentencepiece.

A rank file becomes a sentencepiece BPE model without training: each token is a piece, its bytes mapped to printable
characters, scored by its negative rank; normalisation is the identity. Texts are parted into pre-tokens by the
vocabulary's pattern, mapped to the same characters and merged; piece numbers are the token ids. Decoding maps back.
Null, empty texts give an empty list; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of the vocabulary's pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEEP = 200_000  # pre-tokens of at most 40 characters that a worker remembers


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _block(field: int, body: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(body)) + body


def piece_model(path: str = VOCABULARY) -> bytes:
    """The serialised sentencepiece model of a rank file; the unknown piece, never used, follows the last token."""
    chars = byte_characters()
    with open(path, "rb") as f:
        ranks = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))
    out = [piece("".join(chars[b] for b in t), -float(r), 1) for r, t in ranks]
    out.append(piece("<unk>", 0.0, 2))
    trainer = b"\x18\x02" + _number(40 << 3) + _number(len(ranks))  # model_type BPE, unk_id
    normalizer = _block(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"  # no prefix, no removed or escaped blanks
    return b"".join(out) + _block(2, trainer) + _block(3, normalizer)


class Encoder:
    """Encodes lists of texts with a serialised model."""

    def __init__(self, model: bytes) -> None:
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        parts = [self.split(t) if t else [] for t in texts]
        new = list({p for ps in parts for p in ps if p not in self.known})
        mapped = [p.encode("utf-8").decode("latin-1").translate(self.table) for p in new]
        fresh = dict(zip(new, self.pieces.encode(mapped, num_threads=1) if mapped else []))
        known = self.known
        out = [[i for p in ps for i in (known[p] if p in known else fresh[p])] for ps in parts]
        if len(known) > KEEP:
            known.clear()
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= 40)
        return out

    def decode(self, ids: list[int]) -> str:
        back = {c: b for b, c in self.table.items()}
        return bytes(back[c] for i in ids for c in self.pieces.id_to_piece(i)).decode("utf-8")


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def _mapped(spark: SparkSession, docs: DataFrame, path: str, name: str, kind: str, column):  # noqa: ANN001, ANN202
    model = spark.sparkContext.broadcast(piece_model(path))  # about one megabyte, fixed by the vocabulary

    def run(batches):  # noqa: ANN001, ANN202
        encoder = _encoder(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), column(encoder.encode(b.column("text").to_pylist()))], names=["doc_id", name])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {name} {kind}")


def token_ids(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every document."""
    return _mapped(docs.sparkSession, docs, path, "ids", "array<int>", lambda rows: pa.array(rows, pa.list_(pa.int32())))


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every document."""
    return _mapped(docs.sparkSession, docs, path, "n_tokens", "int", lambda rows: pa.array([len(r) for r in rows], pa.int32()))
