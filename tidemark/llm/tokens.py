"""Token ids of a whole corpus by a public byte-level vocabulary (problem 8)."""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import spread

#: Folder of the vocabulary files; every function takes another as ``folder``.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

#: Fixed value: how byte-level BPE cuts a text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pre-tokens a worker remembers before it starts anew; this bounds memory and changes no result.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it prints, else the next free code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model, serialised field by field: piece i is the byte-mapped token of rank i, scored -i.

    The highest score among neighbouring pairs is then the lowest rank, as in the vocabulary's own merging. Text
    isn't normalised, no blank is added, removed or escaped. One unknown piece follows; all bytes are pieces,
    so it never comes out.
    """
    letters = byte_letters()
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2 ... without a gap")
    out = bytearray()
    for i, token in enumerate(order):
        name = "".join(letters[b] for b in token).encode()
        out += _block(1, _block(1, name) + b"\x15" + struct.pack("<f", -float(i)) + _number(3, 1))
    out += _block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(order) + 1) + _number(40, len(order))
    trainer += _number(41, -1) + _number(42, -1) + _number(43, -1)
    out += _block(2, trainer)
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Encoder:
    """Pre-tokens are encoded once each by sentencepiece and remembered."""

    def __init__(self, vocabulary: bytes):
        import regex
        import sentencepiece

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.pieces = sorted(ranks, key=ranks.get)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.cut = regex.compile(PRE_TOKEN).findall
        self.table = byte_letters()
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` without special tokens; null and empty texts have none."""
        if not text:
            return []
        words, known = self.cut(text), self.known
        if new := set(words).difference(known):
            if len(known) > REMEMBERED:
                known.clear()
                new = set(words)
            new = list(new)
            table = self.table
            mapped = ["".join([table[b] for b in w.encode("utf-8", "surrogatepass")]) for w in new]
            known.update(zip(new, self.model.encode(mapped, out_type=int, num_threads=1)))
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        """The inverse mapping: ids to bytes to text. A cut character comes out as U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder_of(vocabulary: bytes) -> Encoder:
    """One encoder a worker process, whatever the number of its tasks."""
    return Encoder(vocabulary)


def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return encoder_of(f.read())


def _vocabulary(df: DataFrame, name: str, folder: str | None):
    """The file's bytes, about a megabyte, broadcast: executors need no folder of their own."""
    with open(os.path.join(folder or FOLDER, f"{name}.tiktoken"), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Rows (``id_col``, ids): the token ids of each text, an empty list for null and empty texts.

    Each row of ``df`` gives one row, repeated ones too; other columns are ignored. One narrow stage of Arrow batches.
    """
    shared = _vocabulary(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared.value).encode
        for b in batches:
            n = max(1, min(b.num_rows, 512))
            for at in range(0, b.num_rows, n):
                part = b.slice(at, n)
                lists = [enc(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int32()))], ["id", "ids"])

    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def count_tokens(df: DataFrame, text_col: str = "text", out: str = "tokens", *, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``df`` without ``text_col``, with ``out``: how many ids its text has (0 for null and empty ones)."""
    shared, keep = _vocabulary(df, name, folder), [c for c in df.columns if c != text_col]
    rows = spread(df.select(*keep, text_col))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared.value).encode
        for b in batches:
            n = pa.array([len(enc(x)) for x in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], [*keep, out])

    return rows.mapInArrow(run, f"{kinds}, `{out}` long")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Rows (``id_col``, text): the texts that :func:`encode_corpus` had, an empty one for empty or null ids."""
    shared = _vocabulary(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = encoder_of(shared.value).decode
        for b in batches:
            texts = [dec(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").select(F.col("id").alias(id_col), "text")
