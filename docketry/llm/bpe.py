"""Byte-pair encoding and decoding of whole texts, with merges by contiguous rank arrays.

Defined results: a null text is empty, with no ids; a special token's string in a text is that
token; repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import map_arrow, text_or_empty
from docketry.llm.tokens import Tokenizer, byte_tokenizer


class Decoder:
    """decode(ids): the text, special tokens included; bytes that aren't UTF-8 become U+FFFD."""

    def __init__(self, tokenizer: Tokenizer):
        of = tokenizer.ranks.bytes | {i: s.encode() for s, i in tokenizer.specials.items()}
        n = max(of, default=-1) + 1
        parts = [of.get(i, b"") for i in range(n)]
        self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.size = np.fromiter(map(len, parts), dtype=np.int64, count=n)
        self.start = np.cumsum(self.size) - self.size

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(int(ends[-1])) + np.repeat(self.start[ids] - (ends - size), size)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, little-endian unsigned 32-bit integers in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(tokenizer_path)
        for batch in batches:
            ids = [x.astype("<u4").tobytes() for x in tokenizer.encode(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, type=pa.binary())], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")), run, "doc_id long, ids binary", text="text")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids and the text that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(byte_tokenizer(tokenizer_path))
        for batch in batches:
            texts = [decoder.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(texts, type=pa.string())], names=["doc_id", "ids", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(tokenizer_path)
        decoder = Decoder(tokenizer)
        for batch in batches:
            found = tokenizer.encode(batch["text"].to_pylist())
            ids = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]
            texts = [hashlib.sha256(decoder.decode(x).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(x) for x in found], type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(texts, type=pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty("text").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", text="text")
