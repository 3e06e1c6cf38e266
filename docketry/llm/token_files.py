"""Token ids in Arrow stream files of fixed-size-list batches.

The ids of all documents, in ascending id order, are one stream. Each range bucket of ids
writes its share as Arrow stream files of about FILE_TOKENS ids: batches of equal-length sequences (``ids``) with
masks of the same shape (``mask``), the last sequence padded. All batches of a file but the
last have SEQUENCES rows and as many bytes, so a token's batch, row and place follow from its number, and a
memory-mapped file gives them without a copy; from other stores one batch is read at a time. A file's name has its attempt in
it, and the index names the files of the attempt that was committed.

Defined results: a null text is empty and has its end id alone; rows with one id follow each
other by text hash, and null ids come first; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import fresh_dir, gone_at_exit, local_path, map_arrow, materialise, open_store, publish, tasks_for, text_or_empty
from docketry.llm.ranges import bounds, bucket_of
from docketry.llm.tokens import word_tokenizer

LENGTH, SEQUENCES, END_ID = 2048, 64, 1
#: Ids after which a file ends with the document, and bytes of ids that a task reads back.
FILE_TOKENS, READ_BYTES = 64_000_000, 8 << 20


class Writer:
    """Appends ids to an Arrow stream file of sequences of ``length``."""

    def __init__(self, out, length: int, wide: bool):
        self.kind = np.dtype("<u4" if wide else "<u2")
        self.length, self.left, self.size, self.total = length, [], 0, 0
        item = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = pa.ipc.new_stream(out, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.left.append(ids.astype(self.kind))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.length * SEQUENCES:
            self._emit(SEQUENCES)

    def _emit(self, rows: int, pad: bool = False) -> None:
        flat = np.concatenate(self.left) if self.left else np.zeros(0, dtype=self.kind)
        step = rows * self.length
        while len(flat) >= step > 0:
            self._batch(flat[:step], step)
            flat = flat[step:]
        if pad and len(flat):
            whole = -(-len(flat) // self.length) * self.length
            self._batch(np.concatenate([flat, np.zeros(whole - len(flat), dtype=self.kind)]), len(flat))
            flat = flat[:0]
        self.left, self.size = [flat], len(flat)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.stream.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self) -> None:
        self._emit(SEQUENCES, pad=True)
        self.stream.close()


class Reader:
    """Random access to the tokens, sequences and masks of a stream file."""

    def __init__(self, path: str):
        store, at = open_store(path)
        self.source = pa.memory_map(at) if local_path(path) is not None else store.open_input_file(at)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.length = self.schema.field("ids").type.list_size
        self.first, self.step = self.source.tell(), 0
        self.held: tuple[int, pa.RecordBatch | None] = (-1, None)
        try:
            self.held = (0, self._next())
            self.step = self.source.tell() - self.first
        except EOFError:
            pass

    def _next(self) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def batch(self, k: int) -> pa.RecordBatch:
        """The k-th batch; the batches before it have as many bytes as the first."""
        if self.held[0] != k:
            if k < 0 or not self.step or self.first + k * self.step >= self.source.size():
                raise IndexError("past the end of the stream")
            self.source.seek(self.first + k * self.step)
            try:
                self.held = (k, self._next())
            except EOFError:
                raise IndexError("past the end of the stream") from None
        return self.held[1]

    def close(self) -> None:
        self.source.close()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = self.batch(i // SEQUENCES), i % SEQUENCES
        ids, mask = batch["ids"], batch["mask"]
        return ids[row].values.to_numpy(), mask[row].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from place start: a view where they lie in one batch. Padding is never among them."""
        step, parts = SEQUENCES * self.length, []
        while n:
            k, at = divmod(start, step)
            batch = self.batch(k)
            take = min(n, len(batch) * self.length - at)
            last = batch["mask"].values[at + take - 1].as_py() if take > 0 else False
            if not last:
                raise IndexError("past the end of the stream")
            parts.append(batch["ids"].values.slice(at, take).to_numpy())
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, dtype="<u2")])


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, length: int = LENGTH, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """Writes the files (to a folder that goes with the driver where none is given); returns where each document is (doc_id, file, place in the file, bucket, place in the bucket, n_tokens) and the tokens of each bucket."""
    spark = docs.sparkSession
    own = folder is None
    folder = folder or fresh_dir(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    dealt = rows.withColumn("bucket", bucket_of(F.col("doc_id"), bounds(docs, id_col))).repartition("bucket")
    dealt = dealt.withColumn("tie", F.xxhash64("text")).sortWithinPartitions("bucket", "doc_id", "tie").select("bucket", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        wide = max(tokenizer.ranks.vocab_size, *tokenizer.specials.values(), end_id) >= 1 << 16

        def documents():
            for batch in batches:
                yield from zip(batch["bucket"].to_pylist(), batch["doc_id"].to_pylist(), tokenizer.encode(batch["text"].to_pylist()), strict=True)

        stream, attempt = documents(), uuid.uuid4().hex[:12]
        ahead, last, before, number = next(stream, None), None, 0, 0
        while ahead is not None:
            bucket, made = ahead[0], []
            before, number = (before, number + 1) if bucket == last else (0, 0)

            def fill(out, bucket=bucket, made=made):
                nonlocal ahead
                writer = Writer(out, length, wide)
                while ahead is not None and ahead[0] == bucket and writer.total < file_tokens:
                    made.append((ahead[1], writer.total, len(ahead[2]) + 1))
                    writer.add(np.append(ahead[2], end_id))
                    ahead = next(stream, None)
                writer.close()

            name = f"{bucket:08d}-{number:06d}-{attempt}.arrows"
            publish(folder, name, fill)
            place, n = (np.array([x[k] for x in made], dtype=np.int64) for k in (1, 2))
            arrays = [pa.array([x[0] for x in made], type=pa.int64()), pa.array([f"{folder}/{name}"] * len(made)), pa.array(place, type=pa.int64()), pa.array([bucket] * len(made), type=pa.int32()), pa.array(before + place, type=pa.int64()), pa.array(n, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "file", "place", "bucket", "at", "n_tokens"])
            last, before = bucket, before + int(n.sum())

    index = materialise(map_arrow(dealt, run, "doc_id long, file string, place long, bucket int, at long, n_tokens long", text="text"), "token-index")
    if own:
        gone_at_exit(spark, folder)
    totals = {r["bucket"]: r["n"] for r in index.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()}
    return index, totals


def read(index: DataFrame, totals: dict[int, int]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, its ids taken from the files."""
    first, seen = {}, 0
    for bucket in sorted(totals):
        first[bucket] = seen
        seen += totals[bucket]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            start, crc = [], []
            for file, place, bucket, at, n in zip(*(batch[c].to_pylist() for c in ("file", "place", "bucket", "at", "n_tokens")), strict=True):
                if file != opened:
                    if reader is not None:
                        reader.close()
                    reader, opened = Reader(file), file
                start.append(first[bucket] + at)
                crc.append(zlib.crc32(reader.tokens(place, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(start, type=pa.int64()), batch["n_tokens"], pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = index.repartition(tasks_for(seen * 2, READ_BYTES), "file").sortWithinPartitions("file", "place")
    return map_arrow(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
