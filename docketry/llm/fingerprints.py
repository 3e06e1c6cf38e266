"""Document fingerprints by quartile bucket digests.

The byte triplets of a text are hashed into BUCKETS counts; each count becomes its quartile
(two bits), and the length becomes a step on a logarithmic scale. Two digests differ by the
length steps and by a bounded sum over buckets; likeness is 1 less their share of the bound.

Defined results: a null text is empty, and texts without a triplet count their bytes alone;
equal texts have equal fingerprints; documents with one id follow each other by text hash and
null ids come last; a single document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import map_arrow, text_or_empty
from docketry.llm.ranges import bounds, bucket_of

BUCKETS = 256
#: Differences of this and more are all of likeness 0: three fifths of what unrelated buckets can differ by.
BOUND = 3 * BUCKETS * 3 // 5
#: The cost of quartiles that are 0, 1, 2 or 3 apart; opposite quartiles cost double.
COST = np.array([0, 1, 2, 6])


def triplet_counts(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, dtype=np.uint8)
    if len(x) < 3:
        return np.bincount(x, minlength=BUCKETS)
    code = x[:-2].astype(np.uint32)
    code <<= np.uint32(8)
    code |= x[1:-1]
    code <<= np.uint32(8)
    code |= x[2:]
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(24)
    return np.bincount(code, minlength=BUCKETS)


def fingerprint(text: str) -> str:
    """Length step (one byte), then the quartiles of the buckets, four a byte, in hexadecimal."""
    data = text.encode()
    counts = triplet_counts(data)
    ranked = np.sort(counts)
    edges = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (counts[:, None] > edges).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    body = quartile[:, 0] | quartile[:, 1] << 2 | quartile[:, 2] << 4 | quartile[:, 3] << 6
    step = min(255, round(8 * math.log2(1 + len(data))))
    return f"{step:02x}" + body.astype(np.uint8).tobytes().hex()


def _parts(digest: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(digest), dtype=np.uint8)
    return int(raw[0]), np.stack([raw[1:] >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel().astype(np.int8)


def difference(a: str, b: str) -> int:
    """From 0 to BOUND: length steps beyond one, and COST of each bucket's quartiles."""
    (na, qa), (nb, qb) = _parts(a), _parts(b)
    return min(BOUND, max(0, abs(na - nb) - 1) + int(COST[np.abs(qa - qb)].sum()))


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The last floor(n/2) characters of text replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and its likeness to that and to the next document's.

    The documents are dealt by ranges of ids; the first one of each range also goes to the range before it, so that the
    last one there has its next. What the driver gets is one id a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    bucket = bucket_of(F.col("doc_id"), bounds(docs, id_col))
    heads = {r["bucket"]: r["head"] for r in rows.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    before = [(heads[b], order[i - 1]) for i, b in enumerate(order)]
    if len(order) == 1:
        before = [(heads[order[0]], order[0])]
    tail = F.broadcast(spark.createDataFrame(before, "head long, tail int"))  # a row a range
    dealt = rows.withColumn("bucket", bucket).join(tail, F.expr("doc_id <=> head"), "left")
    places = F.filter(F.array(F.struct(F.col("bucket"), F.lit(0).alias("kind")), F.struct(F.col("tail").alias("bucket"), F.lit(1).alias("kind"))), lambda p: p["bucket"].isNotNull())
    dealt = dealt.select("doc_id", "text", F.explode(places).alias("place")).select(F.col("place.bucket").alias("bucket"), F.col("place.kind").alias("kind"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    dealt = dealt.repartition("bucket").sortWithinPartitions(F.desc("bucket"), "kind", F.desc_nulls_last("doc_id"), "tie").drop("tie")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out = []
            for b, kind, doc, text in zip(*(batch[c].to_pylist() for c in ("bucket", "kind", "doc_id", "text")), strict=True):
                mark = fingerprint(text)
                if waiting is not None and waiting[0] == b:
                    _, own, before_text, before_mark = waiting
                    new = edited(before_text, text)
                    new_mark = fingerprint(new)
                    out.append((own, len(before_text), hashlib.sha256(new.encode()).hexdigest(), before_mark, new_mark, likeness(before_mark, new_mark), likeness(before_mark, mark)))
                waiting = (b, doc, text, mark) if kind == 0 else None
            cols = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return map_arrow(dealt, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", text="text")
