"""Logistic regression on hashed sparse features, by follow-the-regularised-leader updates.

Training uses a bounded sample: the MAX_TRAIN labelled documents with the smallest hash of
their id, and where an id has several texts the one with the smallest hash. Their features, not their texts, come to the driver; the weights, of fixed size,
go back to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import map_arrow, sliced, text_or_empty

BITS = 20
MAX_TRAIN, EPOCHS = 6000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2.5, 0.5

#: From texts to (text number ascending, feature, value), each feature once a text.
Features = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def gather(doc: np.ndarray, name: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features with the value 1 + ln(count)."""
    key = (doc.astype(np.uint64) << np.uint64(bits)) | (name >> np.uint64(64 - bits))
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64), 1 + np.log(count)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str], features: Features) -> np.ndarray:
        """Sparse dot products, through the logistic function."""
        doc, at, value = features(texts)
        margin = np.bincount(doc, weights=self.weights[at] * value, minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """examples: (label, features, values). The order of each pass is drawn from a fixed seed."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    rng = np.random.default_rng(0)

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            label, at, value = examples[i]
            value = value.astype(float)
            w = weight(z[at], n[at])
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ value + wb, -35, 35)))
            g = (p - label) * value
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
            gb = p - label
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * wb
            nb += gb * gb
    return Model(weight(z, n).astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)))


def fit(docs: DataFrame, labels: DataFrame, label: str, features: Features, may_learn: Column, max_train: int = MAX_TRAIN) -> Model | None:
    """None where no labelled document may be learnt from, or all have one label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(may_learn)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    # max_train rows of two numbers
    sample = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen = texts.join(F.broadcast(sample), "doc_id")
    # one text an id: the first by hash; each task hands on one of its own
    chosen = chosen.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "label", "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            doc, at, value = features(texts)
            cut = np.searchsorted(doc, np.arange(1, len(texts)))
            cols = [pa.array([x.tobytes() for x in np.split(a.astype(k), cut)], type=pa.binary()) for a, k in ((at, "<i4"), (value, "<f4"))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], *cols], names=["doc_id", "label", "at", "value"])

    found = map_arrow(chosen, run, "doc_id long, label int, at binary, value binary", text="text")
    # one partition at a time, each row as two arrays
    rows = sorted(((r["doc_id"], r["label"], np.frombuffer(r["at"], dtype="<i4"), np.frombuffer(r["value"], dtype="<f4")) for r in found.toLocalIterator()), key=lambda r: r[0])
    if len({r[1] for r in rows}) < 2:
        return None
    return train([r[1:] for r in rows])


def score(docs: DataFrame, model: Model | None, features: Features, untrained: float) -> DataFrame:
    """doc_id and score of every row, from the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = np.full(len(texts), untrained) if model is None else model.scores(texts, features) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, type=pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")), run, "doc_id long, score double", text="text")


def keep(docs: DataFrame, model: Model | None, features: Features, stays: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs whose scores stay, with all their columns; texts don't leave their partition."""
    if model is None:
        return docs
    text, name = docs.columns.index("text"), "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, name):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(stays(model.scores(texts, features)))) if texts else batch

    return docs.mapInArrow(run, docs.schema)
