"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Words are runs of letters, of numbers and of marks; features are single words and pairs, with a
common feature for a word that stands twice in a row. A document's score is the probability of label 1.

Defined results: a null text is empty and is scored by the bias alone; labels other than 0 and 1 and
unknown ids are ignored, of several labels of an id the largest counts, of several texts the one with the smallest hash is learnt from; without two kinds of labels
every score is 1; repeated rows are scored each for itself; an empty table gives no rows; labels,
lang, source and doc_id are no features, and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import linear
from docketry.llm.segments import mix, words

THRESHOLD = 0.5
_TWICE = np.uint64(0x51ED270B7F4A7C15)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = words(texts)
    one = w.names()
    same_doc = w.doc[1:] == w.doc[:-1]
    left, right = one[:-1][same_doc], one[1:][same_doc]
    two = mix(left * np.uint64(0x9E3779B97F4A7C15) + right)
    twice = np.where(left == right, _TWICE, two)
    doc = np.concatenate([w.doc, w.doc[1:][same_doc]])
    return linear.gather(doc, np.concatenate([mix(one), twice]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_train: int = linear.MAX_TRAIN) -> linear.Model | None:
    return linear.fit(docs, labels, "quality", features, ~held_out(F.col("doc_id")), max_train)


def score(docs: DataFrame, labels: DataFrame, max_train: int = linear.MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    scored = linear.score(docs, fit(docs, labels, max_train), features, 1.0)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = linear.MAX_TRAIN) -> DataFrame:
    """The rows of docs that are predicted 1, with all their columns."""
    return linear.keep(docs, fit(docs, labels, max_train), features, lambda s: s >= THRESHOLD)
