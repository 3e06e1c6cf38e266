"""From raw documents to packed training sequences: quality, toxicity, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import exact_dedup, ngram_join, packing, quality, toxicity
from docketry.llm.common import discard, mark, materialise
from docketry.llm.queries import table, tokenizer_file
from docketry.session import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go. An empty or null text is scored like others; rows that repeat id and text go or stay together; an empty table gives no rows."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, with the same cases."""
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest id of equal texts stays, null texts being empty ones; of rows that repeat id and text one."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each class stays (null ids last); rows without words all stay."""
    ship(spark)
    return ngram_join.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece; null texts are empty and have their end token; repeated rows are packed each for itself."""
    ship(spark)
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality classifier", good_quality), ("toxicity", not_toxic), ("exact dedup", without_copies), ("n-gram Jaccard join", without_near_copies), ("best-fit packing", packed)]

#: Classifiers and the packing can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again by the next, and removed with the stage's own tables when that is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        since = mark()
        kept = materialise(stage(spark, docs, sf_dir), "stage")
        discard(spark, *([docs] if k else []), since=since, but=kept)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
