"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import bpe, chat, exact_dedup, filter_audit, fingerprints, line_dedup, ngram_join, packing, quality, token_files, toxicity, warc, whitening


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.Join(table(spark, sf_dir, "documents")).classes()


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, totals = token_files.write(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return token_files.read(index, totals)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_bpe_round_trip, op3_quality_classifier, op4_ngram_join, op5_chat_formatting, op6_token_files, op7_exact_dedup, op8_toxicity, op9_fingerprints, op10_warc, op11_filter_audit, op12_embedding_whitening, op13_line_dedup)}

OP7_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (t)
"""
OP10_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when first < page_id then 'revisit' else 'response' end as record_type,
       case when first < page_id then first end as refers_to
from p left join f using (payload_digest)
"""
ORACLE_SQL: dict[str, str] = {"op5_chat_formatting": chat.ORACLE_SQL, "op7_exact_dedup": OP7_SQL, "op10_warc": OP10_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL, "op13_line_dedup": line_dedup.ORACLE_SQL}
