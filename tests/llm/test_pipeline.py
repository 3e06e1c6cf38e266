import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from docketry.llm import common, quality, toxicity
from docketry.llm.queries import tokenizer_file
from tests.llm.test_models_and_join import brute_classes

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.score(docs, labels).collect() if r["predicted"] == 1}
    stage = docs.where(docs.doc_id.isin(good))
    clean = {r["doc_id"] for r in toxicity.score(stage, labels).collect() if r["predicted"] == 0}
    last = {rows[i]: i for i in sorted(clean)}
    want = {c for _, c, _, _ in brute_classes([(i, t) for t, i in last.items()])}
    before = common.mark()
    out = corpus_pipeline.run(spark, SF).collect()
    # what is left is the last stage's input and its pieces
    assert common.mark() - before == 2
    assert {r["doc_id"] for r in out} == want and len(want) > 50
    library, sequences = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), {}
    for doc in want:
        ids = np.array([*library.encode(rows[doc] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted((r for r in out if r["doc_id"] == doc), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes())) and (k == 0 or r["length"] == 2048)
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            at += r["length"]
        assert at == len(ids)
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
