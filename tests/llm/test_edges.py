"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns of clashing names, for every operator and stage."""

import hashlib

import pytest

import corpus_pipeline
from docketry.llm import bpe, chat, common, exact_dedup, fingerprints, ngram_join, packing, quality, token_files, toxicity, warc
from docketry.llm.queries import tokenizer_file

BYTES, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
LONG = "many words of one very long text " * 3000
CLASHING = "key sig rep copies band size root links node class_id n_links keep_id kept group_size part length rank before piece id t n score predicted held_out ids file bucket at start word count quality toxic n_bytes hash owner payload digest __sha __keep __stays".split()
ROWS = [(1, None), (2, ""), (3, LONG), (4, LONG), (4, LONG), (5, "a short text of just six"), (5, "a short text of just six"), (6, "\x00  \U0001f600"), (None, "no id at all here, sir"), (7, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", None, *[None if k % 2 else -1] * len(CLASHING)) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHING))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, None, 5), (None, 1, 1, 5), (3, 1, 0, 5), (3, 1, 1, 5)], "doc_id long, quality int, toxic int, score int")


OPERATORS = {
    "op1": lambda d, labels: packing.pack(d, BYTES), "op2": lambda d, labels: bpe.digests(d, BYTES), "op3": quality.score, "op8": toxicity.score,
    "op4": lambda d, labels: ngram_join.Join(d).classes(), "op6": lambda d, labels: token_files.read(*token_files.write(d, WORDS)),
    "op7": lambda d, labels: exact_dedup.resolve(d), "op9": lambda d, labels: fingerprints.compare(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    ids = [r["doc_id"] for r in rows if not name.startswith("op1") or r["piece"] == 0]
    assert sorted(map(str, ids)) == sorted(str(i) for i, _ in ROWS)
    again = OPERATORS[name](docs, labels).collect()
    plain = lambda found: sorted(str(r) for r in found)
    assert name in ("op1", "op6") or plain(rows) == plain(again)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []


def test_results_on_odd_rows(docs):
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.resolve(docs).collect()}
    want_size = {t or "": sum((u or "") == (t or "") for _, u in ROWS) for _, t in ROWS}
    keep = {t or "": max((i for i, u in ROWS if (u or "") == (t or "") and i is not None), default=None) for _, t in ROWS}
    assert got == {(i, keep[t or ""], want_size[t or ""], i == keep[t or ""], sha(t)) for i, t in ROWS}
    near = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.Join(docs).classes().collect()}
    assert near[4] == (3, 2) and near[3] == (3, 2) and near[1] == (1, 0) and near[5] == (5, 1)


def test_the_packing_stage(spark, docs, tmp_path):
    stage = corpus_pipeline.STAGES[4][1]
    rows = stage(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in rows if r.piece == 0) == sorted(str(i) for i, _ in ROWS)
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


@pytest.mark.parametrize(("master", "right"), [("spark://somewhere:7077", False), ("local-cluster[2,1,1024]", False), ("local[4]", True), ("local", True)])
def test_no_folder_of_one_machine_on_a_cluster(master, right):
    class Unset:
        def get(self, key, default):
            return default

    class Context:
        def getConf(self):
            return Unset()

    class Session:
        conf, sparkContext = Unset(), Context()

    Session.sparkContext.master = master
    if right:
        assert common.shared_dir(Session()) == common.FALLBACK_DIR
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(Session())


@pytest.mark.parametrize("k", range(4))
def test_stages(spark, docs, labels, tmp_path, k):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = sorted(str(r.doc_id) for r in out.collect())
    assert set(kept) <= {str(i) for i, _ in ROWS} and (k != 3 or {"1", "2", "7", "3", "6"} <= set(kept))
    assert k not in (2, 3) or ("3" in kept) != ("4" in kept)
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_chat_and_warc(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi", 9), (2, 0, "user", "hi", 9), (2, 1, None, None, 9), (3, None, "user", None, 9), (None, 0, "user", "x", 9), (1, 0, "user", "hi", 9)], "conv_id long, turn long, role string, text string, place long")
    got = chat.render(turns).collect()
    assert {r.conv_id for r in got} >= {2, 3} and chat.render(turns.limit(0)).collect() == []
    pages = spark.createDataFrame([(1, "http://a.example.org/x", "y" * 200, 1), (2, None, "y" * 200, 1), (3, "not a url", None, 1), (4, "http://a.example.org/x", "", 1), (5, "http://a.example.org/x", LONG, 1)], "page_id long, url string, html string, digest long")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: (200, "response", None), 2: (200, "revisit", 1), 3: (0, "response", None), 4: (0, "response", None), 5: (len(LONG), "response", None)}
    assert warc.round_trip(pages.limit(0)).collect() == []
