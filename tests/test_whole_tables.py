"""Queries against results that are worked out over whole tables, without Spark or the queries' SQL."""

import re

import duckdb

from docketry.plans import registry

SF = "/root/testdata/sf0.001"


def test_provisions_of_every_line(spark):
    lines = duckdb.sql(f"select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag from '{SF}/lineitem.parquet'").fetchall()
    want = set()
    for order, line, supplier, part, flag in lines:
        kind, statute = ("Section", "Regulation", "Rule", "Schedule")[line % 4], ("SEBI Act, 1992", "Settlement Regulations", f"Carriage By {flag} Act, 1992", "Sample Rules, 2001")[part % 4]
        want |= {(order, kind, statute, str(line)), (order, kind, statute, f"{supplier % 50 + 60}A")}
    got = [(r.l_orderkey, r.kind, r.statute, r.reference) for r in registry.QUERIES["legal_provisions"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_text_functions_see_whole_texts(spark, tmp_path):
    texts = ["word  \t" * 100 + "end", "  --  " * 60 + "Late Start " + "x" * 60, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.cleaned, r.slug) for r in registry.QUERIES["text_functions"](spark, str(tmp_path)).collect()}
    assert got == {0: ("word " * 100 + "end", ("word-" * 10)[:48].rstrip("-")), 1: (("-- " * 60 + "Late Start " + "x" * 60), "late-start-" + "x" * 37), 2: ("", ""), 3: (None, None)}


def test_text_functions_of_every_document(spark):
    def cleaned(t):
        return re.sub(r"[ \t\f\v]+", " ", t).strip(" ")

    def slug(t):
        return re.sub("[^a-z0-9]+", "-", t.lower()).strip("-")[:48].rstrip("-")

    want = {i: (cleaned(t), slug(t)) for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}
    got = {r.doc_id: (r.cleaned, r.slug) for r in registry.QUERIES["text_functions"](spark, SF).collect()}
    assert got == want
