"""The three levels of search and the factors of settlement questions, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import scoring, text
from docketry.operators import search

SECTIONS = "unit long, document long, section_key string, section string, title string, heading string, body string, embedding array<double>"
X, Y = [1.0, 0.0], [0.0, 1.0]


def test_levels_carry_the_score_of_the_parent(spark):
    documents = spark.createDataFrame([(1, "Alpha order", "penalty on alpha", X, "orders", "r1"), (2, "Beta order", "zzz", Y, "orders", "r2")], "unit long, title string, body string, embedding array<double>, bucket string, record string")
    sections = spark.createDataFrame([(11, 1, "a", "findings", "Findings", "", "alpha penalty", X), (21, 2, "a", "findings", "Findings", "", "alpha penalty", X)], SECTIONS)
    chunks = spark.createDataFrame([(111, 1, "a", "findings", "Findings", "", "alpha penalty", X), (112, 1, "b", "facts", "Facts", "", "alpha penalty", X), (211, 2, "a", "findings", "Findings", "", "alpha penalty", X)], SECTIONS)
    queries = spark.createDataFrame([(7, "alpha penalty", X, "generic", False, [])], "query_id int, query string, q array<double>, intent string, focused boolean, terms array<string>")
    docs, secs, found = (sorted((r.unit, r.final) for r in df.collect()) for df in search.levels(queries, documents, sections, chunks, (1, 2, 2)))
    first = 1 / 61 + 1.15 / 61
    second = (first + 0.15 * first) * 1.25
    third = (first + 0.15 * second) * 1.25
    assert [d[0] for d in docs] == [1] and docs[0][1] == pytest.approx(first, abs=1e-8)
    assert [s[0] for s in secs] == [11] and secs[0][1] == pytest.approx(second, abs=1e-8)
    assert [c[0] for c in found] == [111] and found[0][1] == pytest.approx(third, abs=1e-8)


def test_alignment(spark):
    rows = [("Settlement of Foo Bar", True, ["foo", "bar"], 1.18), ("Foo Bar", True, ["foo", "bar", "baz"], 1.12), ("Foo", True, ["foo", "bar"], 1.06), ("Other", True, ["foo", "bar"], 0.96), ("Foo", True, ["foo"], 1.0), ("", True, ["a", "b"], 1.0), (None, True, ["a", "b"], 1.0), ("Foo Bar", False, ["foo", "bar"], 1.0), ("Foo", None, None, 1.0)]
    df = spark.createDataFrame(rows, "t string, f boolean, n array<string>, want double")
    assert [r[0] for r in df.select(scoring.alignment_factor(F.col("t"), F.col("f"), F.col("n"))).collect()] == [r[3] for r in rows]


def test_content(spark):
    long = "word " * 30
    rows = [(long + "Settlement  Amount", "", "facts", True, 1.10, 1.04), (long + "it was remitted", "Terms of Settlement", "facts", True, 1.10, 1.04), (long + "it was remitted", "", "facts", True, 1.0, 1.0), ("Settlement Order in the matter of X", "", "header", True, 0.72, 1.0), ("Settlement Order; in the matter of X", "", "header", True, 1.0, 1.0), ("settlement amount", "", "facts", True, 1.0, 1.0), (long + "settlement amount", "", "facts", False, 1.0, 1.0), (None, None, None, True, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "b string, h string, s string, f boolean, c double, x double")
    args = [F.col(c) for c in "bhsf"]
    got = df.select(scoring.content_factor(*args, True), scoring.content_factor(*args, False)).collect()
    assert [tuple(r) for r in got] == [r[4:] for r in rows]


def test_parts_of_paths_and_sentences_are_trimmed(spark):
    df = spark.createDataFrame([([" 1. Facts ", "", "0 is first"], " A  >  0B > ", " 0 One.  Two; \n  Three ")], "p array<string>, s string, t string")
    row = df.select(text.heading_path(F.col("p")).alias("p"), text.split_heading_path(F.col("s")).alias("s"), text.sentences(F.col("t")).alias("t")).first()
    assert row.p == "1. Facts > 0 is first" and row.s == ["A", "0B"] and row.t == ["0 One.", "Two;", "Three"]
