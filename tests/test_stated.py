"""Answers in sentences, against plain versions."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.operators import stated
from docketry.plans import stated as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("sentence", "want"), [
    ("Alpha Trust held 1,200 shares (4.5%) and Mr. Ram Lal holds 10 shares.", [("Alpha Trust", "1200", 4.5, False), ("Mr. Ram Lal", "10", None, False)]),
    ("A stake of 12 per cent is with Beta Foods Pvt. Ltd.", [("Beta Foods Pvt. Ltd.", None, 12.0, False)]),
    ("Gamma Infra proposes to acquire 5% from Delta Power which owns 40%.", [("Gamma Infra", None, 5.0, True), ("Delta Power", None, 40.0, True)]),
    ("it holds 5% of something", []), ("Alpha Trust and Beta Foods are companies.", []), ("", []), ("Alpha Trust has 1 share, 2 shares and 3%, 4%", [("Alpha Trust", "1", 3.0, False)]),
])
def test_holdings(sentence, want):
    got = stated.holdings_in(sentence)
    assert [g[:3] for g in got] == [w[:3] for w in want] and (not want or got[0][3] == want[0][3])


@given(st.lists(st.integers(0, 60), max_size=10, unique=True), st.lists(st.integers(0, 60), max_size=8, unique=True))
def test_owners_are_the_nearest_ones(numbers, starts):
    owners = [(b, b + 1) for b in sorted(starts)]
    for at, k in zip(numbers, stated.owners_of(numbers, owners), strict=True):
        before = [i for i, (b, _) in enumerate(owners) if b < at]
        assert k == (max(before, key=lambda i: owners[i][0]) if before else min(range(len(owners)), key=lambda i: owners[i][0], default=None))


def test_holding_tuples_of_every_line(spark):
    got = {(int(r.doc), r.place): set() for r in plans.holding_tuples(spark, SF).collect()}
    for r in plans.holding_tuples(spark, SF).collect():
        got[int(r.doc), r.place].add((r.owner, r.shares, r.percentage, r.proposed))
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for n in range(0, len(r.text.split("\n")), 2):
            owned, own = (f"Person {chr(65 + c % 26)}x Holdings" for c in (n, r.doc_id))
            own_rows = {x for x in got[r.doc_id, n] if x[0] in (owned, own)}
            assert (owned, f"{n * 7 + 1}000", n % 90 + 0.5, False) in own_rows or owned == own or any(x[0] == owned and x[1] == f"{n * 7 + 1}000" for x in own_rows)
            assert any(x[0] == own and x[2] == float(r.doc_id % 40) and x[3] for x in own_rows) or owned == own


def plain_key(t):
    return " " + " ".join(re.findall("[a-z0-9]+", t.lower().replace("&", " and "))) + " "


def test_direction_sentences_of_every_document(spark):
    held = {}
    for r in plans.planted(spark, SF).collect():
        held.setdefault(r.document, []).append(r)
    got = {}
    for r in plans.direction_sentences(spark, SF).collect():
        got.setdefault(r.document, []).append((r["rank"], r.sentence, r.kind, round(r.score, 4)))
    words = lambda key, phrases: any(f" {p} " in key for p in phrases)
    for document, rows in held.items():
        rows = [r for r in rows if r.section in ("directions", "operative_order") or words(plain_key(r.body), stated.ACTIONS)]
        best = {}
        for r in rows:
            if r.page < max(x.page for x in rows) - 1:
                continue
            for s in re.split(r"\n+|(?<=[.;])\s+(?=[A-Z])", re.sub(r"(?<=[a-z])\.\s+(?=[a-z])", " ", r.body)):
                s = " ".join(s.split()).strip(" .;") + "."
                key = plain_key(s)
                if len(s) < 25 or re.match("[a-z]", s) or key.split(" ")[1] in stated.BEGINNINGS or any(key.endswith(f" {e} ") for e in stated.ENDINGS) or words(key, stated.PASSED_OVER) or not words(key, stated.ACTIONS):
                    continue
                score = stated.SENTENCE_BASE.get(r.section, 0.6) + sum(w for _, w, p in stated.CUES if words(key, p)) + r.page / 1000
                kind = next((n for n, _, p in stated.CUES if words(key, p)), "other")
                if s.lower() not in best or score > best[s.lower()][0]:
                    best[s.lower()] = (score, s, kind)
        want = sorted(best.values(), key=lambda x: (-round(x[0], 6), len(x[1]), x[1]))[:3]
        assert sorted(got.get(document, [])) == [(k, s, kind, round(score, 4)) for k, (score, s, kind) in enumerate(want, 1)], document


@pytest.mark.parametrize(("query", "want"), [("What is the shareholding of A? 5 %", "holding"), ("how many shares", "holding"), ("PAN of A and the amount", "pan"), ("the amount in lakh", "amount"), ("who were the noticees", "party"), ("panel", None), ("", None), (None, None)])
def test_kinds(spark, query, want):
    assert spark.createDataFrame([(query,)], "q string").select(stated.fact_kind(F.col("q"))).first()[0] == want
