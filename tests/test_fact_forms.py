"""Amounts and provisions in all the forms that orders use."""

import pytest

from docketry.operators import facts

AMOUNTS = [
    ("A fine of ₹ 5,00,000/- was paid", [("₹ 5,00,000/-", 500000.0, "unit")]),
    ("about 15 crore and 50 lakh", [("15 crore", 150000000.0, "crore"), ("50 lakh", 5000000.0, "lakh")]),
    ("Rs.2.5 crore, INR 10 and ₹3 lakh", [("Rs.2.5 crore", 25000000.0, "crore"), ("INR 10", 10.0, "unit"), ("₹3 lakh", 300000.0, "lakh")]),
    ("USD 5 million or $7", [("USD 5 million", 5000000.0, "million"), ("$7", 7.0, "unit")]),
    ("Rs. 1,000/- each", [("Rs. 1,000/-", 1000.0, "unit")]),
    ("12 lakhpati, 7 officers, the brokers 9", []),
    (None, []),
]
PROVISIONS = [
    ("under sections 11(1) read with 11B of the SEBI Act, 1992", "Section", "SEBI Act, 1992", ["11(1)", "11B"]),
    ("section 11 and section 11B of the Securities and Exchange Board of India Act", "Section", "SEBI Act, 1992", ["11", "11B"]),
    ("regulation 3/4 of PFUTP Regulations", "Regulation", "PFUTP Regulations", ["3", "4"]),
    ("Regulations 3(a), (b), (c) and 4(1) of the PFUTP Regulations, 2003", "Regulation", "PFUTP Regulations", ["(b)", "(c)", "3(a)", "4(1)"]),
    ("regulation 10 of SAST", "Regulation", "SAST Regulations", ["10"]),
    ("Schedule II; III of the ICDR", "Schedule", "ICDR Regulations", ["II", "III"]),
    ("schedules A & B of the Companies Act, 2013", "Schedule", "Companies Act, 2013", ["A", "B"]),
    ("rule 4 of the SEBI (Procedure for Holding Inquiry) Rules, 1995", "Rule", "Sebi (procedure For Holding Inquiry) Rules, 1995", ["4"]),
    ("section 12A(a), 12A(b), and 12A(c) of the Sample Act", "Section", "Sample Act", ["12A(a)", "12A(b)", "12A(c)"]),
]


def test_amounts(spark):
    rows = spark.createDataFrame([(i, 0, s) for i, (s, _) in enumerate(AMOUNTS)], "id int, place int, sentence string")
    got = {}
    for r in facts.amounts(rows, "id").orderBy("id", "k").collect():
        got.setdefault(r.id, []).append((r.amount_text, r.amount, r.unit))
    assert got == {i: want for i, (_, want) in enumerate(AMOUNTS) if want}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, f"It was held {p[0]} that this stands.") for i, p in enumerate(PROVISIONS)], "id int, body string")
    return facts.provisions(rows, "id", "body").collect()


@pytest.mark.parametrize("i", range(len(PROVISIONS)))
def test_provisions(found, i):
    got = [r for r in found if r.id == i]
    assert ({r.kind for r in got}, {r.statute for r in got}, sorted(r.reference for r in got)) == ({PROVISIONS[i][1]}, {PROVISIONS[i][2]}, PROVISIONS[i][3])


def test_two_statutes_and_none(spark):
    body = "section 5 of the Companies Act and section 11 of the SEBI Act; the rules of the house; section of the SEBI Act; " + "section " + "1, 2 and " * 200
    got = facts.provisions(spark.createDataFrame([(1, body), (2, None)], "id int, body string"), "id", "body").collect()
    assert sorted((r.kind, r.statute, r.reference) for r in got) == [("Section", "Companies Act", "5"), ("Section", "SEBI Act, 1992", "11")]
